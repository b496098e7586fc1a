"""WARC archives whose repeated payloads are revisit records.

Headers (digest, size, id) are shuffled by payload digest, the first record of
each digest stays a response, and all others are joined to it and written
as revisits, without their payload and with fresh headers. The digests that
repeat are sent to the pages while they are few, so that payloads stay where
they are read. Archives are read back by Content-Length, one file a task,
unpacked piece by piece.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adlumen.functions.sizing import lookup_side
from adlumen.llm.common import stored, text_of

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BETWEEN = "\r\n\r\n"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32: five hex digits at a time give four letters."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), DIGITS, BASE32)


def _record_id(page: Column, digest: Column) -> Column:
    """A record's own URN, the same however often a lost task is run again."""
    h = F.md5(F.concat_ws("|", F.lit("record"), page.cast("string"), digest))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def mean_payload(pages: DataFrame, payload_column: str = "html") -> float:
    """Bytes of a payload on average, from one look at the column."""
    return float(pages.agg(F.avg(F.octet_length(text_of(payload_column)))).first()[0] or 0)


def resolve_revisits(pages: DataFrame, least_bytes: int = 0, id_column: str = "page_id",
                     url_column: str = "url", payload_column: str = "html") -> DataFrame:
    """Every page as a record: response, or revisit of the first with an equal payload.

    Null payloads are empty. The first is the smallest id, null ids last; rows
    that repeat its id are responses like it. Payloads under ``least_bytes``
    are all responses.
    """
    payload = text_of(payload_column)
    rows = pages.select(
        F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"),
        payload.alias("payload"), F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        base32_sha1(payload.cast("binary")).alias("payload_digest"),
    )
    # Merged map-side, so a digest that a third of the pages share is no hot key here; should
    # the join below shuffle, its pages can be split, since the other side has one row for it.
    firsts = stored(rows.groupBy("payload_digest", "payload_bytes").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")
    ).filter((F.col("n") > 1) & (F.col("payload_bytes") >= least_bytes)).drop("n"), "repeated")
    joined = rows.join(lookup_side(firsts), ["payload_digest", "payload_bytes"], "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.withColumn("refers_to", F.when(again, F.col("first"))).withColumn(
        "record_type", F.when(again, "revisit").otherwise("response")).drop("first")


def _header(name: str, value: Column) -> Column:
    """One header line; none if the value is null. Line breaks in values are escaped."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


# Records of a file, and bytes that so many records of mean size may have at most.
FILE_RECORDS, FILE_BYTES = 2000, 64 << 20


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z",
                   file_records: int = FILE_RECORDS, file_bytes: int = FILE_BYTES,
                   mean_bytes: float | None = None) -> None:
    """``records`` (of ``resolve_revisits``) as .gz WARC files; revisits carry no payload.

    A file is cut after ``file_records``, or fewer if that many of mean size pass
    ``file_bytes``; ``mean_bytes`` saves finding the mean. Null ids and URLs leave
    their header out. No records give archives without any.
    """
    if mean_bytes is None:
        mean_bytes = records.agg(F.avg("payload_bytes")).first()[0] or 0
    records_per_file = max(1, min(file_records, int(file_bytes // (mean_bytes + 1))))
    revisit = F.col("record_type") == "revisit"
    own = _record_id(F.col("page_id"), F.col("payload_digest"))
    block = F.concat(F.lit(HTTP), F.when(revisit, "").otherwise(F.col("payload")))
    lines = F.concat(
        F.lit("WARC/1.1\r\n"), _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", own), _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("WARC-Page-ID", F.col("page_id").cast("string")),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to"),
                                                             F.col("payload_digest")))),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
    )
    (records.select(lines.alias("value")).write.option("lineSep", BETWEEN)
     .option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path))


RECORDS = ("page_id string, record_id string, record_type string, url string, "
           "payload_digest string, refers_to_record string, payload binary")


# Unpacked at a time, and handed on together.
PIECE, BATCH_BYTES = 1 << 20, 8 << 20


def _unpacked(content: bytes) -> Iterator[bytes]:
    """The bytes of gzip members one after the other, in pieces."""
    while content:
        member = zlib.decompressobj(wbits=31)
        left = content
        while left and not member.eof:
            yield member.decompress(left, PIECE)
            left = member.unconsumed_tail
        if not member.eof:  # at its end, a flush would give the rest of the file once more
            yield member.flush()
        content = member.unused_data


def _parse(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """Records one by one; no more is held than the piece at hand and the record being read."""
    held = bytearray()

    def upto(end: int) -> bool:
        while len(held) < end:
            more = next(pieces, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while upto(1):
        end, sought = held.find(b"\r\n\r\n"), 0
        while end < 0 and upto(len(held) + 1):
            end = held.find(b"\r\n\r\n", max(0, sought - 3))
            sought = len(held)
        head = dict(line.split(": ", 1) for line in held[:end].decode().split("\r\n")[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        upto(stop + len(BETWEEN))
        block = bytes(held[start:stop])
        del held[: stop + len(BETWEEN)]
        digest = re.sub("^sha1:", "", head.get("WARC-Payload-Digest", ""))
        kind = head["WARC-Type"]
        yield (
            head.get("WARC-Page-ID"), head["WARC-Record-ID"], kind,
            head.get("WARC-Target-URI"), digest, head.get("WARC-Refers-To"),
            None if kind == "revisit" else block[block.index(b"\r\n\r\n") + 4:],
        )


def _parse_files(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [field.split()[0] for field in RECORDS.split(", ")]
    for frame in files:
        for content in frame["content"]:
            rows, size = [], 0
            for record in _parse(_unpacked(content)):
                rows.append(record)
                size += len(record[-1] or b"")
                if size > BATCH_BYTES or len(rows) >= FILE_RECORDS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files below ``path``; revisits have no payload."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(_parse_files, RECORDS)


def read_resolved(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """Every record with the size and digest of its full payload, through its response.

    A revisit whose response is missing has neither. An archive without records
    gives an empty result.
    The digest is computed from the payload that was read, not taken from the header.
    """
    records = stored(read_archives(spark, path).select(
        F.col("page_id").cast(id_type).alias("page_id"), "record_id", "record_type",
        "refers_to_record", F.octet_length("payload").cast("bigint").alias("bytes"),
        base32_sha1(F.col("payload")).alias("digest"),
    ), "warc-headers")
    responses = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("of"), F.col("page_id").alias("of_page"),
        F.col("bytes").alias("of_bytes"), F.col("digest").alias("of_digest"),
    ).dropDuplicates(["of"])
    # Only revisits are joined: the null references of responses would meet in one task.
    known = records.filter("record_type = 'response'").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", F.lit(None).cast(id_type).alias("refers_to"))
    resolved = records.filter("record_type = 'revisit'").join(
        responses, F.col("refers_to_record") == F.col("of"), "left"
    ).select("page_id", F.col("of_bytes").alias("payload_bytes"),
             F.col("of_digest").alias("payload_digest"), "record_type",
             F.col("of_page").alias("refers_to"))
    return known.unionByName(resolved)
