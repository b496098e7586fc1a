"""Operators that look at rows one group at a time: sharding, exact copies, archives."""

import base64
import gzip
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from adlumen.llm import warc
from adlumen.llm.exact_dedup import drop_copies, mark_copies
from adlumen.llm.sharding import longest_first, shard_documents
from tests.llm.conftest import ODD, prose


def test_shards_hold_groups_and_slots(spark, rows):
    texts = [prose(k % 90, 5 + k % 60) for k in range(400)] + ODD
    found = shard_documents(rows(texts), shards=7, bundles=64).collect()
    assert len(found) == len(texts)
    by_text = defaultdict(set)
    sizes = {t: len((t or "").encode()) + 16 for t in
             [x[1] if isinstance(x, tuple) else x for x in texts]}
    for row in found:
        by_text[row.text_crc32].add(row.shard)
        assert row.law == "bytes" and row.grown_shard is None and 0 <= row.shard < 7
    assert all(len(shards) == 1 for shards in by_text.values())
    assert Counter(r.size for r in found) == Counter(
        sizes[x[1] if isinstance(x, tuple) else x] for x in texts)
    assert {r.text_crc32 for r in found} == {zlib.crc32((t or "").encode()) for t in sizes}
    for shard in range(7):
        slots = sorted(r.slot for r in found if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_shard_sizes_are_near_equal(spark, rows):
    found = shard_documents(rows([prose(k, 40 + k % 30) for k in range(1500)]), shards=5)
    loads = [r.s for r in found.groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(loads) == 5 and max(loads) <= 1.01 * min(loads)


def test_shards_equal_a_plain_longest_first(spark, rows):
    texts = [prose(k % 70, 3 + k * 7 % 90) for k in range(160)] + ["copy"] * 40 + [None, "", "x" * 9000]
    sizes = Counter()
    for text in texts:
        sizes[text or ""] += len((text or "").encode()) + 16
    loads = [0] * 6
    for size in sorted(sizes.values(), reverse=True):
        loads[loads.index(min(loads))] += size
    # So many bundles that each group is an item of its own.
    found = shard_documents(rows(texts), shards=6, bundles=1 << 16).groupBy("shard").agg(
        F.sum("size").alias("s")).collect()
    assert sorted(r.s for r in found) == sorted(loads)


def test_longest_first_is_greedy():
    items = [("a", 9), ("b", 7), ("c", 6), ("d", 5), ("e", 4), ("f", 4)]
    place = longest_first(items, 2)
    assert place == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1, "f": 0}


def test_empty_tables(spark, rows):
    none = rows(ODD).limit(0)
    assert shard_documents(none).count() == 0
    assert mark_copies(none).count() == 0
    assert drop_copies(none).columns == none.columns


def brute_copies(texts):
    groups = defaultdict(list)
    for i, text in texts:
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        kept = False
        for i in sorted(ids, key=lambda x: (x is None, x)):
            first = i == keep and not kept
            kept |= first
            out.append((i, keep, len(ids), first, hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("copies", [3, 600])
def test_exact_copies_match_brute_force(spark, rows, copies):
    texts = [prose(k % 50, 8) for k in range(150)] + ["a  hot\ttext"] * copies + ["a hot text"] + ODD
    listed = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    found = mark_copies(rows(texts))
    assert Counter(map(tuple, found.select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == brute_copies(listed)
    assert drop_copies(rows(texts)).count() == len({r[4] for r in brute_copies(listed)})


def test_archives_come_back(spark, tmp_path):
    pages = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", None), (3, None, ""),
             (4, "bad\r\nurl", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"),
             (5, "http://a/5", "<p>x</p>"), (6, "u", "é日本"), (None, "u", "<p>x</p>"),
             (7, "u", "z"), (7, "u", "z")]
    table = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    path = str(tmp_path / "warc")
    warc.write_archives(warc.resolve_revisits(table), path)
    found = warc.read_resolved(spark, path).collect()

    def digest(text):
        return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()

    expected = Counter()
    for page, _, html in pages:
        first = min(p for p, _, h in pages if (h or "") == (html or "") and p is not None)
        again = page != first
        expected[(page, len((html or "").encode()), digest(html),
                  "revisit" if again else "response", first if again else None)] += 1
    assert Counter(map(tuple, found)) == expected
    texts = {int(r.page_id or -1): r.payload for r in warc.read_archives(spark, path).collect()}
    assert bytes(texts[4]).decode() == pages[3][2] and texts[5] is None
    empty = str(tmp_path / "empty")
    warc.write_archives(warc.resolve_revisits(table.limit(0)), empty)
    assert warc.read_resolved(spark, empty).count() == 0
    least = warc.resolve_revisits(table, least_bytes=5)
    assert least.filter("record_type = 'revisit'").count() == 2  # both of <p>x</p>
    assert warc.resolve_revisits(table.limit(0)).count() == 0


def test_archives_of_long_pages_are_cut_by_bytes(spark, tmp_path):
    table = spark.range(40).selectExpr(
        "id as page_id", "'u' as url", "concat(repeat(cast(id as string), 200000), 'x') as html").coalesce(1)
    path = str(tmp_path / "warc")
    warc.write_archives(warc.resolve_revisits(table), path, file_bytes=1 << 20)
    files = list((tmp_path / "warc").glob("*.gz"))
    assert 10 <= len(files) <= 40
    found = {r.page_id: r.payload_bytes for r in warc.read_resolved(spark, path).collect()}
    assert found == {k: 200_000 * len(str(k)) + 1 for k in range(40)}


def test_records_are_read_across_pieces_and_members(monkeypatch):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    bodies = [b"H\r\n\r\n" + bytes([65 + k]) * (k * 37) for k in range(30)]
    packed = [record % (k, len(b), b) for k, b in enumerate(bodies)]
    content = gzip.compress(b"".join(packed[:11])) + gzip.compress(b"".join(packed[11:]))
    for piece in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(warc, "PIECE", piece)
        found = [r[-1] for r in warc._parse(warc._unpacked(content))]
        assert found == [b[5:] for b in bodies]
