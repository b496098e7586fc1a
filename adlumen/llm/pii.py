"""Personal data by candidates and gradient boosting.

Base spans follow fixed patterns and checks and always stay. High-recall
generators propose further, overlapping spans: numbers in groups, dotted numbers,
anything around an at sign, spelt-out addresses. Boosted trees judge them by format and context, never by the checks themselves, and
thresholds calibrated per kind select those to add.

There are no labels for personal data, so the trees learn from base spans: as they
stand, and rewritten in the ways people write them (no plus sign, other
separators, spelt-out signs). Proposals that touch no base span and spell no sign
out are the other class.
"""

from __future__ import annotations

import functools
import pickle
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlumen.llm.boosting import BINS, LEVELS, Boosted, Examples, cuts_of, in_bins, lowest_sure
from adlumen.llm.common import forget, stored, text_of

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A search from the middle of a run finds nothing that one from its start does not, so runs
# are entered at their start only and taken whole: long ones cost no more than they are long.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_SIGNS = re.compile(r"[0-9@]|[\[({]\s*at\s*[\])}]", re.I)

_SPELT = re.compile(r"[\[({]\s*(?:at|dot|\.)\s*[\])}]", re.I)

# High-recall generators; a span may be proposed by several. None begins or ends within a run.
_PROPOSE = [
    ("phone", re.compile(r"(?<![0-9])[+(]{0,2}[0-9][0-9()./ -]{5,28}[0-9](?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9](?:[ ./-]?[0-9]){11,20}(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9])[0-9]{1,3}(?:\s?[.\[\]()]{1,3}\s?[0-9]{1,3}){3}(?![0-9])")),
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}\s?(?:@|[\[({]\s*at\s*[\])}])\s?[\w-]{1,64}"
                         r"(?:\s?(?:\.|[\[({]\s*dot\s*[\])}])\s?[\w-]{1,32}){1,4}", re.I)),
]
_WORDS = [re.compile(w, re.I) for w in (
    "phone|tel|call|fax|mobile|whatsapp", "mail|contact|write", "card|visa|credit|pay|iban",
    r"\bip\b|host|server|addr", "version|licen[cs]e|section|chapter|page|public")]
# Distinct examples up to which the trees grow in the driver; beyond, parts of this many add up
# their sums as tasks.
GATHERED = 200_000
# Cells of log odds, this many to one, in which thresholds are looked for.
CELLS = 1000
# What a text must hold for a base span of the kind to be possible; found by Spark.
_HINTS = {"email": "@[A-Za-z0-9-]+\\.", "ip": "[0-9]\\.[0-9]+\\.[0-9]+\\.[0-9]",
          "card": "[0-9](?:[ -]?[0-9]){11}", "phone": "\\+[0-9][ ().0-9-]{6}"}
PRECISION = 0.98


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As a leftmost search would, but from each at sign, so that long words cost no more."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = after + len(text[after:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        # What lies before this sign can belong to no later match.
        after = domain.end() if domain else at + 1
        at = text.find("@", after)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order; matches that fail a check are dropped."""
    if not _SIGNS.search(text):
        return []
    found = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(q) <= 3 and int(q or "0") <= 255 for q in parts):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all generators; spans overlap."""
    if not _SIGNS.search(text):
        return []
    return [(m.start(), KINDS.index(kind), m.end())
            for kind, pattern in _PROPOSE for m in pattern.finditer(text)]


def features(text: str, span: tuple[int, int, int]) -> list[float]:
    """Format of a span and what stands around it."""
    start, kind, end = span
    own, before, after = text[start:end], text[max(0, start - 24):start], text[end:end + 12]
    digits = sum(map(str.isdigit, own))
    groups = [len(g) for g in re.findall(r"[0-9]+", own)] or [0]
    return [
        kind, len(own), digits, sum(map(str.isalpha, own)), len(groups), max(groups), min(groups),
        groups[0], groups[-1], own.count("."), own.count("-"), own.count(" "), own.count("("),
        own.count("/"), own.startswith("+"), "@" in own, "[" in own or "{" in own,
        len(set(own)) / len(own), groups[0] <= 3 and max(groups) <= 3,
        before[-1:].isalnum(), before[-1:] in {"=", '"', "'", "."}, after[:1].isalnum(),
        after[:1] in {'"', "'", "."}, before[-1:].isspace() or not before,
        *(bool(w.search(before)) for w in _WORDS),
    ]


WIDTH = len(features("0", (0, 0, 1)))


class _Covered:
    """Spans that others are held against, in order of their start."""

    def __init__(self, spans: list[tuple]) -> None:
        self.starts = [s for s, _, _ in spans]
        # The furthest end among the spans that begin no later.
        self.ends = list(accumulate((e for _, _, e in spans), max))

    def meets(self, span: tuple) -> bool:
        before = bisect_left(self.starts, span[2])
        return before > 0 and self.ends[before - 1] > span[0]

    def add(self, span: tuple) -> None:
        """A span that meets none of the others."""
        at = bisect_left(self.starts, span[0])
        self.starts.insert(at, span[0])
        self.ends.insert(at, span[2])


def _rewritten(text: str, span: tuple[int, int, int], draw: random.Random) -> tuple[str, tuple]:
    """The text with the span written in another usual way, and its new place."""
    start, kind, end = span
    own = text[start:end]
    if kind == 0:
        own = own.replace("@", draw.choice(["@", " [at] ", "(at)", " (at) "]))
        if draw.random() < 0.5:
            own = own.replace(".", draw.choice([".", " [dot] ", "(dot)"]))
    elif kind == 1:
        own = own.replace(".", draw.choice([".", "[.]"]))
    elif kind == 2:
        digits = _NOT_DIGIT.sub("", own)
        own = draw.choice(["", " ", "-", "."]).join(
            digits[i:i + 4] for i in range(0, len(digits), 4))
    else:
        groups = re.findall("[0-9]+", own)[draw.randrange(2):]
        own = draw.choice([" ", "-", ".", "/"]).join(groups)
        if draw.random() < 0.3 and len(groups) > 1:
            own = f"({groups[0]}) " + draw.choice([" ", "-"]).join(groups[1:])
    return text[:start] + own + text[end:], (start, kind, start + len(own))


def examples(text: str) -> list[tuple[int, int, list[float]]]:
    """(kind, label, features) a text has for training."""
    base, out = base_spans(text), []
    draw = random.Random(len(text))
    for span in base:
        out.append((span[1], 1, features(text, span)))
        for _ in range(2):
            near = text[max(0, span[0] - 60):span[2] + 60]
            at = span[0] - max(0, span[0] - 60)
            other, place = _rewritten(near, (at, span[1], at + span[2] - span[0]), draw)
            out.append((span[1], 1, features(other, place)))
    covered = _Covered(base)
    # What is spelt out has no base form and may well be true: it stands for neither class.
    out += [(s[1], 0, features(text, s)) for s in proposals(text)
            if not covered.meets(s) and not _SPELT.search(text, s[0], s[2])]
    return out


def _examples(frame: pd.DataFrame) -> Examples:
    bins = np.frombuffer(b"".join(frame["bins"]), np.uint8).reshape(len(frame), -1)
    return Examples(bins, frame["label"].to_numpy(float), frame["times"].to_numpy(float))


def _sums_of(rows: DataFrame) -> Callable:
    """The sums of ``Examples.sums`` over rows that stay where they are, a part of them per task."""
    def sums(trees: Boosted, tree: tuple, level: int) -> np.ndarray:
        def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = sum(_examples(frame).sums(trees, tree, level) for frame in frames if len(frame))
            if not np.isscalar(total):
                yield pd.DataFrame({"sums": [total.tobytes()]})

        found = rows.mapInPandas(added, "sums binary").collect()
        return sum(np.frombuffer(r["sums"]) for r in found).reshape(2, 2 ** level, WIDTH, BINS)

    return sums


def _by_cell(trees: Boosted) -> Callable:
    """Examples by kind and cell of their log odds, and how many of them are true."""
    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                raw = np.clip(_examples(frame).raw(trees), -30, 30)
                yield pd.DataFrame({
                    "kind": frame["kind"], "cell": np.floor(raw * CELLS).astype(np.int64),
                    "known": frame["label"] * frame["times"], "times": frame["times"],
                }).groupby(["kind", "cell"], as_index=False).sum()

    return cells


def train(found: DataFrame, precision: float = PRECISION, gathered: int = GATHERED) -> dict:
    """Trees over (kind, label, part, x, times) and a threshold per kind, set on a third of the texts.

    All that comes from one text has one ``part`` of three, so no rewriting of a
    span is judged by trees that learnt from the span itself. Every row counts.
    Quantiles, sums and thresholds are Spark's; what is beyond ``gathered``
    different rows once in bins stays in parts, and only sums reach the driver.
    """
    out = F.col("part") == 0
    tally = found.groupBy(out.alias("out"), "label").agg(F.sum("times").alias("n")).collect()
    count = {(r["out"], r["label"]): r["n"] for r in tally}
    if len({label for _, label in count}) < 2:
        return {"trees": None, "limits": [2.0] * len(KINDS)}
    whole = len({label for held, label in count if not held}) < 2
    learnt, asked = (F.lit(True), F.lit(True)) if whole else (~out, out)
    if not any(held for held, _ in count):
        asked = learnt
    levels = F.array(*map(F.lit, LEVELS.tolist()))
    quantiles = found.filter(learnt).agg(*[
        F.percentile(F.col("x")[k], levels, F.col("times")).alias(f"x{k}") for k in range(WIDTH)])
    cuts = cuts_of(np.array(quantiles.first(), float))

    def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                bins = in_bins(np.array(frame["x"].tolist(), float), cuts)
                yield frame.drop(columns="x").assign(bins=[row.tobytes() for row in bins])

    rows = found.select("kind", "label", "part", "times", "x").mapInPandas(
        binned, "kind int, label int, part int, times bigint, bins binary")
    rows = stored(rows.groupBy("kind", "label", out.cast("int").alias("part"), "bins").agg(
        F.sum("times").alias("times")).withColumn("part", 1 - F.col("part")), "spans")
    some = rows.filter(learnt)
    number = some.count()
    mean = sum(n for (held, label), n in count.items() if label and (whole or not held)) / sum(
        n for (held, _), n in count.items() if whole or not held)
    sums = (_examples(some.toPandas()).sums if number <= gathered
            else _sums_of(some.coalesce(-(-number // gathered))))
    trees = Boosted().fit_sums(WIDTH, mean, sums)
    cells = rows.filter(asked).mapInPandas(
        _by_cell(trees), "kind int, cell bigint, known bigint, times bigint"
    ).groupBy("kind", "cell").agg(F.sum("known").alias("known"), F.sum("times").alias("times"))
    sure = cells.orderBy("kind", "cell").toPandas()
    forget(rows)
    chance = 1 / (1 + np.exp(-(sure["cell"].to_numpy(float) + 0.5) / CELLS))
    limits = []
    for kind in range(len(KINDS)):
        own = (sure["kind"] == kind).to_numpy()
        limits.append(max(0.5, lowest_sure(
            chance[own], sure["known"].to_numpy(float)[own], precision,
            times=sure["times"].to_numpy(float)[own])))
    return {"trees": trees.of_values(cuts), "limits": limits}


def find_spans(model: dict, text: str) -> tuple[list[tuple], list[tuple]]:
    """Base spans, and what the trees add: the surest first, none over another."""
    base = base_spans(text)
    added: list[tuple] = []
    covered = _Covered(base)
    rest = [s for s in proposals(text) if not covered.meets(s)]
    if rest and model["trees"] is not None:
        chance = model["trees"].chance(np.array([features(text, s) for s in rest], float))
        taken = _Covered([])
        for k in np.argsort(-chance, kind="stable"):
            if chance[k] >= model["limits"][rest[k][1]] and not taken.meets(rest[k]):
                added.append(rest[k])
                taken.add(rest[k])
    return base, added


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def train_on(docs: DataFrame, texts: int | None = None, id_column: str = "doc_id",
             text_column: str = "text", gathered: int = GATHERED) -> dict:
    """A model from all examples of all whole texts.

    Equal examples are counted where they are found and then over all tasks.
    A caller may bound what is learnt from: with ``texts``, for each kind that many
    texts that may hold it, in hash order, and as many that hold no kind.
    """
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("t"))
    if texts is not None:
        rows = _some(rows, texts)

    def taken(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def flush() -> pd.DataFrame:
            listed = [(*key, n) for key, n in seen.items()]
            seen.clear()
            return pd.DataFrame(listed, columns=["kind", "label", "part", "x", "times"])

        for frame in frames:
            for t in frame["t"]:
                part = zlib.crc32(t.encode("utf-8", "surrogatepass")) % 3
                seen.update((kind, label, part, tuple(map(float, x)))
                            for kind, label, x in examples(t))
                if len(seen) > 50_000:
                    yield flush()
        if seen:
            yield flush()

    found = rows.select("t").mapInPandas(
        taken, "kind int, label int, part int, x array<double>, times bigint")
    found = stored(found.groupBy("kind", "label", "part", "x").agg(F.sum("times").alias("times")),
                   "examples")
    model = train(found, gathered=gathered)
    forget(found)
    return model


def _some(rows: DataFrame, texts: int) -> DataFrame:
    """The rows of up to ``texts`` texts for each kind, and of as many that hold none."""
    kinds = F.array_compact(F.array(*[F.when(F.col("t").rlike(hint), F.lit(kind))
                                      for kind, hint in _HINTS.items()]))
    asked = F.when(F.size(kinds) > 0, kinds).when(F.col("t").rlike("[0-9@]"), F.array(F.lit("")))
    known = rows.filter("id is not null").select("id", F.explode(asked).alias("kind")).distinct()
    first = Window.partitionBy("kind").orderBy(F.xxhash64("id"), "id")
    chosen = known.withColumn("place", F.row_number().over(first)).filter(
        F.col("place") <= texts).select("id").distinct()
    return rows.join(F.broadcast(chosen), "id")


@functools.lru_cache(maxsize=1)
def _loaded(packed: bytes) -> dict:
    return pickle.loads(packed)


def find_personal_data(docs: DataFrame, model: dict | None = None, id_column: str = "doc_id",
                       text_column: str = "text") -> DataFrame:
    """Every row with ``base`` and ``added`` spans as arrays of (kind, start, stop), and ``spans``.

    Offsets are code points, the end exclusive. Null texts are empty and have no
    spans. Repeated rows each get the answer. A table without base spans or
    without other proposals trains nothing and gets base spans only. Other
    columns are ignored.
    """
    model = train_on(docs, id_column=id_column, text_column=text_column) if model is None else model
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    span = "array<struct<kind:string,start:int,stop:int>>"

    @F.pandas_udf(f"base {span}, added {span}, base_text string, spans string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = _loaded(sent.value)
        for texts in batches:
            out = []
            for text in texts:
                base, added = find_spans(own, text)
                listed = [[{"kind": KINDS[k], "start": s, "stop": e} for s, k, e in sorted(spans)]
                          for spans in (base, added)]
                out.append((*listed, written(base), written(base + added)))
            yield pd.DataFrame(out, columns=["base", "added", "base_text", "spans"])

    rows = docs.select(F.col(id_column), found(text_of(text_column)).alias("found"))
    return rows.select(id_column, "found.*")


def redact(docs: DataFrame, model: dict, text_column: str = "text") -> DataFrame:
    """Every row with all its columns, each span in ``text_column`` replaced by its kind."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _loaded(sent.value)
        for texts in batches:
            yield pd.Series([_without(own, t) for t in texts], index=texts.index)

    text = F.col(text_column)
    return docs.withColumn(text_column, F.when(text.isNotNull(), cleaned(text_of(text_column))))


def _without(model: dict, text: str) -> str:
    base, added = find_spans(model, text)
    out, at = [], 0
    for start, kind, end in sorted(base + added):
        if end > at:
            out += [text[at:max(at, start)], f"[{KINDS[kind].upper()}]" if start >= at else ""]
            at = end
    return "".join([*out, text[at:]])


def digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, digest of base spans, and all spans as text."""
    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        id_column, *(count(kind).alias(f"n_{kind}") for kind in KINDS),
        F.sha2("base_text", 256).alias("base_sha256"), "spans",
        F.size("added").cast("bigint").alias("n_added"))
