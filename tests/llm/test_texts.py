"""Operators on what stands in texts, each against brute force or held-out rows."""

import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from adlumen.llm import (
    decontaminate, jaccard_join, pii, piece_codec, suffix_dedup, suffix_tree_lm, toxicity,
)
from adlumen.llm.boosting import Boosted
from adlumen.llm.common import stored
from adlumen.llm.components import components
from adlumen.llm.jaccard_join import keep_one_of_each, link_documents
from adlumen.llm.piece_codec import digests, encode_documents, load
from adlumen.llm.suffix_dedup import remove_repeats
from adlumen.llm.suffix_runs import LoserTree, common, front_coded
from tests.llm.conftest import ODD, prose

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def listed(texts):
    return [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]


# -- pieces ------------------------------------------------------------------

def test_codec_equals_the_library(spark, rows):
    texts = [prose(k, 50) for k in range(20)] + ODD + ["<s> </s> <0x41>", "a.b,c  d\n\n«x».”", "ﬁ Ａ"]
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = Counter((r.doc_id, tuple(r.ids), r.decoded, r.agrees)
                    for r in encode_documents(rows(texts), MODEL).collect())
    expected = Counter()
    for i, text in listed(texts):
        ids = lib.encode(text or "")
        expected[(i, tuple(ids), lib.decode(ids), True)] += 1
    assert found == expected
    one = digests(encode_documents(rows(["ab c"]), MODEL)).first()
    ids = lib.encode("ab c")
    assert one.n_tokens == len(ids)
    assert one.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_heap_and_list_merge_alike():
    pieces = load(MODEL)
    draw = random.Random(5)
    for _ in range(300):
        part = "▁" + "".join(draw.choice("abcdeinorst") for _ in range(draw.randrange(1, 60)))
        one, other = list(part), list(part)
        pieces._merge_listed(one)
        pieces._merge_heaped(other)
        assert one == [s for s in other if s]


def test_parts_merge_side_by_side_as_one_by_one(monkeypatch):
    pieces = piece_codec.PieceModel(MODEL)
    draw = random.Random(6)
    parts = ["\u2581" + "".join(draw.choice("abcdeinorst,.\u00e9\u4e2d") for _ in range(draw.randrange(60)))
             for _ in range(700)] + ["\U0001f9ff\u0378", "x", "\u2581", "aaaaaaa", "\x00a", "a" * 48, "a" * 49]
    draw.shuffle(parts)
    wanted = [array("i", pieces.merge(p)).tobytes() for p in parts]
    monkeypatch.setattr(piece_codec, "ROWS", 64)
    single = []
    merge = pieces.merge
    monkeypatch.setattr(pieces, "merge", lambda part: single.append(part) or merge(part))
    assert pieces.merge_many(parts) == wanted
    assert all(len(p) > piece_codec.LISTED for p in single)
    texts = [prose(k, 300) for k in range(4)]
    single.clear()
    found, agrees = pieces.encode_batch(texts)
    assert [ids.tolist() for ids in found] == pieces.library.encode(texts)
    assert all(agrees) and not single


def test_codec_lets_go_of_parts_not_met_again(monkeypatch):
    monkeypatch.setattr(piece_codec, "KEPT_PARTS", 100)
    pieces = piece_codec.PieceModel(MODEL)
    merged = Counter()
    merge = pieces.merge
    monkeypatch.setattr(pieces, "merge", lambda part: merged.update([part]) or merge(part))
    for batch in range(40):
        text = f"always here {prose(batch, 60)}"
        [ids], [agrees] = pieces.encode_batch([text])
        assert agrees and ids.tolist() == pieces.library.encode(text)
        assert len(pieces.kept) + len(pieces.older) <= 2 * (100 + 62)
    assert merged["\u2581always"] == merged["\u2581here"] == 1


# -- suffixes ----------------------------------------------------------------

def brute_repeats(texts, span):
    data = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(d[p:p + span] for _, d in data for p in range(len(d) - span + 1))
    out = Counter()
    for i, d in data:
        covered = np.zeros(len(d) + 1, int)
        for p in range(len(d) - span + 1):
            if seen[d[p:p + span]] > 1:
                covered[p:p + span] = 1
        kept = bytes(b for b, c in zip(d, covered) if not c)
        spans = int((np.diff(np.r_[0, covered]) == 1).sum())
        out[(i, len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_match_brute_force(spark, rows, seed):
    draw = random.Random(seed)
    shared = ["".join(draw.choice("ab\0") for _ in range(draw.randint(15, 70))) for _ in range(6)]

    def part():
        if draw.random() < 0.6:
            return draw.choice(shared)[draw.randint(0, 8):draw.randint(10, 70)]
        return "".join(draw.choice("abcd") for _ in range(draw.randint(0, 30)))

    texts = ["".join(part() for _ in range(draw.randint(0, 6))) for _ in range(150)] + ODD
    found = remove_repeats(rows(texts), span=20).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, found)) == brute_repeats(listed(texts), 20)
    assert remove_repeats(rows(texts).limit(0), span=20).count() == 0


def test_windows_shown_by_neighbours_are_counted_and_not_joined(spark):
    counted = spark.createDataFrame(
        [(k, 3, "often", k == 7) for k in range(50)] + [(60, 3, "once", True), (61, 4, "often", True)]
        + [(k, 5, "shown", False) for k in range(70, 90)], "pid int, d int, w string, open boolean")
    found = suffix_dedup._found_again(counted)
    assert [r.pid for r in found.collect()] == [7]


def test_windows_that_the_neighbour_before_counts_are_counted_once(spark, rows):
    draw = random.Random(8)
    passage = "".join(draw.choice("abcd") for _ in range(60))
    # Each text ends the passage elsewhere, so that neighbours share all but some windows.
    texts = ["".join(draw.choice("efgh") for _ in range(9)) + passage[k % 7:60 - k % 11]
             + "".join(draw.choice("efgh") for _ in range(9)) for k in range(60)]
    docs = rows(texts).select(F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("h"),
                              F.col("text").alias("t"))
    found = suffix_dedup._anchor_rows(docs, 20, 10)
    wanted = found.select(F.col("id").alias("wid"), F.col("h").alias("wh"), "at", "gram",
                          F.lit(True).alias("own"))
    around = stored(suffix_dedup._surroundings(docs, wanted, 20, 10), "around")
    told = [suffix_dedup._sorted_neighbours(around, 20, 10, way)[0] for way in (True, False)]
    met = suffix_dedup._met_anchors(around, told, 20)
    counted = suffix_dedup._counted(met, met.select(
        "gram", F.explode(F.sequence("span_low", "span_high")).alias("d")).distinct(), 20, 10)
    windows = met.select("pid", F.explode(F.sequence("span_low", "span_high")).alias("d"))
    data = {r.pid: (r.before, r.ahead) for r in around.collect()}
    held = {(r.d, data[r.pid][0][len(data[r.pid][0]) - r.d:] + data[r.pid][1][:20 - r.d])
            for r in windows.collect()}
    kept = counted.collect()
    assert {(r.d, r.w) for r in kept} == {(d, hashlib.sha256(w).hexdigest()) for d, w in held}
    assert len(held) <= len(kept) < windows.count() / 4


def test_loser_tree_merges_and_knows_common_prefixes():
    draw = random.Random(3)
    runs = [sorted({("".join(draw.choice("ab") for _ in range(draw.randint(0, 9))).encode(), k)
                    for _ in range(draw.randint(0, 30))}) for k in range(5)]
    merged = list(LoserTree([front_coded(run) for run in runs]))
    assert sorted((k, i) for k, i, _ in merged) == sorted(sum(runs, []))
    keys = [k for k, _, _ in merged]
    assert keys == sorted(keys)
    assert [s for _, _, s in merged] == [0] * (len(keys) > 0) + [
        common(a, b) for a, b in zip(keys, keys[1:])]


# -- near copies -------------------------------------------------------------

def brute_links(texts):
    sets, names = {}, {}
    for k, (i, text) in enumerate(texts):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets[k] = frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
        names[k] = i
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    members = defaultdict(list)
    for k in sets:
        members[root(k)].append(names[k])
    return Counter((names[k], len(sets[k]), min((n for n in members[root(k)] if n is not None),
                                                 default=None)) for k in sets)


def near_copies(seed, count, words, changes):
    draw = random.Random(seed)
    base = prose(seed, words).split()
    for _ in range(count):
        copy = list(base)
        for _ in range(draw.randrange(changes)):
            copy[draw.randrange(words)] = f"new{draw.randrange(9999)}"
        yield " ".join(copy)


def test_links_match_brute_force(spark, rows):
    passage = prose(77, 40)
    texts = [*near_copies(1, 60, 120, 9), *near_copies(2, 25, 30, 3), *near_copies(3, 30, 60, 6),
             *(f"{prose(200 + k, 30)} {passage} {prose(300 + k, 20)}" for k in range(40)),
             *[prose(5, 20)] * 4, *ODD]
    found = link_documents(rows(texts)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, found)) == brute_links(listed(texts))
    kept = keep_one_of_each(rows(texts))
    assert kept.columns == rows(texts).columns
    assert link_documents(rows(texts).limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 90), (5, 5)],
                                  "a bigint, b bigint")
    found = {r.node: r.component for r in components(chain).collect()}
    assert found == {**{k: 0 for k in range(1, 61)}, 100: 90}


# -- benchmark ---------------------------------------------------------------

def brute_hits(texts, items):
    def words(text):
        lower = "".join(c.lower() if c < "\x80" else c for c in text or "")
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)

    windows = defaultdict(set)
    for name, text in items:
        w = words(text)
        size = min(10, len(w))
        for s in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[s:s + size])].add(str(name))
    out = Counter()
    for i, text in texts:
        w, hit, names = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for s in range(len(w) - size + 1):
                if tuple(w[s:s + size]) in windows:
                    hit |= set(range(s, s + size))
                    names |= windows[tuple(w[s:s + size])]
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out[(i, len(w), len(hit), len(names), digest, bool(hit))] += 1
    return out


def test_contamination_matches_brute_force(spark, rows):
    items = [(k, prose(500 + k, 14)) for k in range(6)] + [
        (10, "short item here"), (11, "One"), (12, None), (13, "..."), (14, prose(500, 14)),
        (15, "É " + prose(7, 12)), (16, "dup dup dup dup dup dup dup dup dup dup dup dup")]
    texts = [prose(k, 30) + " " + " ".join(prose(500 + k % 6, 14).split()[k % 5:][:8 + k % 7]).upper()
             + ", " + prose(k + 50, 9) for k in range(40)]
    texts += ["the short ITEM, here", "one", "É " + prose(7, 12), "é " + prose(7, 12),
              "dup " * 25, prose(500, 14), *ODD]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.find_contamination(rows(texts), bench).collect()
    assert Counter(map(tuple, found)) == brute_hits(listed(texts), items)
    clean = decontaminate.drop_contaminated(rows(texts), bench)
    dirty = sum(n for r, n in brute_hits(listed(texts), items).items() if r[5])
    assert clean.columns == rows(texts).columns and clean.count() == len(texts) - dirty
    none = decontaminate.find_contamination(rows(texts), bench.limit(0))
    assert none.count() == len(texts) and none.filter("contaminated").count() == 0
    assert decontaminate.find_contamination(rows(texts).limit(0), bench).count() == 0


def test_contamination_of_greek_capitals(spark, rows):
    passage = "ΤΕΛΟΣ ΟΔΟΣ ΜΕΡΟΣ ΛΟΓΟΣ ΝΟΜΟΣ ΤΟΠΟΣ ΧΡΟΝΟΣ ΚΟΣΜΟΣ ΑΣ ΦΩΣ ΣΟΦΟΣ Σ"
    items = [(1, passage), (2, "ΤΕΛΟΣ.Επόμενη"), (3, "ΣΑΣ'ΜΑΣ\u0301.İI")]
    texts = [prose(1, 12) + " " + passage.replace(" ", mark) + f" {prose(2, 12)}"
             for mark in ".:'^`_- "]
    texts += ["ΤΕΛΟΣ Επόμενη", "x ΤΕΛΟΣ:Επόμενη y", "ΣΑΣ ΜΑΣ\u0301^İi", "τελος επόμενη", "τελοσ.Επόμενη"]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.find_contamination(rows(texts), bench).collect()
    assert Counter(map(tuple, found)) == brute_hits(listed(texts), items)
    assert sum(r.contaminated for r in found) == 11


# -- models ------------------------------------------------------------------

def test_language_model(spark, rows):
    texts = [prose(k, 40, 30) for k in range(60)] + ODD
    found = suffix_tree_lm.score_documents(rows(texts)).collect()
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in listed(texts)}
    counts, ends = Counter(), 0
    for i, text in listed(texts):
        if not held[i]:
            counts.update((text or "").encode().lower().split())
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    floor = total + 0.1 * (distinct + 1)
    expected = Counter()
    for i, text in listed(texts):
        w = (text or "").encode().lower().split()
        base = sum(math.log10((counts[x] + 0.1) / floor) for x in w) + math.log10((ends + 0.1) / floor)
        expected[(i, held[i], len(w) + 1, sum(counts[x] > 0 for x in w) + 1, total,
                  round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                    round(r.base_score, 6)) for r in found) == expected
    assert all(r.score < 0 for r in found)
    likely = {r.doc_id: r.score for r in found if r.n_tokens == 41}
    assert np.mean(list(likely.values())) / 41 > -4.5  # equal odds over bytes would be below -15
    assert suffix_tree_lm.score_documents(rows(texts).limit(0)).count() == 0


def test_suffix_tree_sums_to_one(spark):
    words = spark.createDataFrame([(bytearray(b"abab"), 50), (bytearray(b"abba"), 30),
                                   (bytearray(b"ba"), 9)], "word binary, times bigint")
    tree = suffix_tree_lm.train(words, 7)
    start = np.full(suffix_tree_lm.SYMBOLS, suffix_tree_lm.START)
    nexts = np.arange(1, suffix_tree_lm.SYMBOLS + 1)
    assert abs(tree._chance(start, nexts, 1).sum() - 1) < 1e-9
    logs = tree.log10_words([b"abab", b"zzzz"])
    assert logs[0] > logs[1]


def test_language_model_hears_the_order_of_words(spark, rows):
    pairs = ["red car", "blue sky", "old man", "big dog"]
    draw = random.Random(5)
    texts = [" ".join(draw.choice(pairs) for _ in range(20)) for _ in range(120)]
    ordered, turned = " ".join(pairs * 5), " ".join(" ".join(p.split()[::-1]) for p in pairs * 5)
    table = rows(texts + [ordered, turned])
    found = {r.doc_id: r for r in suffix_tree_lm.score_documents(table).collect()}
    assert found[120].base_score == pytest.approx(found[121].base_score)
    assert found[120].score > found[121].score + 5


def test_language_model_equals_counting_by_hand(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree_lm, "SLICE", 50)
    draw = random.Random(6)
    texts = ["".join(draw.choice("ab ") for _ in range(draw.randrange(40))) for _ in range(40)] + [""]
    wanted, total = Counter(), Counter()
    for text in texts:
        row = [259, *(257 if c == " " else ord(c) + 1 for c in " ".join(text.split())), 258]
        for k in range(1, len(row)):
            for d in range(min(k, 6) + 1):
                wanted[tuple(row[k - d:k]), row[k]] += 1
                total[tuple(row[k - d:k])] += 1
    table = spark.createDataFrame([(t, 1) for t in texts], "word string, times bigint").repartition(3)
    tree = suffix_tree_lm.train(table, share=0.0, close=suffix_tree_lm.TEXT_END)
    kept = [set(level[0].tolist()) for level in tree.levels]

    def by_hand(text):
        row, out = [259, *(257 if c == " " else ord(c) + 1 for c in text), 258], 0.0
        for k in range(1, len(row)):
            chance = 1 / 258
            for d in range(min(k, 6) + 1):
                context = tuple(row[k - d:k])
                code = sum(s << (9 * i) for i, s in enumerate(reversed(context)))
                if d < len(kept) and code in kept[d]:
                    chance = (wanted[context, row[k]] + 2 * chance) / (total[context] + 2)
            out += math.log10(chance)
        return out

    some = [" ".join(t.split()) for t in texts] + ["ab ba", "c"]
    assert any(257 in (code & 511, code >> 9 & 511) and code >> 18 for code in kept[3])
    assert tree.log10_words([t.encode() for t in some], suffix_tree_lm.TEXT_END) == pytest.approx(
        [by_hand(t) for t in some])


def test_members_are_met_by_the_tokens_fewest_of_them_hold(spark):
    common = [(token, r, 0, 96, 90) for r in range(40) for token in (0, 1, 2, 3, 10 + r % 4)]
    asking = [(token, 100, 100, 96, 90) for token in (0, 1, 2, 3, 10)]
    rows = spark.createDataFrame(common + asking,
                                 "token bigint, r bigint, g bigint, n int, reach int")
    opened = jaccard_join._opened(rows, 75)
    [one] = opened.collect()
    assert (one.r, one.g, one.least, one.hits[0], sorted(one.hits)) == (100, 0, 5, 10, [0, 1, 2, 3, 10])
    found = jaccard_join._candidates(opened, rows, 1, 75).collect()
    assert sorted(map(tuple, found)) == [(100, r) for r in range(0, 40, 4)]


def test_jaccard_join_keeps_no_words_after_a_task(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "KEPT_WORDS", 1 << 30)
    ends = []

    class Local:
        """Runs a task's function here instead of sending it."""

        def select(self, *_):
            return self

        def mapInArrow(self, task, _):
            batch = pa.RecordBatch.from_arrays(
                [pa.array([1, 2]), pa.array([0, 0]), pa.array([prose(1, 40), prose(2, 40)])],
                names=["a", "b", "t"])
            ends.append(sum(part.num_rows for part in task(iter([batch]))))

        @property
        def schema(self):
            return spark.createDataFrame([], "id bigint").schema

        @property
        def sparkSession(self):
            return spark

    jaccard_join._sketches(Local(), 5)
    assert not jaccard_join._hashes
    jaccard_join._prefixes(Local(), np.zeros(0, np.uint64), 5, 75)
    assert not jaccard_join._hashes and min(ends) >= 2


def test_sets_of_many_texts_are_sets_of_shingles():
    texts = [t if isinstance(t, str) else "" for t in ODD] + [
        "A\x0bB\x0cC\r\nD E f\x1cg\x85h\xa0i j", "x" * 64 + " " + "x" * 65 + " y" * 9,
        *near_copies(4, 20, 60, 9)]
    words = [text.encode().lower().split() for text in texts]
    wanted = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    tokens, sizes = jaccard_join.shingle_sets(pa.array(["before", *texts]).slice(1))
    found = [set(part.tolist()) for part in np.split(tokens, np.cumsum(sizes)[:-1])]
    assert sizes.tolist() == list(map(len, found)) == list(map(len, wanted))
    assert [len(a & b) for a in found for b in found] == [len(a & b) for a in wanted for b in wanted]


def test_jaccard_join_looks_at_bounded_slices(monkeypatch):
    monkeypatch.setattr(jaccard_join, "TOGETHER", 4)
    monkeypatch.setattr(jaccard_join, "TOGETHER_BYTES", 100)
    texts = ["x" * n for n in (0, 0, 0, 0, 0, 60, 30, 60, 500, 1, 99, 100, 101, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    parts = [part.column(0).to_pylist() for part in jaccard_join._some(batch, 0)]
    assert sum(parts, []) == texts
    assert all(len(p) <= 4 and (len(p) == 1 or sum(map(len, p)) <= 100) for p in parts)
    assert len(parts) == 8


def test_members_whose_parities_are_too_far_are_not_met(spark):
    rows = spark.createDataFrame([(token, r, 0 if r < 30 else 100, 96, 90) for token in range(5)
                                  for r in [*range(30), 100]],
                                 "token bigint, r bigint, g bigint, n int, reach int")
    opened = spark.createDataFrame([(100, 0, 96, [0, 1, 2, 3, 4], 5)],
                                   "r bigint, g bigint, n int, hits array<bigint>, least int")
    # Sets of 96 that link differ by 26 tokens at most.
    bits = spark.createDataFrame([(100, [0, 0])] + [(r, [(1 << 20) - 1, (1 << r) - 1])
                                                    for r in range(30)],
                                 "r bigint, bits array<bigint>")
    found = jaccard_join._candidates(opened, rows, 1, 75, bits).collect()
    assert sorted(map(tuple, found)) == [(100, r) for r in range(7)]


def test_language_model_lays_a_slice_at_a_time(monkeypatch):
    monkeypatch.setattr(suffix_tree_lm, "SLICE", 50)
    laid, lay = [], suffix_tree_lm._laid
    monkeypatch.setattr(suffix_tree_lm, "_laid", lambda words, close: (
        laid.append(sum(map(len, words))), lay(words, close))[1])
    texts = [prose(k, k % 9) for k in range(60)] + [""] * 9
    batch = pa.RecordBatch.from_arrays(
        [pa.array(texts), pa.array([1 + k % 2 for k in range(69)])], names=["word", "times"])
    found = Counter()
    for part in suffix_tree_lm._counted(suffix_tree_lm.TEXT_END)(iter([batch])):
        found.update(dict(zip(*(column.to_pylist() for column in part.columns))))
    assert sum(found.values()) == sum((len(t) + 1) * (1 + k % 2) for k, t in enumerate(texts))
    assert max(laid) < 50 + max(map(len, texts))


def test_toxicity_on_held_out_rows(spark, rows):
    draw = random.Random(9)
    bad = ["idiot", "moron", "scum", "worthless"]
    texts, marks = [], []
    for k in range(400):
        toxic = k % 4 == 0
        words = prose(k, 40).split()
        if toxic:
            for _ in range(3):
                words.insert(draw.randrange(len(words)), draw.choice(bad))
        texts.append(" ".join(words))
        marks.append((k, int(toxic)))
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    model = toxicity.train_on(rows(texts), labels)
    found = toxicity.with_score(rows(texts + [None, "", "idiiot morron scumm"]), model).collect()
    score = {r.doc_id: r.score for r in found}
    held = [k for k, _ in marks if zlib.crc32(str(k).encode()) % 3 == 1]
    right = [(score[k] >= toxicity.REJECT) == bool(marks[k][1]) for k in held]
    assert sum(right) >= 0.97 * len(right)
    assert all(0 <= s <= 1 for s in score.values()) and score[400] == score[401] < 0.7
    assert score[402] > np.median([score[k] for k, t in marks if not t])
    scored = toxicity.score_documents(rows(ODD), labels)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    assert scored.count() == len(ODD)
    one = toxicity.train(["a b"], [0])
    assert toxicity.with_score(rows(ODD), one).count() == len(ODD)


def test_long_runs_count_to_their_end(spark, rows):
    for size in (1, 39, 40, 41, 44, 45, 76, 77, 5000):
        run = "".join(chr(0x4E00 + k) for k in range(size))
        pieces = toxicity.words_of(run)
        assert all(len(piece) <= 40 for piece in pieces)
        assert {run[k:k + 5] for k in range(size - 4)} == {
            piece[k:k + 5] for piece in pieces for k in range(len(piece) - 4)}
        assert pieces[0][0] == run[0] and pieces[-1][-1] == run[-1]
    texts = [prose(k, 40) + (" idiot moron scum" if k % 4 == 0 else "") for k in range(400)]
    model = toxicity.train(texts, [int(k % 4 == 0) for k in range(400)])
    clean = "_".join(prose(900, 30).split())
    score = {r.doc_id: r.score for r in toxicity.with_score(
        rows([clean, clean + "_idiot_moron_scum_idiot_moron_scum"]), model).collect()}
    assert score[1] > score[0] and score[1] >= toxicity.REJECT > score[0]


def test_training_takes_the_whole_sample_in_parts(spark, rows, monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, shares: taken.append(labels))
    marks = spark.createDataFrame([(k, k % 2) for k in range(4600)], "doc_id bigint, toxic int")
    toxicity.train_on(rows([f"text {k}" for k in range(4600)]), marks)
    assert Counter(taken[0]) == {0: 1500, 1: 1500}
    words = prose(1, 200).split()
    whole = toxicity.Trainer(words)
    monkeypatch.setattr(toxicity, "PART", 7)
    parts = toxicity.Trainer(words)
    windows = np.arange(198)[:, None] + np.arange(3)
    for trainer in (whole, parts):
        trainer.fit(windows, np.arange(198) % 2, np.ones(198), rounds=3)
    assert (whole.ids == parts.ids).all()
    assert np.allclose(whole.scores(windows), parts.scores(windows), atol=1e-3)


@pytest.mark.parametrize("size", [0, 1, 2, 3, 4, 5, 6, 7, 40, 41])
def test_training_windows_hold_every_word(size):
    windows, owner = toxicity._windows([np.arange(size), np.arange(5)])
    assert set(windows[owner == 0].ravel()) - {-1} == set(range(size))
    assert len(np.unique(windows[owner == 0], axis=0)) == (owner == 0).sum()


# -- personal data -----------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


@pytest.mark.parametrize("text", [
    "a@b.c d@e.f@g.h", "@@a@b.c", "x@y.z.@q.r", "a" * 3000 + "@", "a.b@c.d-e.f.", "ü@b.c x@y"])
def test_emails_as_a_leftmost_search(text):
    assert list(pii._emails(text)) == [m.span() for m in EMAIL.finditer(text)]


def test_base_spans():
    text = ("mail x.y@b.co, ip 10.0.255.1 not 10.0.256.1, card 4111 1111-1111 1111 not "
            "4111111111111112, +1 (555) 010-9999 or +12")
    found = [(pii.KINDS[k], text[s:e]) for s, k, e in pii.base_spans(text)]
    assert found == [("email", "x.y@b.co"), ("ip", "10.0.255.1"), ("card", "4111 1111-1111 1111"),
                     ("phone", "+1 (555) 010-9999")]
    assert pii.base_spans("1" * 6000 + ".1.1.1") == []


@pytest.mark.parametrize("part, held", [
    ("0" * 120 + "5", True), ("0" * 97 + "255", True), ("0" * 200, True), ("0" * 120 + "256", False),
    ("9" * 120, False), ("0" * 5000 + "1000", False)])
def test_leading_zeros_of_an_ip(part, held):
    text = f"at 10.0.{part}.7 now"
    spans = [(s, e) for s, k, e in pii.base_spans(text) if k == 1]
    assert spans == ([(3, len(text) - 4)] if held else [])


def test_personal_data_is_found_and_redacted(spark, rows):
    texts = [f"{prose(k, 6)} call +1 (555) 010-{1000 + k} or mail u{k}@mail.example.com at "
             f"10.0.{k}.7 version 3.{k} page {k} of 12/2020-{k}" for k in range(60)]
    texts += ["write u7 (at) mail (dot) example (dot) com now", *ODD]
    table = rows(texts)
    found = {r.doc_id: r for r in pii.digests(pii.find_personal_data(table)).collect()
             if r.doc_id is not None}
    assert (found[3].n_email, found[3].n_phone, found[3].n_ip) == (1, 1, 1)
    spans = pii.written(pii.base_spans(texts[3]))
    assert found[3].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    assert set(spans.split(",")) <= set(found[3].spans.split(","))
    assert found[60].n_email == 0 and found[60].n_added == 1
    clean = pii.redact(table, pii.train_on(table))
    assert clean.columns == table.columns
    one = {r.doc_id: r.text for r in clean.collect()}
    assert "[EMAIL]" in one[3] and "@" not in one[3] and one[61] is None
    assert pii.find_personal_data(table.limit(0)).count() == 0


def test_boosted_trees_learn_a_rule():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(800, 5))
    y = ((x[:, 0] > 0) & (x[:, 3] < 0.5)).astype(float)
    trees = Boosted().fit(x[:500], y[:500])
    assert ((trees.chance(x[500:]) > 0.5) == (y[500:] > 0)).mean() > 0.95
