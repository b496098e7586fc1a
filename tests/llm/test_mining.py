"""Quality rules, hard negatives and phrases against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from adlumen.llm import collocations, cover_tree
from adlumen.llm.collocations import best_phrases, mine_phrases, tile_counts
from adlumen.llm.hard_negatives import mine_hard_negatives
from adlumen.llm.quality_rules import apply_rules, compression_verdict, repeated_words
from tests.llm.conftest import ODD, prose

ANY_WORD = "[^\x20\x09-\x0d]+"


def brute_rules(text):
    text = text or ""
    words = re.findall(ANY_WORD, text)
    seen = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    twice = {p for i in range(len(words) - 4) if seen[tuple(words[i:i + 5])] > 1
             for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(ANY_WORD, x)]
    again = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 10 or 100 * len(twice) > 20 * len(words)
    return (len(words), len("".join(words)), len(re.findall("[#*$%&|<>]", text)), again,
            len(twice), failed)


def noise(seed, length):
    draw = random.Random(seed)
    return "".join(draw.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/ ")
                   for _ in range(length))


def test_rules_match_brute_force(spark, rows):
    draw = random.Random(5)
    texts = [prose(k, 5 + 7 * k % 300, 1 + k % 9) for k in range(60)] + ODD + [
        "a a a a a", "a a a a a a", "a b c d e a b c d e", "x\nx\n\n \n y\nx\n y", "# * $%&|<> #",
        "\n".join(draw.choice(["same line of words", "another one", "", "  "]) for _ in range(50))]
    listed = [x[1] if isinstance(x, tuple) else x for x in texts]
    found = apply_rules(rows(texts)).collect()
    assert Counter(tuple(r)[1:7] for r in found) == Counter(map(brute_rules, listed))
    assert all(not r.kept for r in found if r.base_failed)
    assert apply_rules(rows(texts).limit(0)).count() == 0


@pytest.mark.parametrize("window", [1, 2, 3, 5, 8])
def test_repeated_words_of_any_window(window):
    draw = random.Random(window)
    for _ in range(40):
        words = [draw.choice("abc") for _ in range(draw.randrange(60))]
        seen = Counter(tuple(words[i:i + window]) for i in range(len(words) - window + 1))
        expected = {p for i in range(len(words) - window + 1)
                    if seen[tuple(words[i:i + window])] > 1 for p in range(i, i + window)}
        assert repeated_words(words, window) == len(expected)


def test_bands_by_length_and_chunk(spark, rows):
    plain = " ".join(prose(k, 40, 10**6) for k in range(60))
    cases = {"plain": plain, "short": plain[:300],
             "spam": " ".join(f"buy {k % 3} now and {k} more" for k in range(3000)),
             "noise": noise(1, 30_000),
             # Neither the whole nor most of it is out of band, but a good part is.
             "mixed": plain + " " + " ".join(noise(k, 3000) for k in range(4)),
             "spot": plain * 1 + " " + noise(9, 500)}
    found = {r.doc_id: r for r in apply_rules(rows(list(cases.values()))).collect()}
    verdicts = dict(zip(cases, (found[k].reason for k in range(len(cases)))))
    assert verdicts["plain"] is None and verdicts["short"] is None and verdicts["spot"] is None
    assert verdicts["spam"] in ("repetitive", "base") and verdicts["noise"] == "incompressible"
    assert verdicts["mixed"] in ("chunks", "incompressible")
    data = plain.encode()
    whole, chunks, bad, reason = compression_verdict(data, chunk=1000)
    assert chunks == math.ceil(len(data) / 1000) and reason is None
    assert whole == len(zstandard.ZstdCompressor(level=3).compress(data)) / len(data)
    assert compression_verdict(b"")[1:] == (0, 0, None)


def test_rules_on_a_text_of_megabytes(spark, rows):
    long = " ".join(f"w{k * 7919 % 100_003}" for k in range(600_000))
    [found] = apply_rules(rows([long])).collect()
    assert found.n_words == 600_000 and found.n_bytes == len(long)
    assert found.n_repeat_words > 599_000 and found.base_failed


# -- phrases ------------------------------------------------------------------

def brute_phrases(texts, least, longest, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in texts:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                for at in range(len(words) - size + 1):
                    counts[lang or "und"][tuple(words[at:at + size])] += 1
    out = set()
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for phrase, a in candidates.items():
            if any(100 * b >= 80 * a and len(q) > len(phrase)
                   and any(q[i:i + len(phrase)] == phrase for i in range(len(q)))
                   for q, b in candidates.items()):
                continue
            cuts = [(2_000_000 * a // (f[phrase[:k]] + f[phrase[k:]]), k)
                    for k in range(1, len(phrase))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


@pytest.mark.parametrize("tile,block", [(1024, 10**6), (3, 200)])
def test_phrases_match_brute_force(spark, tile, block):
    draw = random.Random(tile)
    vocabulary = ["A", "the", "Of", "é", "日本", "new", "york", "x1", "x2", "-", " "]
    marks = [" ", "  ", "\t", ". ", ", ", "\n", "!"]
    texts = [(("".join(draw.choice(vocabulary[: 4 + k % 8]) + draw.choice(marks[: 3 + k % 5])
                       for _ in range(draw.randrange(120)))), [None, "en", "de", "und"][k % 4])
             for k in range(80)]
    texts += [(None, "en"), ("", None), ("...", "de"), ("New York City. " * 40, "en"),
              ("New York City. " * 40, "en"), ("only", "xx")]
    table = spark.createDataFrame([(t, g, "x", 1, 2) for t, g in texts],
                                  "text string, lang string, block string, n int, a int").repartition(3)
    found = best_phrases(mine_phrases(table, least=8, tile=tile, block_words=block), top=25)
    assert {tuple(r) for r in found.collect()} == brute_phrases(texts, 8, 4, 25)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert best_phrases(mine_phrases(table.limit(0))).count() == 0


def test_tiles_count_like_a_counter():
    draw = np.random.default_rng(3)
    codes = np.minimum(draw.zipf(1.3, 20_000), 90).astype(np.int32)
    codes[::17] = 0
    pairs = Counter((int(a), int(b)) for a, b in zip(codes, codes[1:]) if a and b)
    for tile in (1, 8, 64, 4096):
        keys, counts = tile_counts(codes, tile)
        assert (np.diff(keys) > 0).all()
        assert {(k >> 32, k & 0xFFFFFFFF): n for k, n in zip(keys.tolist(), counts.tolist())} == pairs
    assert len(tile_counts(np.zeros(5, np.int32))[0]) == 0


def test_pairs_are_answered_in_packed_rows_without_a_join(spark, monkeypatch):
    monkeypatch.setattr(collocations, "HELD_PAIRS", 40)
    draw = random.Random(3)
    rows = [(block, "ab"[block % 2], np.array([draw.randrange(9) for _ in range(60)], np.int32))
            for block in (1, 2, 3, 3)] + [(4, "none", np.array([1, 2, 3], np.int32))]
    codes = spark.createDataFrame([(b, lang, bytearray(c.tobytes())) for b, lang, c in rows],
                                  "block long, lang string, codes binary")
    ranks = {(lang, x << 32 | y): 1 + x * 9 + y + 100 * (lang == "b")
             for lang in "ab" for x in range(1, 9) for y in range(1, 9) if (x + y) % 3}
    pairs = spark.createDataFrame([(*k, r) for k, r in ranks.items()],
                                  "lang string, key long, rank long")
    answers = collocations._pair_answers(codes, pairs, 5)
    assert "Join" not in answers._jdf.queryExecution().executedPlan().toString()
    found = {(r.asker, k, n) for r in answers.collect()
             for k, n in zip(np.frombuffer(r["keys"], np.int64).tolist(),
                             np.frombuffer(r.ranks, np.int32).tolist())}
    assert found == {(b, k, ranks[lang, k]) for b, lang, c in rows
                     for k in (c[:-1].astype(np.int64) << 32 | c[1:]).tolist() if (lang, k) in ranks}
    assert answers.count() <= 5 * 6


def test_blocks_hold_whole_texts_and_stay_small(spark):
    texts = spark.createDataFrame([("a b c d e " * 30, f"l{k % 7}") for k in range(70)],
                                  "text string, lang string").coalesce(1)
    blocks = texts.select("lang", "text").mapInArrow(
        collocations._tokenised(300), collocations._BLOCKS).collect()
    last = [b for b in blocks if b.words is not None]
    assert sum(sum(b.counts) for b in last) == 70 * 150
    assert len({b.block for b in last}) == len(last)
    assert all(len(b.codes) <= 4 * (300 + 160) for b in blocks)
    parts = texts.select("lang", "text").mapInArrow(
        collocations._tokenised(10**6, 200), collocations._BLOCKS).collect()
    assert len({b.block for b in parts}) == 7 < len(parts)
    assert sum(sum(b.counts) for b in parts if b.words is not None) == 70 * 150
    assert all(len(b.codes) <= 4 * (200 + 160) for b in parts)


# -- hard negatives -----------------------------------------------------------

def brute_negatives(data):
    rows = []
    for i, vector, label, *_ in data:
        if i is None or label is None or vector is None or any(
                x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        rows.append((i, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    out = Counter()
    for i, v, label in rows:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in rows)
        positives = [(-s, j) for s, j, other in scored if other == label and j != i][:5]
        for p, j in positives:
            inside = [(-s, k) for s, k, other in scored
                      if other != label and 30 * p <= -100 * s <= 90 * p][:10]
            for rank, (s, k) in enumerate(inside, 1):
                out[(i, j, rank, k, p, s)] += 1
    return out


VECTORS = "vec_id long, embedding array<float>, label int, id int, score int"


def vectors(seed, count, clusters):
    """Unit vectors, half of them near copies of a few; ties, and rows that take no part."""
    draw = np.random.default_rng(seed)
    centers = draw.normal(size=(clusters, 8))
    data = []
    for i in range(count):
        v = draw.normal(size=8)
        if i % 2:
            v = centers[i % clusters] + 0.05 * draw.normal(size=8)
        v = v / np.linalg.norm(v)
        data.append((i, [float(x) for x in v], int(i % clusters % 4), 1, 2))
    data[3] = (3, None, 1, 1, 2)
    data[5] = (5, [1.0, None] + [0.0] * 6, 1, 1, 2)
    data[8] = (8, [float("nan")] * 8, 1, 1, 2)
    data[9] = (9, [float("inf")] * 8, 1, 1, 2)
    data[10] = (10, data[11][1], None, 1, 2)
    data += [(None, data[1][1], 1, 1, 2), (count + 50, data[100][1], 2, 1, 2),
             (count + 51, data[100][1], 2, 1, 2), (count + 52, [0.0] * 8, 0, 1, 2),
             (count + 53, data[20][1], 3, 1, 2), (count + 53, data[20][1], 3, 1, 2)]
    return data


@pytest.mark.parametrize("block,size", [(2048, 8192), (40, 2)])
def test_negatives_match_brute_force(spark, block, size):
    data = vectors(block, 700, 12)
    table = spark.createDataFrame(data, VECTORS).repartition(3)
    found = mine_hard_negatives(table, block_rows=block, slice_rows=size)
    assert Counter(map(tuple, found.collect())) == brute_negatives(data)
    assert mine_hard_negatives(table.limit(0)).count() == 0


def test_negatives_of_huge_and_uneven_vectors(spark):
    data = [(0, [3e30, 1.0], 1, 0, 0), (1, [2.0], 1, 0, 0), (2, [], 2, 0, 0), (3, [1e9, 1e9], 2, 0, 0),
            (100, [1e9], 3, 0, 0), (101, [1e9], 3, 0, 0), (102, [5e8], 4, 0, 0)]
    found = {tuple(r) for r in mine_hard_negatives(spark.createDataFrame(data, VECTORS)).collect()}
    one, half = 256 * 10**9, 128 * 10**9
    assert all(-(1 << 63) <= r[5] < 1 << 63 for r in found)
    assert one * half > 1 << 63 and {r[0] for r in found} <= {0, 100}


def test_cover_tree_balls_hold_their_rows_and_prune():
    draw = np.random.default_rng(1)
    centers = 100 * draw.normal(size=(20, 6))
    rows = np.floor(np.repeat(centers, 40, axis=0) + draw.normal(size=(800, 6)))
    tree = cover_tree.build(np.arange(800), rows)
    extra = np.sqrt((rows ** 2).sum(axis=1).max() - (tree.vectors ** 2).sum(axis=1))
    full = np.column_stack([tree.vectors, extra])
    for n in range(len(tree.center)):
        apart = np.linalg.norm(full[tree.start[n]:tree.end[n]] - full[tree.center[n]], axis=1)
        assert apart.max() <= tree.radius[n]
        if tree.parent[n] >= 0:
            assert tree.radius[n] <= tree.radius[tree.parent[n]] / 2 + 1
    assert sorted(tree.ids.tolist()) == list(range(800))
    query = rows[:1]
    scores = (rows @ query[0]).astype(int)
    low, high = np.sort(scores)[[-60, -30]]
    best = cover_tree.Best(np.array([0]), np.array([low]), np.array([high]), 10)
    verified = cover_tree.search(tree, query, np.array([0]), best, False)
    expected = sorted((-s, i) for i, s in enumerate(scores) if low <= s <= high)[:10]
    assert [(-s, i) for s, i in zip(best.score, best.id)] == expected
    assert verified < 400
