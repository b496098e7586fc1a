"""Personal data against the plain patterns, on long texts, and learnt kind by kind."""

import random
import re
import time

import pytest

from adlumen.llm import pii

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    turned = [int(c) for c in digits[::-1]]
    return sum(turned[0::2] + [sum(divmod(2 * d, 10)) for d in turned[1::2]]) % 10 == 0


def brute(text):
    """Leftmost matches of each pattern as it is stated, those that fail their check dropped."""
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True,
                    "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                    "card": lambda: 12 <= len(digits) <= 19 and luhn(digits),
                    "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if good:
                out.append((m.start(), rank, m.end()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_base_spans_are_those_of_the_plain_patterns(seed):
    draw = random.Random(seed)
    parts = ["4111 1111 1111 1111", "4111111111111111", "378282246310005", "+44 20 7946 0958", "+1(2)",
             "10.0.0.1", "256.1.1.1", "1.2.3", "1.2.3.4.5.6.7.8.9", "a@b.co", "x.y+z@d-e.f.g", "@a.b",
             "a@b@c.d", "007.08.9.000255", "+", "-", " ", ".", "é", "0", "12", "999"]
    for _ in range(400):
        text = "".join(draw.choice(parts + list("0123456789.+-() @ab%")) for _ in range(draw.randrange(25)))
        assert pii.base_spans(text) == brute(text)


@pytest.mark.parametrize("text", [
    "1" * 1_000_000, "1." * 500_000, "1.1.1 " * 200_000, "+" + "1(" * 300_000, "a" * 1_000_000 + "@",
    " ".join(f"user{k}@example{k % 9}.org" for k in range(100_000)), "a@" * 300_000, "[ at ] " * 100_000,
    "4111 1111 1111 1111 " * 20_000,
], ids=lambda t: t[:12])
def test_long_texts_take_seconds(text):
    model = {"trees": None, "limits": [2.0] * 4}
    start = time.perf_counter()
    base, added = pii.find_spans(model, text)
    assert time.perf_counter() - start < 20 and added == []
    assert len(base) == {"user0@exampl": 100_000}.get(text[:12], len(base))


def test_covered_finds_every_overlap():
    draw = random.Random(3)
    for _ in range(300):
        spans = sorted((s, 0, s + draw.randrange(1, 12)) for s in draw.choices(range(60), k=draw.randrange(8)))
        covered = pii._Covered(spans)
        for s in range(60):
            for e in (s + 1, s + 5):
                assert covered.meets((s, 1, e)) == any(s < b and a < e for a, _, b in spans)


def test_a_rare_kind_is_learnt(spark, rows):
    draw = random.Random(1)
    words = ["call", "note", "the", "server", "on", "a", "list"]
    texts = [f"{draw.choice(words)} mail {draw.choice(words)}{k}@example.org or section 12/2020-{k} {k % 9}{k % 7} now "
             for k in range(300)]
    texts += [f"host 10.{k}.0.{k + 1} is up, {draw.choice(words)} " for k in range(9)]
    table = rows(texts)
    few = pii.train_on(table, texts=12)
    assert few["trees"] is not None
    # All nine texts with an address are among the sample, though one in thirty has one.
    found = pii.train_on(table, texts=12)
    assert found["limits"] == few["limits"]
    spans = {r.doc_id: r.spans for r in pii.find_personal_data(rows(["x 10[.]1[.]2[.]3 host"]), few).collect()}
    assert set(spans) == {0}


def test_every_text_is_learnt_from(spark, rows, monkeypatch):
    texts = [f"call +44 20 7946 {k % 1000:03d} or section 12/2020-{k}" for k in range(1500)]
    texts += [f"card 4111 1111 1111 1111 or list {k % 97}" for k in range(1500)]
    count = {}
    monkeypatch.setattr(pii, "train", lambda found, **rest: count.update(
        {(r[0], r[1]): r[2] for r in found.groupBy("kind", "label").sum("times").collect()}))
    pii.train_on(rows(texts))
    # Each base span as it stands and in two rewritings, one proposal in each text of the first kind.
    assert count[3, 1] == count[2, 1] == 3 * 1500 and count[3, 0] == 1500


def test_sums_of_parts_grow_the_same_trees(spark, rows):
    draw = random.Random(4)
    texts = [f"mail u{k}@mail.example.com at 10.0.{k}.7 call +1 (555) 010-{1000 + k} version 3.{k} page "
             f"{'9' * draw.randrange(1, 9)} of 12/2020-{k}" for k in range(80)]
    one, parts = (pii.train_on(rows(texts), gathered=n) for n in (10_000, 20))
    for tree, other in zip(one["trees"].trees, parts["trees"].trees, strict=True):
        assert (tree[0] == other[0]).all() and (tree[1] == other[1]).all()
        assert abs(tree[2] - other[2]).max() < 1e-9
    assert one["limits"] == pytest.approx(parts["limits"])
