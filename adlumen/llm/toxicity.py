"""Toxicity by subword-bag embeddings under a linear softmax.

A word is the bag of its character n-grams (hashed) and of itself; the
embeddings of a bag are averaged and go through a linear softmax. Embeddings
and softmax are trained together in numpy. A misspelt word shares most n-grams
with the word it stands for. A few words make a long text toxic, so the bags are
windows of a few words: training picks in each labelled text the window that
scores highest (in clean texts, several), and a text scores as its worst window
does. The score is calibrated on labelled texts kept out of training.
"""

from __future__ import annotations

import functools
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlumen.llm.common import text_of

BUCKETS = 1 << 16
SIZE = 8
WINDOW = 3
# Labelled texts per class that training may use: a bounded sample in hash order.
SAMPLE = 1500
# Of their windows, the most that the first fit draws, and the clean ones that each later fit
# draws besides every text's worst. Bounds of the sample of labelled rows too: how much a model
# of this size learns from, whatever the corpus. Scoring looks at all windows of all texts.
FIRST_WINDOWS, CLEAN_WINDOWS = 40_000, 4_000
REJECT = 0.7
_WORD = re.compile(r"\w+")
KEPT_WORDS = 500_000
PIECE, SHARED = 40, 4
PART = 20_000  # words worked through at a time in training


def words_of(text: str) -> list[str]:
    """Words of a text; a longer run is cut into pieces that overlap by ``SHARED`` characters.

    So each n-gram of the run is in a piece, and a bag stays bounded.
    """
    out = []
    for run in _WORD.findall(text.lower()):
        if len(run) <= PIECE:
            out.append(run)
        else:
            out += [run[at:at + PIECE] for at in range(0, len(run) - SHARED, PIECE - SHARED)]
    return out


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's n-grams of 3 to 5 characters and of the word itself; counts."""
    framed = [f"<{word}>" for word in words]
    sizes = np.array([len(f) for f in framed])
    points = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points.astype(np.uint64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(points))
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words),
                        np.uint64, len(words))
    hashes, owners = [whole], [np.arange(len(words))]
    code = points.copy()
    for n in range(2, 6):
        code = code[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1:]
        if n > 2:
            inside = at[:len(code)] + n <= ends[:len(code)]
            hashes.append(code[inside] ^ (code[inside] >> np.uint64(29)))
            owners.append(owner[:len(code)][inside])
    every, owners = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    mixed = every[order] * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64), np.bincount(
        owners, minlength=len(words))


class WordTable(dict):
    """A number for each word, given at its first use; ``new`` lists those to look up."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number


def bag(words: list[str], table: WordTable) -> np.ndarray:
    """Numbers of the words; a word that repeats itself at once counts once."""
    found = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
    return found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found


def _windows(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Every second window of ``WINDOW`` words and the last, and their text; so each word is in one.

    -1 where a text is shorter.
    """
    rows, owner = [], []
    for text, bag in enumerate(bags):
        if len(bag) < WINDOW:
            bag = np.concatenate([bag, np.full(WINDOW - len(bag), -1)])
        every = np.lib.stride_tricks.sliding_window_view(bag, WINDOW)
        rows.append(every[::2] if len(every) % 2 else np.concatenate([every[::2], every[-1:]]))
        owner.append(np.full(len(rows[-1]), text))
    return np.concatenate(rows).astype(np.int32), np.concatenate(owner).astype(np.int32)


class Trainer:
    """Embeddings and softmax over a fixed list of words, fitted by Adam."""

    def __init__(self, words: list[str], seed: int = 7):
        draw = np.random.default_rng(seed)
        parts = []  # in parts here and below, to keep memory small
        for at in range(0, len(words), PART):
            ids, sizes = subwords(words[at:at + PART])
            parts.append((ids.astype(np.int32), sizes.astype(np.int32)))
        self.ids = np.concatenate([ids for ids, _ in parts])
        self.sizes = np.concatenate([sizes for _, sizes in parts])
        del parts
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        self.values = [draw.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32),
                       draw.normal(0, 0.5, (2, SIZE)).astype(np.float32),
                       np.zeros(2, np.float32)]
        self.moments = [(np.zeros_like(v), np.zeros_like(v)) for v in self.values]
        self.step = 0

    def word_sums(self) -> np.ndarray:
        out = np.empty((len(self.sizes), SIZE), np.float32)
        for at in range(0, len(self.sizes), PART):
            bounds = self.bounds[at:at + PART + 1]
            starts = bounds[:min(PART, len(self.sizes) - at)]
            out[at:at + PART] = np.add.reduceat(
                self.values[0][self.ids[bounds[0]:bounds[-1]]], starts - bounds[0])
        return out

    def hidden(self, windows: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        there = windows >= 0
        counts = np.maximum((self.sizes[windows] * there).sum(1), 1)
        return (sums[windows] * there[..., None]).sum(1) / counts[:, None], counts

    def scores(self, windows: np.ndarray) -> np.ndarray:
        sums, out = self.word_sums(), []
        for at in range(0, len(windows), 20_000):
            h, _ = self.hidden(windows[at:at + 20_000], sums)
            out.append(h @ (self.values[1][1] - self.values[1][0]))
        return np.concatenate(out) + self.values[2][1] - self.values[2][0]

    def fit(self, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int,
            rate: float = 0.05, decay: float = 1e-5) -> None:
        """``rounds`` of Adam; every gradient is over all of ``windows``."""
        weights = weights / weights.sum()
        for _ in range(rounds):
            table, out, bias = self.values
            h, counts = self.hidden(windows, self.word_sums())
            logits = h @ out.T + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(labels)), labels] -= 1
            p *= weights[:, None]
            back = (p @ out) / counts[:, None]
            there = windows >= 0
            spread = np.zeros((len(self.sizes), SIZE))
            owner = np.nonzero(there)[0]
            for k in range(SIZE):
                spread[:, k] = np.bincount(windows[there], back[owner, k], len(self.sizes))
            grad = np.zeros(table.shape)
            for at in range(0, len(self.sizes), PART):
                bounds = self.bounds[at:at + PART + 1]
                ids = self.ids[bounds[0]:bounds[-1]]
                for k in range(SIZE):
                    grad[:, k] += np.bincount(ids, np.repeat(
                        spread[at:at + PART, k], self.sizes[at:at + PART]), BUCKETS)
            grad = grad.astype(table.dtype)
            self._adam([grad + decay * table, p.T @ h + decay * out, p.sum(0)], rate)

    def _adam(self, grads: list[np.ndarray], rate: float) -> None:
        self.step += 1
        for value, grad, (m, v) in zip(self.values, grads, self.moments):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= rate * (m / (1 - 0.9 ** self.step)) / (
                np.sqrt(v / (1 - 0.99 ** self.step)) + 1e-8)


def _best(scores: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """Indices of the ``count`` highest windows of each text."""
    order = np.lexsort((-scores, owner))
    first = np.r_[True, owner[order][1:] != owner[order][:-1]]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[place < count]


def _calibrate(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the scores (Newton's method)."""
    centre, scale = scores.mean(), scores.std() + 1e-9
    x = np.c_[(scores - centre) / scale, np.ones(len(scores))]
    beta, weights = np.zeros(2), weights / weights.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * (weights * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6])
        beta -= np.linalg.solve(hess, x.T @ (weights * (p - labels)) + [1e-3 * beta[0], 0])
    return float(beta[0] / scale), float(beta[1] - beta[0] * centre / scale)


def train(texts: list[str], labels: list[int], shares: tuple[float, float] = (1.0, 1.0),
          first_windows: int = FIRST_WINDOWS, clean_windows: int = CLEAN_WINDOWS) -> dict:
    """The model: a number per bucket (embedding times softmax), bias and calibration.

    ``shares`` says how many texts of each class stand behind one of the sample.
    ``first_windows`` and ``clean_windows`` bound the windows drawn at random for
    the first fit and the later ones; the worst of every text is always used.
    With one class only, the model answers its share for every text.
    """
    labels = np.array(labels, int)
    prior = float((labels * shares[1]).sum() / max(1e-9, (labels * shares[1]).sum()
                                                   + ((1 - labels) * shares[0]).sum()))
    if len(set(labels.tolist())) < 2:
        return {"vector": None, "prior": min(prior, 0.5)}
    known = WordTable()
    bags = [bag(words_of(t), known) for t in texts]
    kept_out = np.arange(len(texts)) % 4 == 0
    windows, owner = _windows(bags)
    positive = labels[owner] == 1
    trainer = Trainer(list(known) or ["-"])
    inner = ~kept_out[owner]
    draw = np.random.default_rng(11)
    # At first any window of a toxic text may be the toxic one.
    some = np.flatnonzero(inner & (draw.random(len(owner)) < first_windows / max(1, inner.sum())))
    per_class = np.maximum(np.bincount(positive[some].astype(int), minlength=2), 1)
    trainer.fit(windows[some], positive[some].astype(int),
                1 / per_class[positive[some].astype(int)], rounds=20)
    for _ in range(4):
        scores = trainer.scores(windows)
        top = _best(scores, owner, 4)
        first = _best(scores, owner, 1)
        chosen = np.unique(np.r_[first[positive[first]], top[~positive[top]],
                                 draw.choice(np.flatnonzero(~positive), clean_windows)])
        chosen = chosen[inner[chosen]]
        y = positive[chosen].astype(int)
        trainer.fit(windows[chosen], y, 1 / np.maximum(np.bincount(y, minlength=2), 1)[y],
                    rounds=20)
    table, out, bias = trainer.values
    model = {"vector": (table @ (out[1] - out[0])).astype(np.float32),
             "bias": float(bias[1] - bias[0]), "prior": prior}
    scores = Scorer(model).raw(texts)
    use = kept_out & np.isfinite(scores)
    if len(set(labels[use].tolist())) < 2:
        use = np.isfinite(scores)
    # As if both classes were equally common: their share among labels need not be the corpus's.
    even = 1 / np.maximum(np.bincount(labels[use], minlength=2), 1)
    model["slope"], model["offset"] = _calibrate(scores[use], labels[use], even[labels[use]])
    return model


class Scorer:
    """Scores texts; the numbers of the words met so far are kept, up to a bound."""

    def __init__(self, model: dict):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.table, self.sums, self.counts = WordTable(), np.zeros(0), np.zeros(0)

    def raw(self, texts: list[str]) -> np.ndarray:
        """Logit of each text's worst window; minus infinity without words."""
        return np.concatenate([np.zeros(0), *(
            self._chunk(texts[at:at + 200]) for at in range(0, len(texts), 200))])

    def _chunk(self, texts: list[str]) -> np.ndarray:
        if len(self.table) > KEPT_WORDS:
            self._forget()
        bags = [bag(words_of(text), self.table) for text in texts]
        if self.table.new:
            ids, counts = subwords(self.table.new)
            starts = np.r_[0, np.cumsum(counts)[:-1]]
            sums = np.add.reduceat(self.model["vector"][ids].astype(float), starts)
            self.sums, self.counts = np.r_[self.sums, sums], np.r_[self.counts, counts]
            self.table.new = []
        out = np.full(len(texts), -np.inf)
        for k, words in enumerate(bags):
            if len(words):
                width = min(WINDOW, len(words))
                s = np.cumsum(self.sums[words])
                n = np.cumsum(self.counts[words])
                s = s[width - 1:] - np.r_[0, s[:-width]]
                out[k] = (s / (n[width - 1:] - np.r_[0, n[:-width]])).max() + self.model["bias"]
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        raw = self.raw(texts)
        logit = self.model["slope"] * raw + self.model["offset"]
        with np.errstate(invalid="ignore"):
            score = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        return np.where(np.isfinite(raw), score, min(self.model["prior"], 0.5))


@functools.lru_cache(maxsize=1)
def _scorer(packed: bytes) -> Scorer:
    return Scorer(pickle.loads(packed))


def held_out(id_column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(3)) == 1


def train_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE,
             id_column: str = "doc_id", text_column: str = "text") -> dict:
    """A model from at most ``sample`` labelled texts of each class, in hash order.

    Held-out ids are not read. Ids that are null, repeated in ``labels`` with
    different marks, or missing in ``docs`` teach nothing.
    """
    marks = labels.select(F.col(id_column).alias("id"), "toxic").filter(
        F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("id")
    ).groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter(
        "toxic = most")
    sizes = {row.toxic: row["count"] for row in marks.groupBy("toxic").count().collect()}
    chosen = [marks.filter(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(sample)
              for k in (0, 1)]
    rows = chosen[0].unionByName(chosen[1]).select("id", "toxic")  # at most 2 * sample rows
    texts = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("t")).join(
        F.broadcast(rows), "id").orderBy("id", "t").toPandas().drop_duplicates("id")
    taken = texts["toxic"].value_counts()
    shares = tuple(sizes.get(k, 0) / max(1, taken.get(k, 0)) for k in (0, 1))
    return train(texts["t"].tolist(), texts["toxic"].tolist(), shares)


def with_score(docs: DataFrame, model: dict, name: str = "score",
               text_column: str = "text") -> DataFrame:
    """Every row with all its columns and the toxicity of its whole text, 0 to 1.

    Texts without words (null and empty ones among them) get the share of toxic
    labels, at most 0.5. The model is a vector of fixed length.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packed = sent.value
        if pickle.loads(packed)["vector"] is None:
            prior = pickle.loads(packed)["prior"]
            yield from (pd.Series(prior, index=texts.index) for texts in batches)
            return
        for texts in batches:
            yield pd.Series(_scorer(packed).scores(texts.tolist()), index=texts.index)

    return docs.withColumn(name, score(text_of(text_column)))


def score_documents(docs: DataFrame, labels: DataFrame, reject: float = REJECT,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row's ``held_out``, ``score`` and ``predicted``; repeated rows each.

    Empty tables give empty results. Labels decide training only, never a score.
    """
    model = train_on(docs, labels, id_column=id_column, text_column=text_column)
    rows = docs.select(F.col(id_column), F.col(text_column).alias("text"))
    return with_score(rows, model, "score", "text").select(
        id_column, held_out(id_column).alias("held_out"), "score",
        (F.col("score") >= reject).cast("int").alias("predicted"))


def labels_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")
