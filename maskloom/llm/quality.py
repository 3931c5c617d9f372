"""Quality scores: hashed word n-gram logistic regression, trained by FTRL.

A text is read as two sequences: its words in lower case, and their shapes
(letters A or a, digits 0, other characters as they are, runs of one kind at
most two long; a word equal to the one before it has a shape of its own).
Features are the hashed 1- and 2-grams of both, each worth its share of the
words. Scores are sparse dot products.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.ftrl import Ftrl, sample, sigmoid
from maskloom.llm.util import held_out, session, spread

#: Hashed features; one more is the constant.
SIZE = 1 << 18
#: Labelled documents that are learnt from, at most; chosen by hash of doc_id.
SAMPLE = 6000
EPOCHS = 3
#: A word's share of a text is small; features are this many times it.
SCALE = 8.0
CUT = 0.3

_FOLD = [(re.compile(p), to) for p, to in ((r"[A-Z]+", "A"), (r"[a-z]+", "a"), (r"[0-9]+", "0"), (r"(.)\1\1+", r"\1\1"))]


def shape(word: str) -> str:
    """Letters outside ASCII count by their case too."""
    if not word.isascii():
        word = "".join(c if c.isascii() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word)
    for pattern, to in _FOLD:
        word = pattern.sub(to, word)
    return word[:8]


class Features:
    """Hashed n-grams of batches of texts; remembers words' hashes."""

    def __init__(self, size: int = SIZE, most: int = 200_000):
        self.size, self.most, self.known = size, most, {}

    def _hashes(self, words: list[str]) -> np.ndarray:
        from xxhash import xxh64_intdigest as h

        if len(self.known) > self.most:
            self.known.clear()
        known, out = self.known, []
        for w in words:
            got = known.get(w)
            if got is None:
                got = h(w.lower().encode(), 1), h(shape(w).encode(), 2)
                if len(w) <= 64:
                    known[w] = got
            out.append(got)
        return np.array(out, dtype=np.uint64).reshape(-1, 2)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per feature occurrence its row and its index; words per row."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.values.dictionary_encode()
        code, ends = coded.indices.to_numpy(), lists.offsets.to_numpy()
        ends = ends - ends[0]
        full = np.flatnonzero(pc.binary_length(coded.dictionary).to_numpy())  # a split gives empty ends
        rows = np.repeat(np.arange(len(texts)), np.diff(ends))
        if len(full) < len(coded.dictionary):
            here = np.isin(code, full)
            code, rows = code[here], rows[here]
        word, form = self._hashes(coded.dictionary.to_pylist())[code].T if len(code) else np.zeros((2, 0), np.uint64)
        joined = rows[1:] == rows[:-1]
        form = form.copy()
        form[1:][joined & (code[1:] == code[:-1])] = 77
        mix, odd = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        grams = [word, form * odd, (word[1:] * mix + word[:-1])[joined], (form[1:] * mix + form[:-1] * odd)[joined]]
        index = [((g ^ (g >> np.uint64(29))) * mix >> np.uint64(40)).astype(np.int64) % self.size for g in grams]
        row = [rows, rows, rows[1:][joined], rows[1:][joined]]
        return np.concatenate(row), np.concatenate(index), np.bincount(rows, minlength=len(texts))

    def examples(self, texts: pa.Array):
        """Per row: distinct indices and values, the constant last."""
        rows, index, words = self(texts)
        both, count = np.unique(rows * self.size + index, return_counts=True)
        at = np.searchsorted(both, np.arange(len(texts) + 1) * self.size)
        for i, (a, b) in enumerate(zip(at, at[1:])):
            x = count[a:b] * (SCALE / max(1, words[i]))
            yield np.append(both[a:b] - i * self.size, self.size), np.append(x, 1.0)

    def scores(self, texts: pa.Array, weights: np.ndarray) -> np.ndarray:
        rows, index, words = self(texts)
        total = np.bincount(rows, weights[index], minlength=len(texts))
        return sigmoid(total * SCALE / np.maximum(1, words) + weights[self.size])


def parts(texts: pa.Array, most: int = 4 << 20):
    """Slices of bounded length in bytes; a text is never parted."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        yield texts.slice(at, to - at)
        at = to


def fit(texts: list, ys: list, epochs: int = EPOCHS, alpha: float = 1.0, l1: float = 0.3, **kind) -> np.ndarray:
    """Weights from labelled texts in their order; the last is the constant's."""
    features, model = Features(), Ftrl(SIZE + 1, alpha=alpha, l1=l1, **kind)
    rows = [x for p in parts(pa.array(texts, pa.string())) for x in features.examples(p)]
    for _ in range(epochs):
        for (at, x), y in zip(rows, ys):
            model.learn(at, x, y)
    return model.weights()


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = SAMPLE) -> np.ndarray:
    """Fitted by one task on at most ``most`` documents, in a fixed order."""
    session(docs)

    def learn(batches):
        texts, ys = [], []
        for batch in batches:
            ys += batch.column(1).to_pylist()
            texts += batch.column(2).to_pylist()
        w = fit(texts, ys)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["at", "w"])

    got = sample(docs, labels, column, most).mapInArrow(learn, "at long, w double").toPandas()
    weights = np.zeros(SIZE + 1, np.float32)
    weights[got["at"]] = got["w"]
    return weights


def score(docs: DataFrame, weights: np.ndarray, cut: float = CUT) -> DataFrame:
    """Per row of ``docs`` doc_id, held_out, score, predicted. Null and empty
    texts have the score of the constant alone; null and repeated doc_ids stay."""
    spark = session(docs)
    model = spark.sparkContext.broadcast(weights)  # its size is fixed: SIZE

    def run(batches):
        features = Features()
        for batch in batches:
            got = [features.scores(p, model.value) for p in parts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(got) if got else np.zeros(0))], ["doc_id", "score"])

    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame, **kind) -> DataFrame:
    """Train on the labelled rows that are not held out, score every row."""
    return score(docs, train(docs, labels, **kind))
