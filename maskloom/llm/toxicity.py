"""Toxicity by weak supervision.

Voters look at a text and vote toxic, clean or not at all. Lexicon voters know
one word or one word beginning each; they are proposed by how the labelled
sample uses its words. Pattern voters look at shouting, exclamation and repeats.
A generative model of votes given the hidden class estimates, by expectation
maximisation, each voter's rates and then how far voters repeat each other
(correlation of their votes within a class), which shrinks their say. A linear
classifier over hashed words and word beginnings learns the posterior labels,
of labelled and unlabelled texts alike, and scores all texts.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache
from math import comb, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from maskloom.llm.ftrl import Ftrl, one_text, sample, sigmoid
from maskloom.llm.quality import parts
from maskloom.llm.util import held_out, session, spread

SIZE = 1 << 20
#: Labelled documents learnt from, at most; and half as many without label.
SAMPLE = 6000
#: Lexicon voters, at most: those that tell the classes apart best.
VOTERS = 256
#: Lengths of the word beginnings that are features and may be lexicon entries.
BEGINNINGS = (4, 5, 6, 7)
#: A lexicon entry occurs in so many labelled texts and so clearly in one class.
LEAST, CLEAR = 3, 0.8
#: Voters correlated by less are taken as independent.
EDGE = 0.25
ROUNDS, EPOCHS, CUT = 20, 8, 0.5
#: A feature of more than so large a share of texts counts only if the classes' shares differ by as much.
COMMON = 0.1
#: The constant where no label was to be had: all scores are under the cut.
UNTAUGHT = -2.0
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def keys(word: str) -> list[str]:
    """What a word is known by: itself in lower case without outer marks, and
    its beginnings; none for marks alone."""
    word = word.lower().strip(MARKS)
    return [word, *beginnings(word)] if word else []


def beginnings(word: str) -> list[str]:
    return [f"{word[:n]}*" for n in BEGINNINGS if len(word) > n]


def text_keys(text: str | None) -> Counter:
    """How many different words of a text have each key; a beginning that two or
    more have is a key of its own too."""
    words = {w.strip(MARKS) for w in (text or "").lower().split()} - {""}
    starts = Counter([w[:n] + "*" for n in BEGINNINGS for w in words if len(w) > n])
    out = Counter(words)
    out.update(starts)
    out.update([k + "*" for k, n in starts.items() if n > 1])
    return out


@lru_cache
def _letters() -> np.ndarray:
    """Of every code point whether it is a letter (1), and one of upper case (2)."""
    return np.array([c.isalpha() + 2 * c.isupper() for c in map(chr, range(0x110000))], np.uint8)


def pattern_votes(text: str | None) -> list[int]:
    """-1, 0 or 1 of: shouting, exclamation, symbols, one word over and over."""
    text = text or ""
    words = text.split()
    kinds = np.bincount(_letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")], minlength=4)
    n, letters = max(1, len(words)), max(1, int(kinds[1] + kinds[3]))
    upper = int(kinds[2] + kinds[3]) / letters
    marked = sum(w.endswith("!") for w in words) / n
    symbols = sum(map(text.count, "#$%&*@|")) / max(1, len(text))
    repeats = sum(a == b for a, b in zip(words, words[1:])) / n
    shares = ((upper, 0.5, 0.2), (marked, 0.3, 0.05), (symbols, 0.1, 0.01), (repeats, 0.3, 0.05))
    return [1 if x >= high else -1 if x < low else 0 for x, high, low in shares]


def number(key: str) -> int:
    """A key's 32-bit hash; odd for beginnings, even for words."""
    return (xxh64_intdigest(key, 3) & 0xFFFFFFFE) | (key[-1:] == "*")


class Keyed:
    """Texts' keys as hashes, with how many words have each: five bytes a key."""

    def __init__(self, texts: list):
        self.rows = []
        for text in texts:
            found = text_keys(text)
            ids = np.array([(xxh64_intdigest(k, 3) & 0xFFFFFFFE) | (k[-1:] == "*") for k in found], np.uint32)
            order = np.argsort(ids)
            times = np.minimum(np.fromiter(found.values(), np.int64, len(found)), 3).astype(np.uint8)
            self.rows.append((ids[order], times[order]))

    def counts(self, which) -> tuple[np.ndarray, np.ndarray]:
        """The keys of the rows ``which``, sorted, and in how many each is."""
        ids = [self.rows[i][0] for i in which]
        return np.unique(np.concatenate([*ids, np.zeros(0, np.uint32)]), return_counts=True)


def among(some: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Those of ``some`` that are in the sorted ``ids``."""
    at = np.searchsorted(ids, some)
    return some[(at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == some)] if len(ids) else some[:0]


def lexicon(texts: list, keyed: Keyed, ys: dict[int, float], most: int = VOTERS) -> list[str]:
    """Keys that are clearly of one class, by how many standard errors their share
    of toxic texts is over all texts'; ties go to the shorter, then lesser, key.
    A key that begins like one before it, or is found in the same texts but for a
    fifth, is left out: it would repeat that voter. ``ys``: labels by row."""
    bad = [i for i, y in ys.items() if y >= 0.5]
    (every, n_every), (toxic, n_toxic) = keyed.counts(ys), keyed.counts(bad)
    n_every = n_every[np.searchsorted(every, toxic)]
    base = (len(bad) + 1) / (len(ys) + 2)
    chance = np.log(0.05 / max(1, int((keyed.counts(ys)[1] >= LEAST).sum())))
    share = (n_toxic + base) / (n_every + 1)
    # so often by chance, given as many keys: under one in twenty
    clear = [
        i for i in np.flatnonzero((n_every >= LEAST) & (share >= CLEAR)) if n_toxic[i] * np.log(base) + log(comb(int(n_every[i]), int(n_toxic[i]))) < chance
    ]
    where: dict[str, set[int]] = {}
    ids = set(toxic[clear].tolist())
    for r in bad:
        if ids.intersection(keyed.rows[r][0].tolist()):
            for k in text_keys(texts[r]):
                if number(k) in ids:
                    where.setdefault(k, set()).add(r)
    at = dict(zip(toxic.tolist(), range(len(toxic))))
    worth = lambda i: (share[i] - base) * np.sqrt(n_every[i] / (base * (1 - base)))
    chosen: list[str] = []
    for k in sorted(where, key=lambda k: (-worth(at[number(k)]), len(k), k)):
        stem, own = k.rstrip("*"), where[k]
        again = (5 * len(own & where[c]) >= 4 * len(own | where[c]) or stem.startswith(c.rstrip("*")) or c.startswith(stem) for c in chosen)
        if len(chosen) < most and not any(again):
            chosen.append(k)
    return chosen


def cast(texts: list, keyed: Keyed, words: list[str]) -> np.ndarray:
    """All votes: a row a text, a column a voter. The last lexicon voter votes
    clean on texts in which no other finds anything."""
    votes = np.zeros((len(texts), len(words) + 1 + len(pattern_votes(""))), dtype=np.int8)
    voter = {number(k): j for j, k in enumerate(words)}
    ids = np.array(sorted(voter), np.uint32)
    for i, text in enumerate(texts):
        found = [voter[k] for k in among(ids, keyed.rows[i][0]).tolist()]
        votes[i, found] = 1
        votes[i, len(words)] = 0 if found else -1
        votes[i, len(words) + 1 :] = pattern_votes(text)
    return votes


def label_model(votes: np.ndarray, seed: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """P(toxic) of each row of ``votes`` (-1, 0, 1), by the votes alone. ``seed``:
    the known labels, NaN where there is none; rates are those of the labelled
    rows and of the others by their posterior. Rates are smoothed; a voter that does not vote says
    nothing, and every voter's log odds are divided by one plus its summed
    absolute correlation with the others."""
    known = ~np.isnan(seed)
    p = np.where(known, seed, np.nanmean(seed) if known.any() else 0.5)
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(np.float64)
    say, weight, out = np.ones(votes.shape[1]), known.astype(float), p
    for r in range(rounds):
        prior = (weight @ p + 1) / (weight.sum() + 2)
        rates = []
        for q in (p * weight, (1 - p) * weight):
            rates.append((np.einsum("i,ijv->jv", q, one_hot) + 0.05) / (q.sum() + 0.15))
        say = 1 / (1 + _correlation(votes, p * weight, (1 - p) * weight))
        odds = np.einsum("ijv,jv->i", one_hot, say[:, None] * (np.log(rates[0]) - np.log(rates[1])) * [1.0, 0.0, 1.0])
        new = sigmoid(odds + np.log(prior / (1 - prior)))
        still, out = r and np.abs(new - out).max() < 1e-4, new
        if still:
            break
        p, weight = np.where(known, seed, new), np.ones(len(p))
    return out


def _correlation(votes: np.ndarray, *classes: np.ndarray) -> np.ndarray:
    """Each voter's summed absolute correlation with others within the classes,
    of those that are over EDGE or what chance gives."""
    total, rows = np.zeros(votes.shape[1]), sum(c.sum() for c in classes)
    for c in classes:
        n = c.sum()
        if n < 2:
            continue
        x = votes - (c @ votes) / n
        cov = (x * c[:, None]).T @ x / n
        sd = np.sqrt(np.diag(cov))
        r = np.divide(cov, np.outer(sd, sd), out=np.zeros_like(cov), where=np.outer(sd, sd) > 1e-12)
        np.fill_diagonal(r, 0)
        total += np.where(np.abs(r) > max(EDGE, 3 / np.sqrt(n)), np.abs(r), 0).sum(axis=1) * n / rows
    return total


def one_of_copies(keyed: Keyed, parts: int = 8) -> list[int]:
    """Rows of which none before shares one of ``parts`` pairs of least hashes of
    uncommon words: copies of a text, near or exact, teach what is chance in it as a rule."""
    seeds = np.random.default_rng(11).integers(1, 1 << 62, 2 * parts, dtype=np.uint64) | np.uint64(1)
    every, n = keyed.counts(range(len(keyed.rows)))
    rare = every[(n <= max(3, len(keyed.rows) / 100)) & (every % 2 == 0)]
    seen, kept = set(), []
    for i, (ids, _) in enumerate(keyed.rows):
        ids = among(ids, rare)
        if len(ids):
            least = ((ids.astype(np.uint64)[None, :] + np.uint64(1)) * seeds[:, None]).min(axis=1).tolist()
            pairs = {(j, *least[2 * j : 2 * j + 2]) for j in range(parts)}
            if seen & pairs:
                continue
            seen |= pairs
        kept.append(i)
    return kept


def _hash(key: str) -> int:
    return (number(key) >> 1) % SIZE


def fit(texts: list, ys: list, epochs: int = EPOCHS, **kind) -> np.ndarray:
    """Weights from texts with label 0, 1 or None; the last is the constant's. With
    no label at all there is but the constant, UNTAUGHT."""
    if all(y is None for y in ys):
        return np.append(np.zeros(SIZE), UNTAUGHT)
    keyed = Keyed(texts)
    kept = one_of_copies(keyed)
    texts, ys, keyed.rows = [texts[i] for i in kept], [ys[i] for i in kept], [keyed.rows[i] for i in kept]
    known = {i: y for i, y in enumerate(ys) if y is not None}
    soft = label_model(cast(texts, keyed, lexicon(texts, keyed, known)), np.array([np.nan if y is None else y for y in ys], dtype=float))
    model = Ftrl(SIZE + 1, **({"alpha": 0.5, "l1": 6.0} | kind))
    hashed = lambda ids: (ids >> np.uint32(1)).astype(np.int64) % SIZE
    df, toxic = np.zeros(SIZE), np.zeros(SIZE)
    for (ids, _), y in zip(keyed.rows, soft):
        at = np.unique(hashed(ids))
        df[at] += 1
        toxic[at] += y
    scale = rarity(df, toxic, len(texts), soft.sum())
    rows = []
    for ids, times in keyed.rows:
        at, back = np.unique(hashed(ids), return_inverse=True)
        x = np.minimum(np.bincount(back, times, minlength=len(at)), 3) * scale[at]
        rows.append((np.append(at[x > 0], SIZE), np.append(x[x > 0], 1.0)))
    for _ in range(epochs):
        for (at, x), y in zip(rows, soft):
            model.learn(at, x, y)
    return model.weights() * np.append(scale, 1.0)


def rarity(df: np.ndarray, toxic: np.ndarray, n: int, n_toxic: float) -> np.ndarray:
    """A feature's scale by the texts it occurs in, ``df`` of ``n``: log(n / df) /
    log(n); 0 for those in fewer than LEAST texts, and for COMMON ones that are of
    about the same share of either class (``toxic`` of ``n_toxic``, by posterior)."""
    with np.errstate(divide="ignore"):
        scale = np.log(max(2, n) / np.maximum(df, 1)) / np.log(max(2, n))
    apart = np.abs(toxic / max(n_toxic, 1e-9) - (df - toxic) / max(n - n_toxic, 1e-9))
    return np.where((df >= LEAST) & ((df <= COMMON * n) | (apart >= COMMON)), np.maximum(scale, 0), 0.0)


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", most: int = SAMPLE) -> np.ndarray:
    """Fitted by one task on at most ``most`` labelled documents and half as many
    of the others that are not held out, in a fixed order."""
    session(docs)
    known = sample(docs, labels, column, most).select("y", "text")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(~held_out() & F.col("doc_id").isNotNull())
    ids = ids.join(labels.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_anti").distinct()
    ids = ids.withColumn("rank", F.xxhash64(F.lit(6), "doc_id")).orderBy("rank", "doc_id").limit(most // 2)
    other = one_text(docs, ids)
    rows = known.withColumn("rank", F.xxhash64("text")).unionByName(other.select(F.lit(None).cast("double").alias("y"), "text", "rank"))
    rows = rows.repartition(1).sortWithinPartitions("rank", "text", "y")

    def learn(batches):
        texts, ys = [], []
        for batch in batches:
            ys += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
        w = fit(texts, ys)
        at = np.union1d(np.flatnonzero(w), [SIZE])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["at", "w"])

    got = rows.mapInArrow(learn, "at long, w double").toPandas()
    weights = np.zeros(SIZE + 1, np.float32)
    weights[SIZE] = UNTAUGHT  # where nothing came to be learnt from
    weights[got["at"]] = got["w"]
    return weights


class Scorer:
    """Scores of batches. Words' hashes are not kept; those of beginnings, of
    which there are fewer, are, up to ``most``."""

    def __init__(self, weights: np.ndarray, most: int = 200_000):
        self.weights, self.most = weights, most
        self.known: dict[str, tuple[float, float]] = {}  # of a beginning: its weight, and that of two words with it

    def _beginnings(self, starts: list[str]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        known, out = self.known, []
        for s in starts:
            got = known.get(s)
            if got is None:
                got = known[s] = float(self.weights[_hash(s + "*")]), float(self.weights[_hash(s + "**")])
            out.append(got)
        return np.array(out).reshape(-1, 2)

    def words(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """What each word adds alone; whether it may add with another."""
        h = xxh64_intdigest
        plain = stems.to_pylist()
        hashes = np.fromiter((h(w, 3) for w in plain), np.uint64, len(plain))  # as number() has it
        at = ((hashes & np.uint64(0xFFFFFFFE)) >> np.uint64(1)).astype(np.int64) % SIZE
        total = np.where(np.fromiter(map(len, plain), np.int64, len(plain)) > 0, self.weights[at], 0.0).astype(np.float64)
        length, paired = pc.utf8_length(stems).to_numpy(), np.zeros(len(plain), bool)
        for n in BEGINNINGS:
            long = length > n
            starts = pc.utf8_slice_codeunits(stems, 0, n).dictionary_encode()
            w = self._beginnings(starts.dictionary.to_pylist())[starts.indices.to_numpy()] if len(plain) else np.zeros((0, 2))
            total += np.where(long, w[:, 0], 0.0)
            paired |= long & (w[:, 1] != 0)
        return total, paired

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Of each text, by its different words."""
        lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
        coded = lists.values.dictionary_encode()
        stems = pc.utf8_trim(coded.dictionary, characters=MARKS)
        worth, paired = self.words(stems)
        words, code = stems.to_pylist(), coded.indices.to_numpy()
        rows = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        telling = ((worth != 0) | paired)[code] if len(code) else np.zeros(0, bool)
        total = np.full(len(texts), float(self.weights[SIZE]))
        # few words tell: those of one text, once each
        seen, starts = set(), Counter()
        for row, c in np.unique(np.stack([rows[telling], code[telling]]), axis=1).T.tolist():
            if (row, words[c]) in seen:
                continue
            seen.add((row, words[c]))
            total[row] += worth[c]
            if paired[c]:
                for k in beginnings(words[c]):
                    starts[row, k] += 1
                    if starts[row, k] == 2:
                        total[row] += float(self.weights[_hash(k + "*")])
        return sigmoid(total)


def score(docs: DataFrame, weights: np.ndarray, cut: float = CUT) -> DataFrame:
    """Per row of ``docs`` all its columns, then held_out, score, predicted. Null
    and empty texts have the constant's score; null and repeated ids stay. Without
    any label to learn from all scores are alike and under the cut."""
    from pyspark.sql import types as T

    spark = session(docs)
    model = spark.sparkContext.broadcast(weights)  # its size is fixed: SIZE
    plain = spread(docs.select(*docs.columns))

    def run(batches):
        scorer = Scorer(model.value)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            got = [scorer.scores(p) for p in parts(batch.column(at))]
            got = pa.array(np.concatenate(got) if got else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, got], [*batch.schema.names, "score"])

    rows = plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())]))
    return rows.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= cut).cast("int")})


def toxicity(docs: DataFrame, labels: DataFrame, **kind) -> DataFrame:
    """Train, then per row doc_id, held_out, score, predicted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(rows, train(docs, labels, **kind)).select("doc_id", "held_out", "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT, **kind) -> DataFrame:
    """``docs`` without the rows scored ``cut`` or more; all columns stay. Null and
    empty texts have the constant's score, repeats of a row the same; where no row
    has a label to learn from, all rows stay."""
    from maskloom.llm.util import fresh

    renamed = {c: fresh(docs, f"own_{c}") for c in docs.columns if c.lower() in ("score", "held_out", "predicted")}
    rows = docs.withColumnsRenamed(renamed)
    kept = score(rows, train(docs, labels, **kind), cut).where("predicted = 0")
    return kept.select(*[kept[renamed.get(c, c)].alias(c) for c in docs.columns])
