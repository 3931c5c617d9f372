"""The pipeline's near-copy stage against brute force, at similarities about 0.8."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(texts):
    sets = {i: shingles(t or "") for i, t in texts}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i for i in root if root[i] == i}


def test_stage_finds_similarity_080(spark):
    draw, texts = random.Random(5), []
    for k in range(60):
        words = [f"w{draw.randrange(5000)}" for _ in range(200)]
        texts.append((10 * k, " ".join(words)))
        for n, replaced in enumerate((1, 2, 4, 6, 12), 1):
            copy = list(words)
            for at in draw.sample(range(200), replaced):
                copy[at] = f"x{draw.randrange(5000)}"
            texts.append((10 * k + n, " ".join(copy)))
    texts += [(9000, None), (9001, ""), (9002, "a b"), (9003, "A  b"), (9004, "a c")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect()}
    want = brute_kept(texts)
    assert kept == want and 100 < len(want) < 300


def test_stage_drops_more_than_op9(spark):
    """Two of 200 words replaced: similarity about 0.905, over op9's 3 bits as a rule."""
    from maskloom.llm.simhash import drop_near_duplicates

    draw, texts = random.Random(6), []
    for k in range(40):
        words = [f"w{draw.randrange(5000)}" for _ in range(200)]
        copy = list(words)
        copy[50], copy[150] = "x", "y"
        texts += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == 40
    assert drop_near_duplicates(docs).count() > 40


def test_candidates_meet_in_segments_of_the_ring():
    """The join keys are segments of SimHash fingerprints: nearly all pairs of
    similarity 0.8 have an equal one, pairs of short texts always an equal key."""
    import numpy as np

    from maskloom.llm import similar

    rng, missed = np.random.default_rng(3), 0
    for rows in (1000, 50_000, 10_000_000):
        bits, number = similar.ring_of(rows)
        words = -(-bits * number // 64)
        keys = lambda h: set(similar.segments(similar.fingerprint(h, words), bits, number))  # noqa: B023, E731
        for _ in range(150):
            a = np.sort(rng.integers(0, 1 << 63, 180, dtype=np.uint64))
            b = np.sort(np.concatenate([rng.permutation(a)[20:], rng.integers(0, 1 << 63, 20, dtype=np.uint64)]))
            missed += not keys(a) & keys(b)
            assert len(keys(a)) == number
    assert missed <= 1
    for n in range(2, 10):
        a = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        near = [np.delete(a, 1)] if n > 4 else [a]
        near += [np.sort(np.append(a[1:], np.uint64(5)))] if n == 9 else []
        assert all(set(similar.short_keys(a, 9)) & set(similar.short_keys(b, 9)) for b in near)
    assert similar.short_keys(np.arange(10, dtype=np.uint64), 9) == []


def test_stage_finds_short_near_copies(spark):
    """Five shingles and four of them (similarity 0.8), nine and nine with eight in common."""
    texts = []
    for k in range(150):
        words = [f"w{k}_{i}" for i in range(14)]
        texts += [(4 * k, " ".join(words[:9])), (4 * k + 1, " ".join(words[:8])), (4 * k + 2, " ".join(["y", *words[1:13]])), (4 * k + 3, " ".join(["z", *words[1:13]]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect()}
    assert kept == brute_kept(texts) and len(kept) == 300


def test_families_of_unlike_variants_make_few_candidates(spark, monkeypatch):
    """Variants of one text, similar by 0.4 to 0.7 each two, with a few similar pairs: candidates
    do not grow with the square of a family, and the joins' code is small enough to compile."""
    from maskloom.llm import similar

    draw, texts = random.Random(7), []
    words = [f"w{draw.randrange(5000)}" for _ in range(200)]
    for k in range(150):
        copy = list(words)
        for at in draw.sample(range(200), 10):
            copy[at] = f"x{k}_{at}"
        texts.append((2 * k, " ".join(copy)))
        if k % 10 == 0:
            copy[100] = "y"
            texts.append((2 * k + 1, " ".join(copy)))
    made, write = [], similar.materialise

    def counted(df, name, rows=None):
        out = write(df, name, rows)
        if name == "near":
            made.append(out.count())
        return out

    monkeypatch.setattr(similar, "materialise", counted)
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect()}
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert kept == brute_kept(texts) and len(kept) == 150
    assert sum(made) <= 30 * 29  # all pairs of the 30 that have a similar one, in two rounds; of 165 there are 13,530


def test_shared_shingles_are_counted_by_class(spark):
    """Exact copies are one class; a shingle counts where another class has it."""
    from maskloom.llm import similar

    texts = ["a b c d e f", "A b  c d e f", "b c d e f g", "h i j k l m", "", None, "b c d e f"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["class"]: r["c"] for r in similar._shared(docs, 6).collect()}
    of = {t: similar.class_of(similar.shingles(t)) for t in texts if t}
    assert got == {of["a b c d e f"]: 1, of["b c d e f g"]: 1, of["b c d e f"]: 1}
