"""The pipeline against its operators, and all registered queries."""

import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def test_stages(spark, tmp_path):
    from maskloom.llm.simhash import simhash
    from maskloom.llm.tokens import vocabulary_path
    from maskloom.llm.util import table

    docs = table(spark, str(DATA), "documents")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, str(DATA)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen[name] = docs
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name in ("toxicity", "simhash_near_dedup"):
            assert docs.exceptAll(before).count() == 0
        if name == "secret_scan":
            assert docs.count() == before.count()
    fps = [simhash(r["text"]) for r in seen["simhash_near_dedup"].collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") > 3 for i, a in enumerate(fps) for b in fps[:i])
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    want = Counter()
    for r in seen["mixing"].collect():
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]
        want.update((r["doc_id"], k // 4096, zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096))
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in docs.collect()) == want


def test_queries(spark):
    from maskloom.llm.queries import ORACLE_SQL, QUERIES

    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 11)}
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    for name, q in QUERIES.items():
        got = q(spark, str(DATA)).toPandas()
        assert len(got) or name == "op8_secrets"
        if name in ORACLE_SQL:
            want = con.execute(ORACLE_SQL[name]).df()
            order = sorted(got.columns)
            key = lambda df: sorted(map(tuple, df[order].astype(object).where(df[order].notna(), None).values.tolist()), key=repr)  # noqa: B023, E731
            assert sorted(want.columns) == order and key(got) == key(want)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, score double, key string, predicted int, bands int, repeats int, row_key int, row_times int"


def odd_rows():
    rng = np.random.default_rng(4)
    words = "the of and stone river cloud paper light green water small house early night bread".split()
    prose = lambda n: " ".join(rng.choice(words, n))
    once = prose(300)
    out = [(i, prose(40 + i), "en", f"s{i % 4}") for i in range(40)]
    out += [(100, once, "en", "s0"), (101, once, "de", "s1"), (101, once, "de", "s1"), (102, once + " end", None, None)]
    out += [(None, prose(50), None, "s0"), (None, prose(50), "en", None), (None, None, None, None), (None, None, None, None)]
    out += [(200, None, "en", "s1"), (201, "", "en", "s2"), (202, " \t\n ", "en", ""), (203, "word", "en", "s3"), (204, prose(20_000), "en", "s3")]
    out += [(205, "password = 'hunter2secret9' " + prose(30), "en", "s1"), (206, "a <|endoftext|> b", "en", "s2"), (207, "x" * 9000, "en", "s2")]
    return [(i, t, lang, s, -1, -2, -3, -4.0, "k", -5, 1, 2, 3, 4) for i, t, lang, s in out]


@pytest.mark.parametrize("labelled", [True, False])
def test_run_on_odd_rows(spark, tmp_path, labelled):
    from tokenizers import Tokenizer

    from maskloom.llm.tokens import vocabulary_path

    rows = odd_rows()
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    known = [(i, 1, int(i % 9 == 0)) for i in range(40)] + [(None, 1, 1), (1, None, None)] if labelled else []
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = seen
        stage(spark, before, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        seen = spark.read.parquet(f"{tmp_path}/{name}")
        assert seen.columns == docs.columns
        if name == "toxicity" and not labelled:
            assert Counter(map(tuple, seen.collect())) == Counter(rows)
        if name == "simhash_near_dedup":
            assert seen.where("doc_id in (101, 102)").count() == 0 and seen.where("doc_id = 100").count() == before.where("doc_id = 100").count()
        if name == "secret_scan":
            assert seen.where("text like '%hunter2%'").count() == 0 and seen.count() == before.count()
    tokenizer = Tokenizer.from_file(vocabulary_path())
    want = Counter()
    for r in seen.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.update((r["doc_id"], k // 4096, zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed) == want


def test_run_on_nothing(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
