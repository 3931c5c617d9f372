"""Token-ID files: Parquet with a list column of ids.

One row is one document, in ascending doc_id order over the files as over the
rows of a file. Ids are dictionary-encoded (a vocabulary's ids fit one
dictionary page) or delta-encoded; row groups and pages are small and carry
column indexes, so that a reader of metadata or of a range of doc_ids reads
only those columns and pages.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskloom.llm.tokens import encoder, vocabulary_path, with_end
from maskloom.llm.util import new_path, session

SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = 2,
    encoding: str = "dictionary",
    row_group_bytes: int = 16 << 20,
    page_rows: int = 1024,
    parts: int | None = None,
) -> None:
    """Encode every whole text and write its ids, with ``end_id`` appended.

    A null or empty text has the end id alone. Rows with a null doc_id come
    first; rows that share a doc_id stay, in a fixed order by a hash of their
    text. An empty table writes no rows. Columns other than doc_id and text are not
    written. ``parts``: number of files (default: the session's shuffle
    partitions); a doc_id that holds many rows is spread over several.
    """
    spark = session(docs)
    tokenizer = tokenizer or vocabulary_path()
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def encode(batches):
        from pyspark import TaskContext

        part, start, words = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch, ids, ends in words.parts(batches):
            ids, ends = with_end(ids, ends, end_id)
            starts, start = start + ends[:-1], start + int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(batch.num_rows, part, np.int32)),
                    pa.array(starts, pa.int64()),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)),
                ],
                ["doc_id", "part", "part_start", "n_tokens", "ids"],
            )

    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    # the last key only parts rows that are the same
    rows = doc.repartitionByRange(parts, "doc_id", "hash", F.monotonically_increasing_id() % 1024).sortWithinPartitions("doc_id", "hash", "text")
    options = {
        "compression": "zstd",
        "parquet.block.size": row_group_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
    }
    rows.mapInArrow(encode, SCHEMA).write.options(**options).parquet(path)


def read_token_files(spark, path: str, columns: list[str] | None = None) -> DataFrame:
    """The files' rows; ``columns`` and filters on doc_id reach the scan."""
    df = spark.read.schema(SCHEMA).parquet(path)
    return df.select(*columns) if columns else df


def digest(spark, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before
    it), n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit)."""

    def crc(batches):
        for batch in batches:
            ids = batch.column(3)
            data = memoryview(ids.values.buffers()[1] or b"") if len(ids.values) else memoryview(b"")
            at = ids.values.offset
            spans = ids.offsets.to_pylist()
            sums = [zlib.crc32(data[4 * (at + a) : 4 * (at + b)]) for a, b in zip(spans, spans[1:])]
            n = [b - a for a, b in zip(spans, spans[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
            )

    # One total a file: as many as write_token_files was told to write.
    totals = read_token_files(spark, path, ["part", "n_tokens"]).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before, bases = 0, []
    for part, n in sorted(map(tuple, totals.collect())):
        bases.append((part, before))
        before += n
    base = spark.createDataFrame(bases, "part int, base long")
    rows = read_token_files(spark, path, ["doc_id", "part", "part_start", "ids"])
    rows = rows.mapInArrow(crc, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    rows = rows.join(F.broadcast(base), "part")
    return rows.select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, **kind) -> DataFrame:
    """Write ``docs`` as token files in the shared folder; digest what is read back."""
    spark = session(docs)
    path = new_path(spark, "tokens")
    write_token_files(docs, path, **kind)
    return digest(spark, path)


__all__ = ["write_token_files", "read_token_files", "digest", "token_files"]
