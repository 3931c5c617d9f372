"""Packing of documents into sequences by vector best-fit.

A bin has three residual capacities: tokens, documents and attention cost (the
sum of squared piece lengths). A piece goes to the open bin that, of those with
room in every capacity, has the smallest weighted residual norm afterwards (or
the largest weighted dot product of piece and residual); else to a new bin.
Pieces come longest first.

What a bin's choice depends on is lengths alone, and there are no more lengths
than tokens in a sequence. So the driver packs a histogram (one row a length),
with equal bins held as one class, and gets intervals of ranks within a length;
each piece then finds its own bin from its rank. The packing is that of one
global best-fit over all pieces, one after the other, whatever their number. By
default only tokens bind, as then fewest sequences are made; ``max_docs`` and
``max_cost`` bind the other two capacities.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.tokens import encoder, vocabulary_path, with_end
from maskloom.llm.util import materialise, session, spread

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"
SALTS = 1024


def token_pieces(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 1, ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every whole text and its end id.

    Only longer documents are cut; their last piece may be shorter. A null or
    empty text is its end id alone. Null and repeated doc_ids are kept as they
    come. ``ids``: also give the piece's ids as bytes. ``salt`` deals rows out.
    """
    session(docs)
    tokenizer = tokenizer or vocabulary_path()
    schema = PIECES + (", ids binary" if ids else "")

    def cut(batches):
        from pyspark import TaskContext

        words, row = encoder(tokenizer), TaskContext.get().partitionId() * 7919
        for batch, tokens, ends in words.parts(batches):
            ids_ = batch.column(0)
            docs_ = np.array(ids_.to_pylist(), object) if ids_.null_count else ids_.to_numpy()
            tokens, ends = with_end(tokens, ends, end_id)
            n = np.diff(ends)
            each = -(-n // capacity)
            of = np.repeat(np.arange(len(n)), each)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
            start = piece * capacity
            length = np.minimum(n[of] - start, capacity)
            data, a = memoryview(tokens.view(np.uint8)), 4 * (ends[:-1][of] + start)
            parts = [data[x : x + y] for x, y in zip(a.tolist(), (4 * length).tolist())]
            salt = (row + np.arange(len(of))) % SALTS
            row += len(of)
            cols = [
                pa.array(docs_[of], pa.int64()),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                pa.array(salt, pa.int32()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"]
            if ids:
                cols, names = [*cols, pa.array([bytes(x) for x in parts], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(cut, schema)


def best_fit(lengths, counts, capacity=4096, max_docs=None, max_cost=None, select="norm", weights=(1.0, 1e-3, 1e-3)):
    """Vector best-fit over a histogram; longest first.

    Returns an integer array of placements, a row each: length, first rank,
    number of pieces, pieces a bin takes here, first bin, offset in the bin.
    ``max_docs`` and ``max_cost`` default to values that never bind.
    """
    limit = np.array([capacity, max_docs or capacity, max_cost or capacity * capacity], dtype=float)
    scale = np.asarray(weights, dtype=float) / limit**2
    size = 1024
    left, first, many = np.zeros((size, 3)), np.zeros(size, np.int64), np.zeros(size, np.int64)
    used, bins, out = 0, 0, []

    def add(residual, start, n):
        nonlocal used, size, left, first, many
        if n <= 0 or residual[0] <= 0 or residual[1] <= 0 or residual[2] <= 0:
            return
        gone = np.flatnonzero(many[:used] == 0)
        at = gone[0] if len(gone) else used
        if at == size:
            size *= 2
            left, first, many = (np.concatenate([x, np.zeros_like(x)]) for x in (left, first, many))
        left[at], first[at], many[at] = residual, start, n
        used = max(used, at + 1)

    for length, n in sorted(zip(map(int, lengths), map(int, counts)), reverse=True):
        item, rank = np.array([length, 1, length * length], dtype=float), 0
        if np.any(item > limit):
            raise ValueError(f"a piece of {length} tokens is over the capacities {limit.tolist()}")
        while n:
            fits = np.flatnonzero((many[:used] > 0) & (left[:used] >= item).all(axis=1))
            if len(fits):
                if select == "norm":
                    score = ((left[fits] - item) ** 2 * scale).sum(axis=1)
                else:
                    score = -(left[fits] * item * scale).sum(axis=1)
                best = fits[np.argmin(score)]
                residual, start, have = left[best].copy(), int(first[best]), int(many[best])
            else:
                best, residual, start, have = None, limit.copy(), bins, n
            # a bin filled by norm stays the best; by dot product it falls behind its likes
            each = 1 if select == "dot" and best is not None else int(min((residual // item).min(), n))
            full = min(n // each, have)
            if full:
                out.append((length, rank, full * each, each, start, int(capacity - residual[0])))
                rank, n = rank + full * each, n - full * each
            took = full
            if n and full < have:  # the last bin takes fewer than it could
                out.append((length, rank, n, n, start + full, int(capacity - residual[0])))
                rest, took = n, full + 1
                rank, n = rank + n, 0
            else:
                rest = 0
            if best is None:
                bins += took
            else:
                first[best], many[best] = start + took, have - took
            if full:
                add(residual - each * item, start, full)
            if rest:
                add(residual - rest * item, start + full, 1)
    return np.array(out, dtype=np.int64).reshape(-1, 6), bins


def pack(pieces: DataFrame, capacity: int = 4096, **kind) -> DataFrame:
    """``pieces`` (of ``token_pieces``, written and read again) with the columns
    sequence_id and offset: each sequence is filled without gaps from 0, holds at
    most ``capacity`` tokens and whole pieces only. An empty table stays empty."""
    session(pieces)
    by = ["length", "salt"]
    counts = pieces.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    histogram = counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()  # at most a row a length
    placed, _ = best_fit([r["length"] for r in histogram], [r["n"] for r in histogram], capacity, **kind)
    placed = placed[np.lexsort((placed[:, 1], placed[:, 0]))]
    here = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*by, F.coalesce(F.sum("__n").over(here), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*by).orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("__rank", F.row_number().over(within) - 1).join(base, by)
    ranked = ranked.withColumn("__rank", (F.col("__rank") + F.col("__base")).cast("long")).drop("__base", "salt")
    keep = [c for c in ranked.columns if c != "__rank"]
    fields = ranked.select(*keep).schema.add("sequence_id", "long").add("offset", "long")

    def find(batches):
        shift = np.int64(1) << np.int64(44)
        keys = placed[:, 0] * shift + placed[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("__rank")).to_numpy()
            at = placed[np.searchsorted(keys, length * shift + rank, side="right") - 1]
            bin_, nth = np.divmod(rank - at[:, 1], at[:, 3])
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(at[:, 4] + bin_), pa.array(at[:, 5] + nth * length)], [*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(find, fields)


def pack_documents(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 1, **kind) -> DataFrame:
    """Cut and pack whole documents: per piece doc_id, piece, start, length,
    ids_crc32, sequence_id, offset."""
    pieces = materialise(token_pieces(docs, capacity, tokenizer, end_id), "pieces")
    return pack(pieces, capacity, **kind)
