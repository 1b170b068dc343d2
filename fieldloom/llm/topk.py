"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16_384  # candidates whose scores are accumulated together
QUERY_ROWS = 64  # queries that share one pass over the postings


def weighted_terms(rows: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id``, ``weights`` (array<long>): a vector's components as integer weights, floor(scale * x); term: the position.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an id.
    """
    x = F.col(vector_col).cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("weights"))


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id``, ``score`` of the ``k`` largest inner products per query, ties to the smaller id.

    Both inputs have ``id`` and ``weights``. Candidates are dealt into blocks of about ``block_rows`` by a
    hash of the id; every block also receives the stated queries. A task holds one block's postings (a list
    of rows and weights per term) and streams the queries past it: each non-zero term of a query adds its
    weight times its postings to a dense score array, from which a partition selection takes the block's k
    best. The blocks' lists are merged by rank. A query's own id is no candidate of it; repeated rows of one
    id count once if equal. Vectors of different lengths meet in the terms they share. Fewer candidates than
    ``k`` are all returned; an empty side gives an empty table.
    """
    blocks = max(1, -(-candidates.count() // block_rows))
    block_of = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    stored = candidates.select(block_of.alias("block"), F.lit(0).alias("tag"), "id", "weights")
    asked = queries.distinct().select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("tag"), "id", "weights")
    dealt = stored.unionByName(asked).repartition("block").sortWithinPartitions("block", "tag", "id", "weights")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def rows() -> Iterator:
            for batch in batches:
                w = batch.column(3)
                values, ends = w.values.to_numpy(zero_copy_only=False), w.offsets.to_numpy()
                for i, (b, t, key) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                    yield b, t, key, values[ends[i] : ends[i + 1]]

        def postings(ids: list, vectors: list):
            """Ids ascending, and per term the rows that have it (a slice if all do) with their weights."""
            keep = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1] or not np.array_equal(vectors[i], vectors[i - 1])]
            ids, vectors = np.array([ids[i] for i in keep], np.int64), [vectors[i] for i in keep]
            lens = np.array([len(v) for v in vectors])
            flat = np.concatenate(vectors) if vectors else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(vectors)), lens)
            term = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
            row, term, flat = row[flat != 0], term[flat != 0], flat[flat != 0]
            order = np.argsort(term, kind="stable")
            row, flat = row[order], flat[order]
            bounds = np.searchsorted(term[order], np.arange(int(lens.max(initial=0)) + 1))
            lists = [(slice(None) if b - a == len(ids) else row[a:b], flat[a:b]) for a, b in zip(bounds, bounds[1:])]
            return ids, lists

        def answer(block, asked: list):
            ids, lists = block
            if not len(ids) or not asked:
                return None
            scores = np.zeros((len(asked), len(ids)), np.int64)
            for q, (_, vector) in enumerate(asked):
                line = scores[q]
                for t in np.nonzero(vector[: len(lists)])[0]:
                    where, weights = lists[t]
                    line[where] += vector[t] * weights
            query, found, value = [], [], []
            for q, (key, _) in enumerate(asked):
                line, names = scores[q], ids
                own = np.searchsorted(ids, [key, key + 1]) if key < 2**63 - 1 else [len(ids), len(ids)]
                if own[0] < own[1]:
                    line, names = np.delete(line, slice(*own)), np.delete(ids, slice(*own))
                if not len(names):
                    continue
                least = np.partition(line, len(line) - k)[len(line) - k] if len(line) > k else line.min()
                some = np.nonzero(line >= least)[0]
                best = some[np.argsort(-line[some], kind="stable")][:k]
                query += [key] * len(best)
                found.append(names[best])
                value.append(line[best])
            if not query:
                return None
            return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(np.concatenate(found)), pa.array(np.concatenate(value))], names=["query_id", "id", "score"])

        number, ids, vectors, block, asked = None, [], [], None, []
        for b, tag, key, vector in rows():
            if b != number:
                if block is not None and (out := answer(block, asked)):
                    yield out
                number, ids, vectors, block, asked = b, [], [], None, []
            if tag == 0:
                ids.append(key)
                vectors.append(vector)
                continue
            if block is None:
                block, ids, vectors = postings(ids, vectors), [], []
            asked.append((key, vector))
            if len(asked) == QUERY_ROWS:
                if out := answer(block, asked):
                    yield out
                asked = []
        if block is not None and (out := answer(block, asked)):
            yield out

    parts = dealt.mapInArrow(run, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
