"""Exact duplicates by content sort: range partitions of normalised bytes, sorted outside memory, neighbours compared in full."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import Workspace, fresh_names

HEAD_BYTES = 64  # leading bytes of a splitter; the digest of the whole text follows


def normalised(text: Column) -> Column:
    """``text`` with every run of ASCII white space as one space; null is empty. Single spaces are left alone, which spares most replacements."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def _sorted(docs: DataFrame, id_col: str, text_col: str, carried: list[str]) -> DataFrame:
    """``norm``, ``id``, ``sha`` and ``row`` (the carried columns), range-partitioned and sorted so that equal texts are neighbours.

    Splitters come from Spark's sample of the keys, which are bounded: leading bytes, digest, id. The id is
    part of the key, so a text that a third of all rows share spreads over many partitions.
    """
    rows = docs.select(normalised(F.col(text_col)).alias("norm"), F.col(id_col).alias("id"), F.struct(F.lit(True).alias("_"), *(F.col(c) for c in carried)).alias("row"))
    rows = rows.withColumns({"sha": F.sha2("norm", 256), "head": F.substring(F.col("norm").cast("binary"), 1, HEAD_BYTES)})
    by_id = F.col("id").asc_nulls_last()
    dealt = rows.repartitionByRange("head", "sha", by_id).sortWithinPartitions("head", "sha", "norm", by_id)
    return dealt.select("norm", "id", "sha", "row")


def _runs(rows: DataFrame, firsts_only: bool) -> DataFrame:
    """Each row, or the first of each run of equal texts, with what its partition knows of the run.

    ``keep`` (its first id), ``size`` (its rows), ``first``, ``part``, ``edge`` (1: the partition's first run,
    2: its last, 3: both, 0: neither, so the run is whole) and ``text`` (the text, on the first row of an edge
    run only). Rows stream; only the ids, digests and carried columns of the current run wait for its end,
    and of those the first row's alone where ``firsts_only``.
    """
    kind = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([T.StructField("id", kind["id"]), T.StructField("sha", T.StringType()), T.StructField("row", kind["row"]), T.StructField("keep", kind["id"]), T.StructField("size", T.LongType()), T.StructField("first", T.BooleanType()), T.StructField("part", T.IntegerType()), T.StructField("edge", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def out(held: pa.Table, keep: pa.Array, sizes: np.ndarray, edge: int, text: str | None) -> Iterator:
            """The rows of whole runs, ``sizes`` rows each (held: all of them, or their first ones); ``text`` stands on the first."""
            n = held.num_rows
            at = np.cumsum(sizes) - sizes
            starts = np.ones(n, bool) if firsts_only else np.isin(np.arange(n), at)
            run_of = np.arange(n) if firsts_only else np.repeat(np.arange(len(sizes)), sizes)
            table = held.append_column("keep", keep.take(pa.array(run_of)))
            table = table.append_column("size", pa.array(sizes[run_of], pa.int64())).append_column("first", pa.array(starts))
            table = table.append_column("part", pa.array(np.full(n, part, np.int32))).append_column("edge", pa.array(np.full(n, edge, np.int32)))
            yield from table.append_column("text", pa.array([text] + [None] * (n - 1), pa.string())).to_batches(max_chunksize=10_000)

        waiting, size, text, runs = [], 0, None, 0  # the current run
        for batch in batches:
            if not batch.num_rows:
                continue
            norm, rest = batch.column(0), pa.Table.from_batches([batch.select([1, 2, 3])])
            new = np.ones(batch.num_rows, bool)
            new[1:] = pc.not_equal(norm.slice(1), norm.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            new[0] = text is None or norm[0].as_py() != text
            starts = np.flatnonzero(new)
            until = int(starts[0]) if len(starts) else batch.num_rows
            if until:  # more of the current run
                waiting += [] if firsts_only else [rest.slice(0, until)]
                size += until
            if not len(starts):
                continue
            if size:
                held = pa.concat_tables(waiting)
                yield from out(held, held.column("id").slice(0, 1).combine_chunks(), np.array([size]), int(runs == 0), text if runs == 0 else None)
                runs += 1
            begin, end = int(starts[0]), int(starts[-1])
            if end > begin:  # runs that begin and end in this batch
                sizes = np.diff(starts)
                done = rest.take(pa.array(starts[:-1])) if firsts_only else rest.slice(begin, end - begin)
                keep = rest.column("id").take(pa.array(starts[:-1])).combine_chunks()
                if runs == 0:
                    one = int(sizes[0])
                    yield from out(done.slice(0, 1 if firsts_only else one), keep.slice(0, 1), sizes[:1], 1, norm[begin].as_py())
                    done, keep, sizes = done.slice(1 if firsts_only else one), keep.slice(1), sizes[1:]
                    runs = 1
                if len(sizes):
                    yield from out(done, keep, sizes, 0, None)
                    runs += len(sizes)
            waiting, size, text = [rest.slice(end, 1) if firsts_only else rest.slice(end)], batch.num_rows - end, norm[end].as_py()
        if size:
            held = pa.concat_tables(waiting)
            yield from out(held, held.column("id").slice(0, 1).combine_chunks(), np.array([size]), 3 if runs == 0 else 2, text)

    return rows.mapInArrow(run, schema)


def _joined(runs: DataFrame) -> DataFrame:
    """``runs`` with those that partition borders cut made whole: ``keep``, ``size``, and ``kept`` for the row that stays.

    A partition has two edge runs at most, so their table has two rows a partition whatever the input. They
    are matched by their whole text; the result (numbers only) is broadcast.
    """
    same = Window.partitionBy("text")
    edges = runs.where("text is not null").select("part", "edge", F.min("keep").over(same).alias("all_keep"), F.sum("size").over(same).alias("all_size"), F.min("part").over(same).alias("first_part"))
    both = runs.drop("text").join(F.broadcast(edges), ["part", "edge"], "left")
    return both.select("id", "sha", "row", F.coalesce("all_keep", "keep").alias("keep"), F.coalesce("all_size", "size").alias("size"), (F.col("first") & (F.coalesce("first_part", "part") == F.col("part"))).alias("kept"))


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal if identical once every run of ASCII white space is one space; null is the empty text. Of
    equal texts the row with the smallest id stays; a null id counts as the largest, and of rows equal in id
    and text one stays. Rows of one id with different texts belong to different groups. Other columns are
    ignored, whatever their names; an empty table gives an empty one.

    Texts are shuffled and sorted once, outside memory where they must be, and whole texts are compared with
    their neighbours. What follows works on ids and digests.
    """
    with Workspace(docs.sparkSession) as work:
        runs = work.give(_runs(_sorted(docs, id_col, text_col, []), firsts_only=False), "sorted-runs")
    found = _joined(runs)
    return found.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``duplicate_report`` keeps, all their columns as they were, texts not normalised."""
    names = fresh_names(docs, *(f"c{i}" for i in range(len(docs.columns))))
    renamed = docs.toDF(*names)
    at = {c.lower(): n for c, n in zip(docs.columns, names)}
    with Workspace(docs.sparkSession) as work:
        runs = work.give(_runs(_sorted(renamed, at[id_col.lower()], at[text_col.lower()], names), firsts_only=True), "sorted-firsts")
    kept = _joined(runs).where("kept").select(*(F.col(f"row.{n}").alias(c) for n, c in zip(names, docs.columns)))
    return kept


REPORT_SQL = r"""
        with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
             g as (select doc_id, sha256(norm) as text_sha256, min(doc_id) over w as keep_id, count(*) over w as group_size,
                          row_number() over (partition by norm order by doc_id nulls last) as place
                   from d window w as (partition by norm))
        select doc_id, keep_id, group_size, place = 1 as kept, text_sha256 from g"""
