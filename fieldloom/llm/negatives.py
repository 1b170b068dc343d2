"""Hard-negative mining by one-dimensional distance keys: an index sorted by (pivot, distance), searched in growing key intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import Workspace

SAMPLE_ROWS = 4096  # rows, by hash of their id, that pivots are fitted on
PIVOTS = 64
PAGE_ROWS = 1024  # neighbours in the order of keys that are read together
BLOCK_QUERIES = 64  # queries near the same pivot that share the reading of pages
FIRST_GROWTH = 0.25  # where nothing bounds a query that has found too few, its radius doubles, from this share of the longest norm on
_SAFE = 2**52


def labelled_vectors(rows: DataFrame, scale: int = 256, label: str | Column = "label", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id``, ``label``, ``weights`` (floor(scale * x) of each component) of the rows that can take part.

    Rows with a null id, label or vector, or any null or non-finite component, take no part. Of rows that share
    an id one stays: the least label, then the least vector.
    """
    x = F.col(vector_col).cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    label = F.col(label) if isinstance(label, str) else label
    good = rows.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("weights"))
    one = good.where("label is not null").groupBy("id").agg(F.min(F.struct("label", "weights")).alias("v"))
    return one.select("id", "v.label", "v.weights")


def _square(weights: str) -> Column:
    """Squared norm of an array of integers."""
    return F.aggregate(weights, F.lit(0.0), lambda s, w: s + w.cast("double") * w)


def _vectors(column):
    """The rows of a list column as float and as integer matrices' rows (numpy arrays)."""
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[ends[i] : ends[i + 1]] for i in range(len(column))]


def _scores(a, b):
    """Exact integer inner products of the rows of two integer matrices: in floats where they hold them exactly, else in Python's integers."""
    import numpy as np

    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1]
    if most < _SAFE:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64) if most < 2**63 else np.clip(a.astype(object) @ b.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)


def _padded(vectors: list, width: int):
    import numpy as np

    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v[:width]
    return out


@dataclass
class Index:
    """``rows``: ``page``, ``id``, ``label``, ``weights`` in the order of (pivot, distance); ``pages``: ``page``, ``pivot``, ``near``, ``far``.

    ``longest`` is the largest squared norm: every vector gets one component more, which lifts its squared norm
    to it, so that the nearest vectors of a query (whose own such component is 0) are those of the largest
    inner product. ``centres`` are the pivots, in the lifted space. ``sample`` are the ids, labels and vectors
    that they were fitted on: rows of the index too, so that their scores bound those of the best.
    """

    rows: DataFrame
    pages: DataFrame
    centres: object
    longest: float
    width: int
    sample: tuple


def _fit(sample, longest: float, pivots: int):
    """Pivots of a sample of lifted vectors: a few rounds of k-means from its first rows."""
    import numpy as np

    x = np.hstack([sample.astype(float), np.sqrt(np.maximum(0, longest - (sample.astype(float) ** 2).sum(1)))[:, None]])
    centres = np.unique(x, axis=0)
    centres = centres[np.random.default_rng(7).permutation(len(centres))[:pivots]]
    for _ in range(5):
        nearest = ((x**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * x @ centres.T).argmin(1)
        centres = np.array([x[nearest == k].mean(0) if (nearest == k).any() else c for k, c in enumerate(centres)])
    return centres


def build_index(vectors: DataFrame, work: Workspace, pivots: int = PIVOTS, page_rows: int = PAGE_ROWS) -> Index | None:
    """The index over ``vectors`` (``id``, ``label``, ``weights``); None if there are none.

    Pivots are fitted on a sample of ``SAMPLE_ROWS`` rows at most; every row is indexed. Rows are range-partitioned
    by (pivot, distance, id), so many copies of a vector spread over pages and tasks.
    """
    import numpy as np

    size = vectors.agg(F.max(_square("weights")), F.max(F.size("weights"))).first()
    if size[0] is None:
        return None
    longest, width = float(size[0]), max(1, int(size[1]))
    rows = vectors.select("weights", "label", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE_ROWS).collect()
    sample = (np.array([r["id"] for r in rows]), np.array([r["label"] for r in rows]), _padded([np.array(r["weights"], np.int64) for r in rows], width))
    centres = _fit(sample[2], longest, pivots)

    def assign(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = _padded(_vectors(batch.column(2)), width).astype(float)
            squares = (x**2).sum(1)
            lifted = np.hstack([x, np.sqrt(np.maximum(0, longest - squares))[:, None]])
            d = np.maximum(0, (lifted**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * lifted @ centres.T)
            pivot = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(x)), pivot]))], names=["id", "label", "weights", "pivot", "distance"])

    keyed = vectors.select("id", "label", "weights").mapInArrow(assign, "id long, label long, weights array<bigint>, pivot int, distance double")
    stored = keyed.repartitionByRange("pivot", "distance", "id").sortWithinPartitions("pivot", "distance", "id")

    def number(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        page, held, pivot = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            pages = []
            for p in batch.column(3).to_pylist():
                if p != pivot or held == page_rows:
                    page, held, pivot = page + 1, 0, p
                held += 1
                pages.append(page)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(pages, np.int64))], names=["id", "label", "weights", "pivot", "distance", "page"])

    rows = work.keep(stored.mapInArrow(number, "id long, label long, weights array<bigint>, pivot int, distance double, page long"), "index")
    pages = work.keep(rows.groupBy("page").agg(F.first("pivot").alias("pivot"), F.min("distance").alias("near"), F.max("distance").alias("far")), "index-pages")
    return Index(rows.select("page", "id", "label", "weights"), pages, centres, longest, width, sample)


def search(index: Index, queries: DataFrame, k: int, same_label: bool) -> DataFrame:
    """``id``, ``window``, ``rank``, ``other``, ``score``: for each query and window the ``k`` best scores in it, ties to the smaller id.

    ``queries`` has ``id``, ``label``, ``weights`` and ``windows`` (array<struct<lo, hi>> of scores, both ends
    included). Candidates have the query's label (``same_label``) or another; the query's id is none.

    Queries near the same pivot form blocks. A page whose keys lie ``gap`` from the block's own distances to
    the pivot holds nothing nearer than ``gap`` (triangle inequality). So a block first reads the pages
    around its own keys at every pivot, then, with the radius that its k-th best distances demand, the pages
    between the last radius and the new one, until no page within it is unread. Where less than k are found,
    the k-th best of the index's sample or the lowest score of the window bounds the radius; where nothing
    does, it doubles. Pages that lie too near for the highest window are skipped. All bounds have a margin for
    rounding; scores are exact integers, so the result is that of an exhaustive search.
    """
    centres, longest, width = index.centres, index.longest, index.width
    known_ids, known_labels, known = index.sample
    margin = 1e-6 * (1 + math.sqrt(longest))
    shape = "id long, label long, weights array<bigint>, windows array<struct<lo:bigint,hi:bigint>>"

    def place(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = _padded(_vectors(batch.column(2)), width).astype(float)
            d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (centres**2).sum(1)[None] - 2 * x @ centres[:, :width].T))
            own = d.argmin(1)
            scores = _scores(_padded(_vectors(batch.column(2)), width), known)
            bounds = [bound(*x) for x in zip(scores, *(batch.column(c).to_pylist() for c in (0, 1, 3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(list(d), pa.list_(pa.float64())), pa.array(bounds, pa.int64())], names=["id", "label", "weights", "windows", "own", "distances", "bound"])

    def bound(line, key, label, windows):
        """A score that the k-th best of every window reaches, by the sample alone; None if it has too few."""
        import numpy as np

        line = line[((known_labels == label) == same_label) & (known_ids != key)]
        inside = [line[(line >= w["lo"]) & (line <= w["hi"])] for w in windows]
        return min((int(np.partition(x, len(x) - k)[len(x) - k]) for x in inside), default=None) if all(len(x) >= k for x in inside) else None

    def reach(score: Column) -> Column:
        """Distance of a query to the vectors of a score."""
        return F.sqrt(F.greatest(F.lit(0.0), _square("weights") + longest - 2 * score.cast("double")))

    with Workspace(queries.sparkSession) as work:
        placed = queries.select("id", "label", "weights", "windows").mapInArrow(place, shape + ", own int, distances array<double>, bound long")
        asked = placed.withColumn("nth", F.row_number().over(Window.partitionBy("own", F.pmod(F.xxhash64("id"), F.lit(256))).orderBy("id")))
        asked = asked.withColumn("block", F.xxhash64("own", F.pmod(F.xxhash64("id"), F.lit(256)), F.expr(f"nth div {BLOCK_QUERIES}"))).drop("nth", "own")
        low = F.array_min(F.transform("windows", lambda w: w["lo"]))
        farthest = F.least(reach(low), F.sqrt(_square("weights")) + math.sqrt(longest), F.when(F.col("bound").isNotNull(), reach(F.col("bound"))).otherwise(math.inf)) + margin
        ends = asked.withColumns({"inner": reach(F.array_max(F.transform("windows", lambda w: w["hi"]))) - margin, "outer": farthest, "sure": F.col("bound").isNotNull() | (low > -(2**63))})
        asked = work.keep(ends.withColumns({"inner": F.greatest("inner", F.lit(0.0)), "want": F.size("windows")}), "queries")
        spans = asked.select("block", "inner", F.posexplode("distances").alias("pivot", "d")).groupBy("block", "pivot").agg(F.min("d").alias("dmin"), F.max("d").alias("dmax"), F.min("inner").alias("inner"))
        spans = work.keep(spans, "spans")
        # A radius is what a block has read up to (``done``) and is to read up to now (``radius``).
        radii = work.keep(asked.groupBy("block").agg(F.lit(-1.0).alias("done"), (F.min("inner") + 2 * margin).alias("radius")), "radii")
        best = None
        while radii.where("radius > done").limit(1).count():
            old = [p for p in work.paths if "/radii-" in p or "/best-" in p]
            gap = F.greatest(F.lit(0.0), F.col("dmin") - F.col("far"), F.col("near") - F.col("dmax")) - margin
            at = spans.join(radii.where("radius > done"), "block").join(index.pages, "pivot").withColumn("gap", F.greatest(F.lit(0.0), gap))
            pairs = at.where("gap > done and gap <= radius").where(F.col("dmax") + F.col("far") + margin >= F.col("inner")).select("block", "page")
            found = _read(index, asked, pairs, k, same_label)
            merged = found if best is None else found.unionByName(best)
            order = Window.partitionBy("id", "window").orderBy(F.desc("score"), "other")
            best = work.keep(merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "best")
            full = best.groupBy("id", "window").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).groupBy("id").agg(F.count("*").alias("full"), F.min("least").alias("least"))
            need = asked.join(full, "id", "left").join(radii, "block")
            grown = F.when(F.col("sure"), F.col("outer")).otherwise(F.greatest(F.col("radius") * 2, F.lit(FIRST_GROWTH * math.sqrt(longest) + margin)))
            need = need.withColumn("need", F.least("outer", F.when(F.col("full") >= F.col("want"), reach(F.col("least")) + margin).otherwise(grown)))
            radii = work.keep(need.groupBy("block").agg(F.first("radius").alias("done"), F.max("need").alias("radius")), "radii")
            work.drop(old)
        if best is None:
            best = work.keep(_read(index, asked, radii.select("block", F.lit(0).cast("long").alias("page")), k, same_label), "best")
        order = Window.partitionBy("id", "window").orderBy(F.desc("score"), "other")
        return work.give(best.withColumn("rank", F.row_number().over(order)).select("id", "window", "rank", "other", "score"), "searched")


def _read(index: Index, asked: DataFrame, pairs: DataFrame, k: int, same_label: bool) -> DataFrame:
    """``id``, ``window``, ``other``, ``score``: each page's best ``k`` for the queries of the blocks that read it."""
    width = index.width
    window = F.transform("windows", lambda w: w["lo"]).alias("lo"), F.transform("windows", lambda w: w["hi"]).alias("hi")
    none = F.lit(None).cast("array<bigint>")
    stored = index.rows.join(pairs.select("page").distinct(), "page", "left_semi").select("page", F.lit(0).alias("tag"), "id", "label", "weights", none.alias("lo"), none.alias("hi"))
    come = pairs.join(asked.select("block", "id", "label", "weights", *window), "block").select("page", F.lit(1).alias("tag"), "id", "label", "weights", "lo", "hi")
    dealt = stored.unionByName(come).repartition("page").sortWithinPartitions("page", "tag", "id")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def answer(page, asked: list):
            ids, labels, matrix = page
            scores = _scores(_padded([a[2] for a in asked], width), matrix)
            out = ([], [], [], [])
            for line, (key, label, _, lows, highs) in zip(scores, asked):
                fits = (labels == label) if same_label else (labels != label)
                fits &= ids != key
                mine, names = line[fits], ids[fits]
                for n, (lo, hi) in enumerate(zip(lows, highs)):
                    some = np.flatnonzero((mine >= lo) & (mine <= hi))
                    if not len(some):
                        continue
                    value = mine[some]
                    if len(some) > k:
                        cut = value >= np.partition(value, len(value) - k)[len(value) - k]
                        some, value = some[cut], value[cut]
                    top = np.lexsort((names[some], -value))[:k]
                    out[0].extend([key] * len(top))
                    out[1].extend([n] * len(top))
                    out[2].extend(names[some[top]].tolist())
                    out[3].extend(value[top].tolist())
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=["id", "window", "other", "score"])

        number, page, held, asked = None, None, [], []
        for batch in batches:
            vectors = _vectors(batch.column(4))
            lows, highs = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            for r, (b, tag, key, label) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                if b != number:
                    if page is not None and asked:
                        yield answer(page, asked)
                    number, page, held, asked = b, None, [], []
                if tag == 0:
                    held.append((key, label, vectors[r]))
                    continue
                if page is None:
                    if not held:
                        continue
                    page = (np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64), _padded([h[2] for h in held], width))
                    held = []
                asked.append((key, label, vectors[r], lows[r], highs[r]))
                if len(asked) == BLOCK_QUERIES:
                    yield answer(page, asked)
                    asked = []
        if page is not None and asked:
            yield answer(page, asked)

    return dealt.mapInArrow(run, "id long, window int, other long, score long")


def hard_negatives(vectors: DataFrame, is_anchor: str | Column, positives: int = 5, negatives: int = 5, least: int = 80, pivots: int = PIVOTS, page_rows: int = PAGE_ROWS) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``vectors`` has ``id``, ``label``, ``weights`` (``labelled_vectors``); anchors are its rows where ``is_anchor``. An anchor's positives are its
    ``positives`` best rows of the same label by inner product (ties to the smaller id, not itself). For each
    the ``negatives`` best rows of another label follow whose score lies from ``least`` hundredths of the
    positive's to the positive's; there are none where that is negative. Anchors without positives have no
    row; no vectors or no anchors give an empty table. Vectors of different lengths are filled up with zeros.
    """
    spark = vectors.sparkSession
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    with Workspace(spark) as work:
        vectors = work.keep(vectors, "vectors")
        index = build_index(vectors, work, pivots, page_rows)
        if index is None:
            return spark.createDataFrame([], kind)
        anchors = vectors.where(is_anchor)
        open_ = F.array(F.struct(F.lit(-(2**63)).alias("lo"), F.lit(2**63 - 1).alias("hi")))
        near = search(index, anchors.withColumn("windows", open_), positives, same_label=True).select("id", F.col("rank").alias("nth"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
        near = work.keep(near, "positives")
        lo = F.ceil(F.col("positive_score").cast("decimal(38,0)") * least / 100).cast("long")
        windows = near.where("positive_score >= 0").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("nth", lo.alias("lo"), F.col("positive_score").alias("hi")))).alias("w"))
        asked = anchors.join(windows, "id").select("id", "label", "weights", F.transform("w", lambda w: F.struct(w["lo"], w["hi"])).alias("windows"), F.transform("w", lambda w: w["nth"]).alias("nths"))
        asked = work.keep(asked, "asked")
        found = search(index, asked.drop("nths"), negatives, same_label=False)
        at = asked.select("id", F.posexplode("nths").alias("window", "nth"))
        named = found.join(at, ["id", "window"]).join(near, ["id", "nth"])
        return work.give(named.select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")


MINE_SQL = """
        with v as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                          list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as w
                   from embeddings
                   where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
             s as (select a.id as anchor_id, b.id, a.label = b.label as same, cast(list_sum(list_transform(list_zip(a.w, b.w), lambda z: z[1] * z[2])) as bigint) as score
                   from v a join v b on a.id % 100 = 0 and a.id <> b.id),
             p as (select anchor_id, id as positive_id, score as positive_score from s where same
                   qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
             n as (select p.anchor_id, positive_id, s.id as negative_id, positive_score, s.score as negative_score,
                          row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id) as rank
                   from p join s on s.anchor_id = p.anchor_id and not same and 80 * positive_score <= 100 * s.score and s.score <= positive_score)
        select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 5"""
