"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import materialize

ORDERS = (3, 4, 5, 6)  # code points of an n-gram
BITS = 20  # of an n-gram's bucket
SMOOTHING = 1.0  # added to every count
MIX = 1 << 64, 0x9E3779B97F4A7C15, 0x100000001B3  # modulus and multipliers of the rolling hash


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled rows that training reads, ``max_features`` the buckets it keeps."""

    max_rows: int = 16_000
    max_features: int = 1 << 11
    min_rows: int = 3
    penalty: float = 0.5
    rounds: int = 150
    cut: float = 0.3


@dataclass(frozen=True)
class Model:
    """Weights of the kept buckets (naive Bayes scaling included) and the intercept."""

    buckets: object  # int32 array, ascending
    weights: object  # float64 array
    intercept: float


def buckets(text: bytes):
    """Bucket of every n-gram of a UTF-8 text's lower-cased code points, edges marked by blanks, repeats included."""
    import numpy as np

    points = f" {text.decode('utf-8', 'replace').lower()} ".encode("utf-32-le", "surrogatepass")
    x = np.frombuffer(points, np.uint32).astype(np.uint64) + np.uint64(1)
    found, h = [], x
    for n in range(2, max(ORDERS) + 1):
        if len(x) < n:
            break
        h = h[:-1] * np.uint64(MIX[2]) + x[n - 1 :]
        if n in ORDERS:
            found.append(((h * np.uint64(MIX[1])) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


def _slim(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *more)


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text``, ``y``: at most ``max_rows`` labelled documents, chosen by a hash of the id.

    Held-out rows (crc32 of the id's decimal text mod 4 is 2) are never among them. Null labels and null ids
    are skipped; of several labels of one id the largest counts, of several texts the least.
    """
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_rows)
    # Bounded by max_rows, so it is broadcast.
    rows = _slim(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "y")).alias("row"))
    return rows.select("doc_id", "row.text", "row.y")


def held_out(id_col: str = "doc_id"):
    """True for rows that no training may use."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), **columns: str) -> Model:
    """Fit the classifier on ``training_rows``.

    Rows of each class that have a bucket are counted in Spark; the buckets whose log-count ratio weighs
    most (ratio times the root of its count) are kept; their presence, scaled by the ratio, feeds a logistic
    regression. What reaches the driver is bounded by ``max_rows`` and ``max_features``. Without rows of both
    classes the model is the smoothed share of label 1.
    """
    import numpy as np

    rows = materialize(training_rows(docs, labels, settings, **columns).repartition(12), "toxic-train")
    total = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = total.get(1, 0), total.get(0, 0)
    base = float(np.log((pos + 0.5) / (neg + 0.5)))
    if not pos or not neg:
        return Model(np.zeros(0, np.int32), np.zeros(0), base)

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        seen = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                seen[y, buckets(text.as_py() or b"")] += 1  # once per text, however often a bucket repeats
        some = np.nonzero(seen.any(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[1, some]), pa.array(seen[0, some])], names=["bucket", "p", "q"])

    counted = rows.select("text", "y").where("y in (0, 1)").mapInArrow(count, "bucket int, p long, q long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    ratio = F.log((F.col("p") + SMOOTHING) / (pos + 2 * SMOOTHING)) - F.log((F.col("q") + SMOOTHING) / (neg + 2 * SMOOTHING))
    ratios = counted.where(F.col("p") + F.col("q") >= settings.min_rows).withColumn("r", ratio).withColumn("gain", F.abs("r") * F.sqrt(F.col("p") * neg / pos + F.col("q")))
    kept = ratios.orderBy(F.desc("gain"), "bucket").limit(settings.max_features).select("bucket", "r").toPandas().sort_values("bucket")
    names, scale = kept["bucket"].to_numpy(np.int32), kept["r"].to_numpy(np.float64)

    def features(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        place = np.full(1 << BITS, -1, np.int32)
        place[names] = np.arange(len(names))
        for batch in batches:
            hits = [np.unique(p[p >= 0]) for p in (place[buckets(x.as_py() or b"")] for x in batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.list_(pa.int32())), batch.column(1)], names=["hits", "y"])

    table = rows.select("text", "y").where("y in (0, 1)").mapInArrow(features, "hits array<int>, y int").toArrow()
    hits = table["hits"].combine_chunks()
    weights, intercept = _logistic(hits.values.to_numpy(), hits.offsets.to_numpy(), table["y"].to_numpy().astype(float), scale, base, settings)
    return Model(names, weights * scale, intercept)


def _logistic(cols, offsets, y, scale, base: float, settings: Settings):
    """Logistic regression on the rows ``cols[offsets[i]:offsets[i+1]]`` (presence scaled by ``scale``), by Nesterov steps."""
    import numpy as np

    n, lens = len(y), np.diff(offsets)
    row = np.repeat(np.arange(n), lens)
    value = scale[cols]
    w, b = np.zeros(len(scale)), base
    # The curvature of the loss is at most a quarter of the largest squared row norm: a safe step.
    norms = np.bincount(row, value**2, n) + 1
    step = 1 / (0.25 * np.quantile(norms, 0.9) + settings.penalty / n)
    vw, vb = w, b
    for k in range(settings.rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, vw[cols] * value, n) + vb, -30, 30)))
        g = (p - y) / n
        nw = vw - step * (np.bincount(cols, g[row] * value, len(scale)) + settings.penalty / n * vw)
        nb = vb - step * g.sum()
        m = k / (k + 3)
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w, float(b)


def score(docs: DataFrame, model: Model, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``held_out``, ``score`` (0 to 1), ``predicted`` (1 from ``cut`` on) and the columns ``keep`` (by default the id), one row per input row.

    Null, empty and very short texts have no n-gram and get the score of the intercept. Whole texts are read
    and nothing is shuffled; the model that tasks receive is bounded by ``max_features``.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        place = np.zeros(1 << BITS, np.int32)  # of a bucket's weight, 0: none
        place[model.buckets] = np.arange(1, len(model.buckets) + 1)
        weights = np.concatenate([[0.0], model.weights])
        for batch in batches:
            out = []
            for text in batch.column(1):
                hits = place[buckets(text.as_buffer().to_pybytes() if text.is_valid else b"")]
                z = weights[np.unique(hits[hits > 0])].sum() + model.intercept
                out.append(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "score"])

    keep = keep or (id_col,)
    slim = _slim(docs, id_col, text_col, *(F.col(c).alias(f"keep_{c}") for c in keep if c != text_col))
    scored = slim.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields) + ", score double")
    kept = (F.col("text").cast("string").alias(c) if c == text_col else F.col(f"keep_{c}").alias(c) for c in keep)
    return scored.select(*kept, held_out("doc_id").alias("held_out"), "score", (F.col("score") >= settings.cut).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below ``cut``, with all their columns, whatever these are named.

    Rows are judged one by one: repeated ones go or stay together, null and empty texts have the score of the
    intercept, null ids are scored like others. An empty table gives an empty table.
    """
    names = dict(zip(docs.columns, (f"c{i}" for i in range(len(docs.columns)))))
    scored = score(docs.toDF(*names.values()), model, settings, names[id_col], names[text_col], keep=tuple(names.values()))
    return scored.where("predicted = 0").select(*(F.col(x).alias(c) for c, x in names.items()))
