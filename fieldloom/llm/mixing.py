"""Mixing sources to target weights: iterative proportional fitting and calibrated sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import Workspace, fresh_names, materialize

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 8
TEMPERATURE = 0.9  # exponent of a value's present share in its default target
BUDGET = 0.9  # expected share of all tokens that the sample has
SMALL_CELLS = 200_000  # cells (some 60 bytes each) up to which they are raked in one task and their probabilities broadcast
SEED = "mix-1"


def topic(text: Column) -> Column:
    """The first rule that holds: legal (a licence), tabular (bars), markup (runs of signs), numeric (a digit), prose."""
    low = F.lower(F.coalesce(text, F.lit("")))
    signs = F.lit(False)
    for run in ("###", "%%%", "&&&", "$$$", "***"):
        signs = signs | low.contains(run)
    return F.when(low.contains("licens"), "legal").when(low.contains("|"), "tabular").when(signs, "markup").when(low.rlike("[0-9]"), "numeric").otherwise("prose")


def tokens(text: Column) -> Column:
    """How many runs without white space a text has, as a long; null: none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"\s+"), "")), F.lit(0)).cast("long")


def tempered_targets(cells: DataFrame, dimension: str, temperature: float = TEMPERATURE) -> DataFrame:
    """``value``, ``share``: present token shares raised to ``temperature`` and scaled to one."""
    mass = cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temperature)).alias("mass")).where("mass > 0")
    total = mass.agg(F.sum("mass").alias("total"))
    return mass.withColumn("total", total.scalar()).select("value", (F.col("mass") / F.col("total")).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (``tokens`` per combination of the dimensions) plus ``weight``, scaled until each dimension has its target shares.

    One round scales to each dimension in turn by a window sum over its values; after ``rounds`` the last
    dimension is met exactly and the others as closely as fitting has come. Counted as few, the cells are
    raked in one task and one job; beyond ``SMALL_CELLS`` each step is shuffled by its dimension and each
    round written. A value without a target gets weight zero.
    """
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for dimension, target in targets.items():
        now = now.join(target.select(F.col("value").alias(dimension), F.col("share").alias(f"share_{dimension}")), dimension, "left")
    now = materialize(now, "rake")
    small = now.count() <= SMALL_CELLS
    now = now.coalesce(1) if small else now
    for _ in range(rounds):
        for dimension in targets:
            margin = F.sum("weight").over(Window.partitionBy(dimension))
            now = now.withColumn("margin", margin).withColumn("weight", F.when(F.col("margin") > 0, F.col("weight") * F.coalesce(f"share_{dimension}", F.lit(0.0)) / F.col("margin")).otherwise(0.0))
        now = now if small else materialize(now, "rake")
    return materialize(now.select(*cells.columns, "weight"), "raked")


def probabilities(raked: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``raked`` plus ``p``: weight over tokens, scaled so that the expected tokens are ``budget`` of all, and 1 at most.

    Cells that would need more than all their tokens are kept whole, and the others are scaled up for what
    these lack, until no more cell does. Below that bound, expected tokens have the raked shares exactly.
    Cells without tokens or weight get zero, unless no cell has any; then all are kept. The driver gets a few
    sums for each step, no cells.
    """
    f = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    scale, whole = 0.0, -1
    while True:
        full = f * scale >= 1
        got = raked.agg(
            F.sum("tokens").alias("tokens"), F.count_if(full).alias("whole"),
            F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("kept"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("rest"),
        ).first()
        if not got["tokens"] or not got["rest"] or got["whole"] == whole:
            break
        scale, whole = (budget * got["tokens"] - got["kept"]) / got["rest"], got["whole"]
    none = not raked.where(f > 0).limit(1).count()
    return raked.withColumn("p", F.lit(1.0) if none else F.least(F.lit(1.0), f * scale))


def uniform(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone; null ids share one."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f"/{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def _cell(text_col: str, topics: Column | None) -> dict[str, Column]:
    """A document's place: source, language and topic; nulls of any count as "unknown"."""
    named = lambda x: F.coalesce(x.cast("string"), F.lit("unknown"))
    return {"source": named(F.col("source")), "lang": named(F.col("lang")), "topic": topic(F.col(text_col)) if topics is None else named(topics)}


def sampling_plan(slim: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, budget: float = BUDGET) -> DataFrame:
    """``source``, ``lang``, ``topic``, ``p`` for every cell of ``slim`` (dimensions and ``tokens``)."""
    with Workspace(slim.sparkSession) as work:
        cells = work.keep(slim.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
        targets = targets or {d: tempered_targets(cells, d) for d in DIMENSIONS}
        return work.give(probabilities(rake(cells, targets, rounds), budget).select(*DIMENSIONS, "p"), "cells-p")


def _small(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= SMALL_CELLS else plan


def mix_report(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, seed: str = SEED, budget: float = BUDGET,
    topics: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id``, ``source``, ``lang``, ``topic``, ``tokens``, ``p``, ``sampled``, one row per input row.

    Cells are source by language by topic; nulls count as "unknown". ``topics`` is a column of the caller's;
    without it ``topic`` marks texts by a few signs. Targets are tables of ``value`` and ``share`` per
    dimension, by default tempered present shares. A document is sampled where its id's number is below its
    cell's ``p``; equal ids share the number, and so do null ones. Null and empty texts have no tokens; an
    empty table gives an empty table; other columns are not read.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(x.alias(d) for d, x in _cell(text_col, topics).items()), tokens(F.col(text_col)).alias("tokens"))
    slim = materialize(slim, "mix-docs")
    out = slim.join(_small(sampling_plan(slim, targets, rounds, budget)), list(DIMENSIONS))
    return out.select("doc_id", *DIMENSIONS, "tokens", "p", (uniform(F.col("doc_id"), seed) < F.col("p")).alias("sampled"))


def mix(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, seed: str = SEED, budget: float = BUDGET,
    topics: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that ``mix_report`` samples, with all their columns, whatever these are named."""
    cell = _cell(text_col, topics)
    plan = sampling_plan(docs.select(*(x.alias(d) for d, x in cell.items()), tokens(F.col(text_col)).alias("tokens")), targets, rounds, budget)
    names = dict(zip((*DIMENSIONS, "p"), fresh_names(docs, *DIMENSIONS, "p")))
    plan = plan.select(*(F.col(c).alias(x) for c, x in names.items()))
    keyed = docs.withColumns({names[d]: x for d, x in cell.items()})
    return keyed.join(_small(plan), [names[d] for d in DIMENSIONS]).where(uniform(F.col(id_col), seed) < F.col(names["p"])).select(*docs.columns)


def mix_sql(rounds: int = ROUNDS, temperature: float = TEMPERATURE, seed: str = SEED, budget: float = BUDGET, documents: str = "documents", steps: int = 12) -> str:
    """``mix_report`` in DuckDB SQL."""
    low = "lower(coalesce(text, ''))"
    signs = " or ".join(f"contains({low}, '{run}')" for run in ("###", "%%%", "&&&", "$$$", "***"))
    ctes = [
        f"""d as (select doc_id, coalesce(source, 'unknown') as source, coalesce(lang, 'unknown') as lang,
                 case when contains({low}, 'licens') then 'legal' when contains({low}, '|') then 'tabular'
                      when {signs} then 'markup' when regexp_matches({low}, '[0-9]') then 'numeric' else 'prose' end as topic,
                 len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '')) as tokens
          from {documents})""",
        "c as (select source, lang, topic, cast(sum(tokens) as bigint) as tokens from d group by all)",
        "r0 as (select *, cast(tokens as double) as weight from c)",
    ]
    for dim in DIMENSIONS:
        ctes.append(f"m_{dim} as (select {dim} as value, pow(cast(sum(tokens) as double), {temperature}) as mass from c group by all having mass > 0)")
        ctes.append(f"t_{dim} as (select value, mass / (select sum(mass) from m_{dim}) as share from m_{dim})")
    n = 0
    for _ in range(rounds):
        for dim in DIMENSIONS:
            ctes.append(
                f"""r{n + 1} as materialized (select r.source, r.lang, r.topic, r.tokens,
                      weight * case when sum(weight) over (partition by r.{dim}) > 0
                                    then coalesce(share, 0.0) / sum(weight) over (partition by r.{dim}) else 0.0 end as weight
                    from r{n} r left join t_{dim} on value = r.{dim})"""
            )
            n += 1
    ctes.append(f"f as (select *, case when tokens > 0 then weight / tokens else 0.0 end as f from r{n})")
    ctes.append(f"s0 as (select {budget} * sum(tokens) / nullif(sum(weight), 0) as scale from f)")
    for k in range(steps):  # more than the cells kept whole take; a further step changes nothing
        ctes.append(
            f"""s{k + 1} as materialized (select coalesce(({budget} * sum(tokens) - coalesce(sum(tokens) filter (where f * scale >= 1), 0))
                  / nullif(sum(weight) filter (where f * scale < 1), 0), any_value(scale)) as scale from f, s{k})"""
        )
    ctes.append(f"p as (select source, lang, topic, case when (select max(f) from f) > 0 then least(1.0, f * scale) else 1.0 end as p from f, s{steps})")
    u = f"cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '/{seed}'), 1, 8)) as bigint) / 4294967296.0"
    return f"with {', '.join(ctes)} select doc_id, source, lang, topic, tokens, p, {u} < p as sampled from d join p using (source, lang, topic)"
