"""Canonical relations (documents, field facts, feedback, attempts, patterns, jobs) and their adapters.

``Relations`` derives them from the star-schema tables. Every relation is a lazy DataFrame, so a query reads
the columns it uses and nothing else; ``adapter_sql`` states the same relations in SQL for checks.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STRATEGIES = ("crf", "rule_based", "position_based")
LINE_ORDER = ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")


class Relations:
    """The relations over the tables of ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def templates(self) -> DataFrame:
        """One row per market segment: a dimension of a few rows, so the rank over all of it is no bottleneck."""
        names = self.table("customer").select(F.col("c_mktsegment").alias("name")).distinct()
        return names.select(F.row_number().over(Window.orderBy("name")).cast("long").alias("template_id"), "name")

    @cached_property
    def documents(self) -> DataFrame:
        owner = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("created_by"))
        status = F.when(F.col("o_orderstatus") == "F", "validated").when(F.col("o_orderstatus") == "O", "extracted").otherwise("pending")
        phase = F.when(F.col("o_orderpriority") == "1-URGENT", "baseline").when(F.col("o_orderpriority") != "2-HIGH", "adaptive")
        return (
            self.table("orders")
            .join(owner, "o_custkey")
            .join(F.broadcast(self.templates), "name")
            .select(
                F.col("o_orderkey").alias("document_id"),
                "template_id",
                F.col("name").alias("template_name"),
                F.col("o_orderdate").alias("created_at"),
                status.alias("status"),
                phase.alias("phase"),
                (F.floor("o_totalprice").cast("long") % 5000).alias("extraction_time_ms"),
                "created_by",
            )
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Line items with one row per (order, line number), which the source repeats, and their part."""
        keys = ["l_orderkey", "l_linenumber"]
        # The least row of a key, columns in LINE_ORDER. Least structs are found by sorting, so rows are dealt by key first:
        # a task sorts one share of the keys, not all rows of its piece of a file, and sorts once.
        items = self.table("lineitem").repartition(*keys).groupBy(*keys).agg(F.min(F.struct(*LINE_ORDER)).alias("x")).select(*keys, "x.*")
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand", "p_size")
        return items.join(part, "l_partkey")

    @cached_property
    def facts(self) -> DataFrame:
        """``extraction_fact``: one row per document and field."""
        method = F.when(F.col("l_suppkey") % 3 == 0, "crf").when(F.col("l_suppkey") % 3 == 1, "rule_based").otherwise("position_based")
        return self.lines.select(
            F.col("l_orderkey").alias("document_id"),
            F.concat(F.lit("field_"), F.col("l_linenumber").cast("string")).alias("field_name"),
            F.when(F.col("l_partkey") % 17 == 0, "").otherwise(F.col("p_name")).alias("value"),
            F.concat_ws(" ", "p_name", "p_type").alias("truth"),
            (F.col("l_discount") * 10).alias("confidence"),
            method.alias("method"),
            "l_partkey",
            F.col("l_linenumber").alias("position"),
        )

    @cached_property
    def feedback(self) -> DataFrame:
        """Corrections; the id is unique because a document has fewer than a hundred fields."""
        value = F.when(F.col("l_partkey") % 17 == 0, "").otherwise(F.col("p_name"))
        corrected = F.when(F.col("l_partkey") % 5 == 0, F.concat(value, F.lit(" "))).otherwise(F.concat_ws(" ", "p_name", "p_type"))
        return self.lines.where("l_returnflag = 'R'").select(
            (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("feedback_id"),
            F.col("l_orderkey").alias("document_id"),
            F.concat(F.lit("field_"), F.col("l_linenumber").cast("string")).alias("field_name"),
            value.alias("original_value"),
            corrected.alias("corrected_value"),
            F.col("l_shipdate").alias("created_at"),
            (F.col("l_partkey") % 2 == 0).alias("used"),
        )

    @cached_property
    def attempts(self) -> DataFrame:
        """``attempt_fact``: each field tried by each strategy."""
        tried = F.explode(F.array(*(F.struct(F.lit(k).alias("idx"), F.lit(s).alias("strategy")) for k, s in enumerate(STRATEGIES))))
        k = F.col("l_partkey") + F.col("s.idx")
        return self.lines.withColumn("s", tried).select(
            F.col("l_orderkey").alias("document_id"),
            F.concat(F.lit("field_"), F.col("l_linenumber").cast("string")).alias("field_name"),
            F.col("s.strategy").alias("strategy"),
            F.col("s.idx").alias("idx"),
            (k % 4 != 0).alias("success"),
            F.when(k % 3 == 0, F.concat_ws(" ", "p_name", "p_type")).otherwise(F.col("p_name")).alias("value"),
            (F.col("l_discount") * 10 / (F.col("s.idx") + 1)).alias("confidence"),
        )

    @cached_property
    def patterns(self) -> DataFrame:
        """Learned patterns: a row per brand, type and size."""
        return self.table("part").select(
            F.col("p_partkey").alias("pattern_id"),
            F.col("p_brand").alias("field_config"),
            F.col("p_type").alias("pattern_type"),
            F.concat(F.lit("^"), F.substring("p_name", 1, 4)).alias("pattern"),
            F.col("p_size").cast("long").alias("frequency"),
            (F.col("p_partkey") % 40).alias("usage_count"),
            F.floor((F.col("p_partkey") % 40) * (F.col("p_size") % 5) / 4).cast("long").alias("success_count"),
            (F.col("p_partkey") % 11).alias("priority"),
            (F.col("p_size") / 50.0).alias("match_rate"),
            (F.col("p_partkey") % 7 != 0).alias("is_active"),
            (F.col("p_partkey") % 60).cast("int").alias("idle_days"),
            ((F.col("p_partkey") % 9 - 4) / 10.0).alias("boost"),
        )

    @cached_property
    def jobs(self) -> DataFrame:
        """Jobs of the learning queue, from the event stream."""
        status = F.when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "failed").otherwise("completed")
        return self.table("events").select(
            F.col("event_id").alias("job_id"),
            (F.col("user_id") % 5 + 1).alias("template_id"),
            F.col("event_type").alias("type"),
            status.alias("status"),
            F.col("ts").alias("created_at"),
            F.col("value").alias("duration"),
            F.col("props").alias("payload"),
            F.col("user_id").alias("field_id"),
        )


def adapter_sql(query: str) -> str:
    """``query`` over the relations, in SQL that DuckDB runs on the tables."""
    order = ", ".join(LINE_ORDER)
    return f"""
with recursive templates_x as (select row_number() over (order by name) as template_id, name from (select distinct c_mktsegment as name from customer)),
docs_x as (
  select o_orderkey as document_id, template_id, name as template_name, o_orderdate as created_at,
         case o_orderstatus when 'F' then 'validated' when 'O' then 'extracted' else 'pending' end as status,
         case o_orderpriority when '1-URGENT' then 'baseline' when '2-HIGH' then null else 'adaptive' end as phase,
         cast(floor(o_totalprice) as bigint) % 5000 as extraction_time_ms, c_nationkey as created_by
  from orders join customer on o_custkey = c_custkey join templates_x on name = c_mktsegment),
lines_x as (
  select * from (select *, row_number() over (partition by l_orderkey, l_linenumber order by {order}) as rn from lineitem)
  join part on p_partkey = l_partkey where rn = 1),
facts as (
  select l_orderkey as document_id, 'field_' || l_linenumber as field_name, case when l_partkey % 17 = 0 then '' else p_name end as value,
         p_name || ' ' || p_type as truth, l_discount * 10 as confidence,
         case l_suppkey % 3 when 0 then 'crf' when 1 then 'rule_based' else 'position_based' end as method, l_partkey, l_linenumber as position
  from lines_x),
feedback as (
  select l_orderkey * 100 + l_linenumber as feedback_id, l_orderkey as document_id, 'field_' || l_linenumber as field_name,
         case when l_partkey % 17 = 0 then '' else p_name end as original_value,
         case when l_partkey % 5 = 0 then (case when l_partkey % 17 = 0 then '' else p_name end) || ' ' else p_name || ' ' || p_type end as corrected_value,
         l_shipdate as created_at, l_partkey % 2 = 0 as used
  from lines_x where l_returnflag = 'R'),
attempts as (
  select l_orderkey as document_id, 'field_' || l_linenumber as field_name, s.strategy, s.idx, (l_partkey + s.idx) % 4 <> 0 as success,
         case when (l_partkey + s.idx) % 3 = 0 then p_name || ' ' || p_type else p_name end as value, l_discount * 10 / (s.idx + 1) as confidence
  from lines_x, (values (0, 'crf'), (1, 'rule_based'), (2, 'position_based')) s(idx, strategy)),
patterns as (
  select p_partkey as pattern_id, p_brand as field_config, p_type as pattern_type, '^' || substr(p_name, 1, 4) as pattern, cast(p_size as bigint) as frequency,
         p_partkey % 40 as usage_count, cast(floor((p_partkey % 40) * (p_size % 5) / 4) as bigint) as success_count, p_partkey % 11 as priority,
         p_size / 50.0 as match_rate, p_partkey % 7 <> 0 as is_active, cast(p_partkey % 60 as integer) as idle_days, (p_partkey % 9 - 4) / 10.0 as boost
  from part),
jobs as (
  select event_id as job_id, user_id % 5 + 1 as template_id, event_type as type,
         case event_type when 'click' then 'pending' when 'view' then 'running' when 'error' then 'failed' else 'completed' end as status,
         ts as created_at, value as duration, props as payload, user_id as field_id
  from events)
{query}"""
