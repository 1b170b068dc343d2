"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import contentsort, divergence, fingerprints, licenses, lines, mixing, neardup, negatives, packing, tokencounts, topk, toxicity, warc
from fieldloom.llm.common import table


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products for every vector whose id is divisible by 100, against all others."""
    rows = topk.weighted_terms(table(spark, sf_dir, "embeddings"))
    best = topk.exact_top_k(rows, rows.where("id % 100 = 0"), k=10)
    return best.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, with both likenesses and its near fingerprints."""
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through legacy archives to WARC files and back."""
    return warc.pages_through_archives(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, which of its lines repeat an earlier line of the corpus."""
    return lines.line_report(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 1024 tokens as best fit finds."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), packing.Capacity(tokens=1024))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License of every document, from its own lines or the nearest directory above it."""
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs.withColumn("path", licenses.repository_path(F.col("doc_id"), F.col("source"))))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; links at four bits."""
    found = neardup.simhash_components(table(spark, sf_dir, "documents"), radius=4, shingle_words=4)
    return found.select("doc_id", neardup.fingerprint_hex().alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated probability of every document and whether it is sampled."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token count of every document."""
    return tokencounts.token_counts(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the words of each source diverge from the other sources and from the whole of its language."""
    return divergence.divergence_audit(table(spark, sf_dir, "documents"), min_docs=30, top_terms=50)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every positive of the vectors whose id is divisible by 100; labels of ids divisible by 7 move on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(negatives.labelled_vectors(table(spark, sf_dir, "embeddings"), label=label), F.col("id") % 100 == 0)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the row that stays of its group of equal normalised texts."""
    return contentsort.duplicate_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        pipeline,
        op1_exact_top_k,
        op2_fingerprints,
        op3_warc,
        op4_line_dedup,
        op5_best_fit_packing,
        op6_license_scan,
        op7_simhash_near_dedup,
        op8_mixing,
        op9_toxicity,
        op10_token_counts,
        op11_source_divergence,
        op12_hard_negatives,
        op13_exact_dedup,
    )
}

ORACLE: dict[str, str] = {
    "op1_exact_top_k": """
        with v as (select vec_id as id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as w
                   from embeddings
                   where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
             s as (select q.id as query_id, c.id as vec_id,
                          cast(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) as bigint) as score
                   from v q join v c on q.id % 100 = 0 and c.id <> q.id),
             r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10""",
    "op11_source_divergence": divergence.AUDIT_SQL,
    "op12_hard_negatives": negatives.MINE_SQL,
    "op13_exact_dedup": contentsort.REPORT_SQL,
    "op6_license_scan": licenses.scan_sql(),
    "op8_mixing": mixing.mix_sql(),
    "op3_warc": """
        with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages),
             l as (select d, max(page_id) as last, count(*) as c from p where n >= 1000 group by d)
        select page_id, n as payload_bytes, p.d as payload_digest,
               case when l.c > 1 and page_id is distinct from last then 'revisit' else 'response' end as record_type,
               case when l.c > 1 and page_id is distinct from last then last end as refers_to
        from p left join l on l.d = p.d and n >= 1000""",
}
