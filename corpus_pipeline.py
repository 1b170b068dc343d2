"""From raw documents to packed training sequences: five stages, each one operator over all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import lines, mixing, neardup, packing, toxicity
from fieldloom.llm.common import Workspace, table

SEQUENCE_TOKENS = 1024

#: No SQL: stages 1, 3 and 5 hash and tokenize in ways that SQL hasn't.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the classifier's cut.

    The classifier learns from the labelled rows of ``docs`` that are not held out. Null and empty texts have
    its prior score, so they stay; repeated rows go or stay together; an empty table stays empty.
    """
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier line; ``n_chars`` follows the text.

    No row goes: a text that loses all its lines is empty, a null one stays null (``n_chars`` null). Lines go from
    the row they stand in, also where rows share an id or have none; an empty table stays empty.
    """
    kept = lines.without_duplicate_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the least id (``neardup.without_near_copies``).

    Texts without a word are copies of each other; of rows equal in id and text one stays.
    """
    return neardup.without_near_copies(docs, radius=4, shingle_words=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of nine tenths of the tokens whose shares by source, language and topic are the tempered ones.

    Nulls of a dimension count as "unknown"; rows that share an id, or have none, are drawn together; where no
    text has a token all rows stay; an empty table stays empty.
    """
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in the packed sequences.

    A null or empty text is one piece of one token; repeated rows are packed each; an empty table gives no piece.
    """
    return packing.pack_documents(docs, packing.Capacity(tokens=SEQUENCE_TOKENS))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written as Parquet and read again by the next.

    A stage's own tables go when its result is written, and that when the next stage's is.
    """
    docs = table(spark, sf_dir, "documents")
    with Workspace(spark) as results:
        for name, stage in STAGES[:-1]:
            done = list(results.paths)
            with Workspace(spark) as own:
                docs = own.give(stage(spark, docs, sf_dir), f"stage-{name}")
            results.drop(done)
        name, stage = STAGES[-1]
        return results.give(stage(spark, docs, sf_dir), f"stage-{name}")
