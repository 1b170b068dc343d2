"""SimHash near-duplicates: a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import graph
from fieldloom.llm.common import Workspace, fresh_names, materialize, sized

SEED = 42  # of the shingle hash
BYTES = 8  # of a fingerprint
BROADCAST_ROWS = 300_000  # rows that go up to which their places (some 40 bytes each) are broadcast
WIDE_ROWS = 4_000_000  # fingerprints from which keys have all the bytes that are sure to agree


def fingerprints(docs: DataFrame, shingle_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long), ``text_key`` (a hash of the text), one row per input row.

    Words are runs without ASCII white space, A-Z lowered; shingles of ``shingle_words`` words (fewer words:
    the whole sequence) hash by XXH64, and a bit is set where over half of the hashes have it. Null, empty
    and blank texts have fingerprint zero. Rows are independent: nothing is shuffled.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        digest, width = xxhash.xxh64_intdigest, shingle_words

        def fingerprint(text: bytes | None) -> int:
            words = (text or b"").lower().split()
            if not words:
                return 0
            joined = b" ".join(words)
            starts = [0, *accumulate(len(w) + 1 for w in words)]
            n = max(1, len(words) - width + 1)
            hashes = np.array([digest(joined[s : e - 1], SEED) for s, e in zip(starts, starts[min(width, len(words)) :])], dtype=">u8")
            votes = np.zeros(64, np.int64)
            for k in range(0, n, 1 << 15):
                bits = np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1)
                votes += bits.sum(axis=0, dtype=np.int64)
            return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big", signed=True)

        for batch in batches:
            fps = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), batch.column(2)], names=["doc_id", "fp", "text_key"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("text_key"))
    return slim.mapInArrow(run, "doc_id long, fp long, text_key long")


def position_sets(radius: int, wide: bool = False) -> list[tuple[int, ...]]:
    """Sets of byte positions that index a fingerprint.

    Two fingerprints within ``radius`` bits agree in at least ``BYTES - radius`` bytes, so they agree in all
    positions of at least one set. From four guaranteed bytes on, three positions make a key; the triples are
    those of a Turan design (three groups of positions; within a group, or two of a group and one of the
    next), of which every four positions contain one. ``wide`` sets have all the guaranteed positions, so that
    keys stay rare among very many fingerprints.
    """
    sure = BYTES - radius
    if sure < 1:
        raise ValueError(f"no byte is guaranteed to agree within {radius} bits")
    if sure < 4 or wide:
        return list(combinations(range(BYTES), sure))
    group = [0, 0, 0, 1, 1, 1, 2, 2]

    def kept(triple: tuple[int, ...]) -> bool:
        size = [sum(group[p] == g for p in triple) for g in range(3)]
        return 3 in size or any(size[g] == 2 and size[(g + 1) % 3] == 1 for g in range(3))

    return [t for t in combinations(range(BYTES), 3) if kept(t)]


def _byte(fp: str, position: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), 56 - 8 * position).bitwiseAND(F.lit(255))


def linked_components(fps: DataFrame, radius: int = 4) -> DataFrame:
    """``fp``, ``root``, ``component_id`` for distinct ``fp`` with ``first_id``: the component and the least ``first_id`` in it.

    A link joins fingerprints that differ in at most ``radius`` bits. The index has a posting list for each
    set of byte positions and their bytes (``position_sets``); of two members, the shared positional bytes
    are tallied, and pairs that reach the guaranteed count are verified by their bits. Which pairs meet at
    all is said by ``graph.linked_components``. From ``WIDE_ROWS`` fingerprints on keys have more bytes, so
    that unrelated ones seldom share a list; the links found are the same.
    """
    sets, sure = position_sets(radius, fps.count() > WIDE_ROWS), BYTES - radius

    def index(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        keys = []
        for number, positions in enumerate(sets):
            key = F.lit(number).cast("long")
            for p in positions:
                key = key * 256 + _byte("fp", p)
            spare = next((p for p in range(BYTES) if p not in positions), 0)
            keys.append(F.struct(key.alias("key"), _byte("fp", spare).alias("sub")))
        return df.select(*columns, F.explode(F.array(*keys)).alias("x")).select(*columns, "x.*")

    def near(a: str, b: str) -> Column:
        tally = sum(((_byte(f"fp{a}", p) == _byte(f"fp{b}", p)).cast("int") for p in range(BYTES)), F.lit(0))
        return (tally >= sure) & (F.bit_count(F.col(f"fp{a}").bitwiseXOR(F.col(f"fp{b}"))) <= radius)

    found = graph.linked_components(fps.select("fp", F.col("fp").alias("node"), "first_id"), ("fp",), index, near)
    return found.select(F.col("node").alias("fp"), "root", "component_id")


def simhash_components(docs: DataFrame, radius: int = 4, shingle_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` per input row.

    ``component_id`` is the least id reachable over fingerprints within ``radius`` bits, its own included.
    Equal fingerprints are one entry of the index, however many copies there are. Null ids keep a row, with
    the component of their fingerprint, but never name one. Repeated rows keep their rows. An empty table
    gives an empty table. Columns other than id and text are not read.
    """
    fps = materialize(fingerprints(docs, shingle_words, id_col, text_col), "fp-docs")
    found = _components_of(fps, radius)
    return fps.join(sized(found, found.count()), "fp").select("doc_id", "fp", "component_id")


def _components_of(fps: DataFrame, radius: int) -> DataFrame:
    with Workspace(fps.sparkSession) as work:
        distinct = work.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fp-distinct")
        return work.give(linked_components(distinct, radius), "fp-components")


def without_near_copies(docs: DataFrame, radius: int = 4, shingle_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of ``simhash_components``; all columns stay.

    The row with the least id stays (null ids last), of several with that id the one whose text has the least
    hash, and one of rows equal in id and text. So null, empty and blank texts, all of fingerprint zero, leave
    one row. An empty table gives an empty table. Columns may have any names.
    """
    with Workspace(docs.sparkSession) as work:
        fps = work.keep(fingerprints(docs, shingle_words, id_col, text_col), "fp-docs")
        found = _components_of(fps, radius)
        rows = work.keep(fps.join(sized(found, found.count()), "fp").groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("copies")), "fp-rows")
        best = work.keep(rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("best")), "fp-best")
        judged = rows.join(sized(best, best.count()), "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key")))
        judged = work.give(judged.where("not stays or copies > 1").select("doc_id", "text_key", "stays").distinct(), "fp-judged")
    names = fresh_names(docs, "id", "text_key")
    keyed = docs.withColumns({names[0]: F.col(id_col).cast("long"), names[1]: F.xxhash64(text_col)})

    def listed(stays: bool) -> tuple[DataFrame, object]:
        some = judged.where(F.col("stays") == stays).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
        few = some.count() <= BROADCAST_ROWS
        return (F.broadcast(some) if few else some.hint("merge")), F.col(names[0]).eqNullSafe(F.col("gone_id")) & (F.col(names[1]) == F.col("gone_key"))

    kept = keyed.join(*listed(False), "left_anti")
    if judged.where("stays").limit(1).count():  # rows equal in id and text, of which one stays
        again = kept.join(*listed(True), "left_semi").dropDuplicates(names)
        kept = kept.join(*listed(True), "left_anti").unionByName(again)
    return kept.select(*docs.columns)


def fingerprint_hex(fp: str = "fp") -> Column:
    """The fingerprint as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
