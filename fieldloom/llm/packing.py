"""Vector best-fit packing of token sequences: tokens, documents and attention cost under one plan."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import fresh_names, materialize

END_ID = 2
CACHE_ENTRIES = 800_000  # of a task's chunk cache; what comes later is encoded each time
PART_ROWS = 50_000  # pieces of one length that are ranked together


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte in the vocabulary file: visible Latin-1 characters stand for themselves, other bytes for those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(other)}


class ChunkEncoder:
    """Byte-level BPE ids of a text as little-endian 32-bit bytes, each distinct blank-separated chunk encoded once.

    ``path`` is a ``tokenizers`` file. Its vocabulary numbers the merges in order, so the ids are the ranks
    that ``tiktoken`` merges by, several times faster and with the same ids (tests compare the two). The
    pre-tokenizer never joins characters across a single blank between two visible ones, so chunks cut there
    encode alone as they do in the text. Texts where white space meets a blank or the end encode as a whole,
    and so do texts with one of the file's added tokens, which is its own id wherever it stands.
    """

    def __init__(self, path: str):
        import json
        import re

        import public_tokenizers
        import tiktoken

        alphabet = byte_alphabet()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        added = {x["content"]: x["id"] for x in file.get("added_tokens") or ()}
        ranks = {bytes(alphabet[c] for c in token): rank for token, rank in file["model"]["vocab"].items() if token not in added}
        self.bpe = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.added = list(added)
        self.whole = re.compile(r"\s(?= )|\s\Z|\A ")
        self.cache: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array("I", self.bpe.encode(text, allowed_special="all")).tobytes()

    def _miss(self, chunk: str) -> bytes:
        ids = self._ids(chunk)
        if len(self.cache) < CACHE_ENTRIES:
            self.cache[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if "\0" in text or self.whole.search(text) or any(x in text for x in self.added):
            return self._ids(text)
        get, miss = self.cache.get, self._miss
        return b"".join([get(c) or miss(c) for c in text.replace(" ", "\0 ").split("\0")])


def token_pieces(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``piece`` (int from 0), ``start``, ``length``, ``ids_crc32`` per piece, and ``ids`` (array of int) if asked for.

    A document is the ids of its text (null: empty) and then id 2. Longer ones than ``capacity`` are cut so
    that all pieces but the first are full. Whole texts are read; nothing is shuffled. Null ids and repeated
    rows are documents like any other.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        encoder = ChunkEncoder(path)
        for batch in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = memoryview(encoder.encode(text.as_py() or "") + END_ID.to_bytes(4, "little"))
                n = len(raw) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                    if with_ids:
                        ids.append(np.frombuffer(raw[4 * a : 4 * b], "<i4"))
            arrays = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(ids, pa.list_(pa.int32()))], names=[*names, "ids"]) if with_ids else pa.RecordBatch.from_arrays(arrays, names=names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most, and how its three capacities weigh in the choice of a bin.

    ``attention`` is the sum of squared piece lengths (the cost of attention inside documents). ``rule`` is
    ``norm`` (least weighted residual norm after placing) or ``dot`` (largest weighted dot product of the
    piece with the residual).
    """

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"

    def vector(self) -> tuple[int, int, int]:
        return self.tokens, self.documents or self.tokens, self.attention or self.tokens**2

    def holds(self, length: int) -> bool:
        """Whether a piece of that length fits an empty sequence."""
        return all(size <= most for size, most in zip((length, 1, length * length), self.vector()))


def plan_bins(histogram: dict[int, int], cap: Capacity) -> list[tuple[int, int, int, int, int, int]]:
    """Vector best-fit over counts of lengths, longest first: runs ``(length, first, n, per_bin, bin, offset)``.

    Pieces ``first .. first + n - 1`` of that length go to the bins from ``bin`` on, ``per_bin`` in each, at
    ``offset``. Pieces of one length are alike, and so are bins with one residual, so the plan handles runs
    of them: its size follows the number of lengths (at most ``cap.tokens``), not of documents. A piece that
    alone breaks a constraint raises ValueError.
    """
    full = cap.vector()
    groups: list[list] = []  # first bin, bins, residual
    runs, bins = [], 0

    def fits(size: tuple, residual: tuple) -> int:
        return min(r // s for r, s in zip(residual, size))

    def score(size: tuple, residual: tuple) -> float:
        if cap.rule == "dot":
            return -sum(w * s * r / f / f for w, s, r, f in zip(cap.weights, size, residual, full))
        return sum(w * ((r - s) / f) ** 2 for w, s, r, f in zip(cap.weights, size, residual, full))

    for length in sorted(histogram, reverse=True):
        size, left, done = (length, 1, length * length), histogram[length], 0
        if not cap.holds(length):
            raise ValueError(f"a piece of {length} tokens breaks a capacity")
        while left:
            open_ = [g for g in groups if fits(size, g[2])]
            if open_:
                group = min(open_, key=lambda g: (score(size, g[2]), g[0]))
                groups.remove(group)
            else:  # by the norm a new bin takes as many as it can; by the dot product all new bins take one each
                per = fits(size, full)
                group = [bins, -(-left // per), full]
                bins += group[1]
            first, count, residual = group
            per = 1 if cap.rule == "dot" else fits(size, residual)
            whole, rest = (min(count, left // per), 0)
            if whole < count and left > whole * per:
                rest = left - whole * per
            used = full[0] - residual[0]
            for at, n, each in ((first, whole, per), (first + whole, bool(rest), rest)):
                if n:
                    runs.append((length, done, n * each, each, at, used))
                    done += n * each
                    groups.append([at, int(n), tuple(r - each * s for r, s in zip(residual, size))])
            taken = whole + bool(rest)
            if taken < count:
                groups.append([first + taken, count - taken, residual])
            left = histogram[length] - done
    return runs


def pack(pieces: DataFrame, cap: Capacity = Capacity(), id_cols: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (with ``length``) plus ``sequence_id`` and ``offset`` (longs).

    The lengths' histogram (at most ``cap.tokens`` rows, whatever the input) is planned by best fit; the
    runs of that plan go to the pieces by rank within their length. A piece that fills a sequence needs no
    rank. Other lengths are ranked in parts of about ``PART_ROWS`` with counted offsets, so that no length is
    gathered in one task. Sequences are gapless from offset 0. Ties between equal pieces are broken by
    ``id_cols``; null ids are ids like any other, repeated rows are packed as pieces of their own; rows whose
    length is null or not positive are an error, and so is a piece that alone breaks a capacity. An empty
    table gives an empty table.
    """
    spark = pieces.sparkSession
    part, rank, base = fresh_names(pieces, "part", "rank", "base")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(x is None or x < 1 for x in histogram):
        raise ValueError("every piece needs a positive length")
    if cap.tokens in histogram and not cap.holds(cap.tokens):
        raise ValueError(f"a piece of {cap.tokens} tokens breaks a capacity")
    planned = plan_bins({x: n for x, n in histogram.items() if x != cap.tokens}, cap)
    bins = 1 + max((at + -(-n // per) - 1 for _, _, n, per, at, _ in planned), default=-1)

    fields = ("length", "first", "n", "per", "bin", "place")
    plan = spark.createDataFrame(planned, T.StructType([T.StructField(x, T.LongType()) for x in fields]))
    plan = plan.select("length", *(F.col(x).alias(f"run_{x}") for x in fields[1:]))
    many = [(x, -(-n // PART_ROWS)) for x, n in histogram.items() if n > PART_ROWS]
    parts = F.coalesce(F.get(F.lit([dict(many).get(x, 1) for x in range(cap.tokens + 1)]), F.col("length").cast("int")), F.lit(1))
    dealt = pieces.where(F.col("length") != cap.tokens).withColumn(part, F.pmod(F.xxhash64(*id_cols), parts.cast("long")))
    counts = dealt.groupBy("length", part).agg(F.count("*").alias("n"))
    below = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # One row per part, of which a length has its share of the rows over PART_ROWS.
    bases = counts.select("length", part, F.coalesce(F.sum("n").over(below), F.lit(0)).alias(base))
    in_part = Window.partitionBy("length", part).orderBy(*id_cols)
    ranked = dealt.withColumn(rank, F.row_number().over(in_part) - 1).join(bases.hint("merge"), ["length", part])
    ranked = ranked.withColumn(rank, F.col(rank) + F.col(base))
    # The plan has a few runs for each length up to the capacity, so it is broadcast.
    placed = ranked.join(F.broadcast(plan), "length").where(F.expr(f"`{rank}` >= run_first and `{rank}` < run_first + run_n"))
    placed = placed.withColumn("sequence_id", F.expr(f"run_bin + (`{rank}` - run_first) div run_per")).withColumn("offset", F.expr(f"run_place + ((`{rank}` - run_first) % run_per) * length"))
    kept = [*pieces.columns, "sequence_id", "offset"]
    filled = pieces.where(F.col("length") == cap.tokens)
    # Distinct without a count of all rows before it: the task's number and the row's place in it.
    filled = filled.withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(bins)).withColumn("offset", F.lit(0).cast("long"))
    return placed.select(*kept).unionByName(filled.select(*kept))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``ids``: the tokens of each sequence, from ``pack_documents(..., with_ids=True)``."""
    pieces = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(pieces["ids"]).alias("ids"))


def pack_documents(docs: DataFrame, cap: Capacity = Capacity(), tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``token_pieces`` of every document, packed by ``pack``. Columns other than id and text are not read."""
    return pack(materialize(token_pieces(docs, cap.tokens, tokenizer, id_col, text_col, with_ids), "pack-pieces"), cap)
