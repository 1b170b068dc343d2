"""Document fingerprints (SimHash) and permuted block tables, in DataFrame functions only."""

from __future__ import annotations

import json
import math
from collections import Counter
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm import graph
from fieldloom.llm.common import Workspace, materialize, sized

WORDS = ("hi", "lo")  # a fingerprint is two longs
BITS = 64 * len(WORDS)
LANES = 0x0000000100000001  # two 32-bit counters in one long
# Bits within which fingerprints are near. Texts at cosine c differ in about 128 * arccos(c) / pi bits; one word changed in
# a hundred leaves c = 0.98 of two-word terms and 8 bits on average.
RADIUS = 8
BUCKET_ROWS, MAX_BUCKETS = 2_000, 50_000


def text_key(text: str = "text") -> Column:
    """A 64-bit key of a text; equal texts share their votes under it."""
    return F.xxhash64(F.col(text))


def _terms(text: Column, shingle_words: int) -> Column:
    """Array of (hash, weight): runs of ``shingle_words`` lower-cased words, repeats included, weighing their code points."""
    words = F.array_remove(F.split(F.lower(text), r"\s+"), "")

    def terms(w: Column) -> Column:
        at = [lambda i, k=k: F.get(w, i + k) for k in range(shingle_words)]
        full = F.transform(
            F.sequence(F.lit(0), F.size(w) - shingle_words),
            lambda i: F.struct(F.xxhash64(*(a(i) for a in at)).alias("h"), sum((F.length(a(i)) for a in at), F.lit(0)).cast("long").alias("w")),
        )
        whole = F.array(F.struct(F.xxhash64(F.array_join(w, " ")).alias("h"), F.greatest(F.length(F.array_join(w, "")), F.lit(1)).cast("long").alias("w")))
        return F.when(F.size(w) >= shingle_words, full).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<struct<h:bigint,w:bigint>>"))

    return F.element_at(F.transform(F.array(words), terms), 1)  # the words are split once


def fingerprints(texts: DataFrame, shingle_words: int = 2, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """``by``, ``rows``, ``hi``, ``lo`` for each distinct ``by`` of rows with a ``text``; ``by`` stands for one text.

    Every term votes with its weight for the set bits of its hash and against the others; a bit of the
    fingerprint is one where the signed votes are above zero. Two bits' votes share a long, so one hash
    aggregate holds all 128, and partial sums leave each task as one row per text. Texts without a word (null
    and empty ones too) have fingerprint zero. Repeated rows multiply all votes alike; ``rows`` counts them.
    """
    term = texts.select(*by, F.posexplode_outer(_terms(F.col("text"), shingle_words)).alias("at", "t")).select(*by, "at", "t.w", F.col("t.h").alias("hi"))
    term = term.withColumn("lo", F.xxhash64("hi", F.lit(1)))
    sums = [F.sum(F.shiftrightunsigned(x, b).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"{x}{b}") for x in WORDS for b in range(32)]
    votes = term.groupBy(*by).agg(F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("rows"), F.sum("w").alias("w"), *sums)

    def bits(x: str) -> Column:
        out = F.lit(0).cast("long")
        for b in range(32):
            low, high = F.col(f"{x}{b}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"{x}{b}", 32)
            for votes_for, bit in ((low, b), (high, b + 32)):
                # Votes for minus votes against.
                out = out.bitwiseOR(F.when(votes_for * 2 - F.col("w") > 0, F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
        return out

    return votes.select(*by, "rows", *(bits(x).alias(x) for x in WORDS))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1 - sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)), F.lit(0)) / F.lit(BITS)


def fingerprint_hex(hi: Column, lo: Column) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(x)), 16, "0") for x in (hi, lo)))


def _masks(radius: int, spare: int, parts: int) -> list[list[tuple[int, int]]]:
    """Signed bit masks of each part's tables: ``spare`` blocks of the part, moved nowhere but kept in place.

    Two fingerprints within the radius are, in one part at least, within that part's share of the radius: the
    shares add up to ``radius - parts + 1``, so exceeding each of them takes more than ``radius`` bits. A part
    has as many blocks as its share and ``spare`` more.
    """
    parts = min(parts, radius + 1)
    out = []
    for part in range(parts):
        start, end = BITS * part // parts, BITS * (part + 1) // parts
        blocks = (radius - parts + 1 + part) // parts + spare
        edges = [start + (end - start) * k // blocks for k in range(blocks + 1)]
        tables = []
        for chosen in combinations(range(blocks), spare):
            bits = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
            tables.append(tuple(x - (1 << 64) if x >> 63 else x for x in (bits >> 64, bits & ((1 << 64) - 1))))
        out.append(tables)
    return out


def near_fingerprints(fps: DataFrame, radius: int = RADIUS, spare: int = 2, parts: int = 2) -> DataFrame:
    """All pairs of distinct fingerprints within ``radius`` bits: ``hi_a``, ``lo_a``, ``hi_b``, ``lo_b``, ``distance``.

    The bits are cut into ``parts``, each with a share of the radius, and those into blocks; two fingerprints
    within a part's share agree in at least ``spare`` of its blocks, so each choice of ``spare`` blocks is a
    table keyed by those blocks, and every pair meets in one table at least (``_masks``). At the defaults
    there are 25 tables, keyed by 21 bits or more. A pair is made only in the first table where it meets,
    and then verified. Equal fingerprints are one entry, so copies make no pairs; nulls take no part. As many
    pairs come out as there are: of large groups of near copies, ``near_groups`` says who belongs together.
    """
    distinct = materialize(fps.select(*WORDS).where("hi is not null and lo is not null").distinct(), "simhash-distinct")
    masks = [mask for tables in _masks(radius, spare, parts) for mask in tables]
    every = F.from_json(F.lit(json.dumps([{"t": t, "h": h, "l": low} for t, (h, low) in enumerate(masks)])), "array<struct<t:int,h:bigint,l:bigint>>")
    found, t, rows = [], 0, distinct.count()
    for tables in _masks(radius, spare, parts):
        entry = distinct.select(*WORDS, F.explode(F.slice(every, t + 1, len(tables))).alias("m"))
        key = F.xxhash64("m.t", F.col("hi").bitwiseAND(F.col("m.h")), F.col("lo").bitwiseAND(F.col("m.l")))
        a, b = (entry.select(F.col("hi").alias(f"hi_{s}"), F.col("lo").alias(f"lo_{s}"), key.alias("key"), F.col("m.t").alias("t")) for s in "ab")
        dh, dl = F.col("hi_a").bitwiseXOR(F.col("hi_b")), F.col("lo_a").bitwiseXOR(F.col("lo_b"))
        pairs = a.join(sized(b, rows * len(tables)), ["key", "t"]).where("hi_a < hi_b or (hi_a = hi_b and lo_a < lo_b)").withColumn("distance", F.bit_count(dh) + F.bit_count(dl)).where(F.col("distance") <= radius)
        met = F.exists(every, lambda m: (m["t"] < F.col("t")) & (dh.bitwiseAND(m["h"]) == 0) & (dl.bitwiseAND(m["l"]) == 0))
        found.append(materialize(pairs.where(~met).select("hi_a", "lo_a", "hi_b", "lo_b", "distance"), "simhash-near"))
        t += len(tables)
    return reduce(DataFrame.unionByName, found)


def table_sizes(rows: int, radius: int = RADIUS, parts: int = 2) -> int:
    """The least ``spare`` for which all keys of the block tables have a bit more than ``rows`` has, or 4."""
    def bits(spare: int) -> int:
        ones = [sum((x & (2**64 - 1)).bit_count() for x in mask) for tables in _masks(radius, spare, parts) for mask in tables]
        return min(ones)

    return next((spare for spare in (2, 3) if bits(spare) > rows.bit_length()), 4)


def near_groups(fps: DataFrame, radius: int = RADIUS, parts: int = 2) -> DataFrame:
    """``hi``, ``lo``, ``near_group`` for each distinct fingerprint of ``fps`` (``hi``, ``lo``, ``doc_id``).

    A group is what links of at most ``radius`` bits connect, named by its least ``doc_id`` (null if it has
    none). Links are found in permuted block tables as by ``near_fingerprints``, but only between groups
    that neighbours in the tables have not joined yet (``graph.linked_components``), so a large group makes
    no pairs of all its members. Keys take more blocks where there are more fingerprints; the links are the same.
    """
    with Workspace(fps.sparkSession) as work:
        nodes = fps.groupBy(*WORDS).agg(F.min("doc_id").alias("first_id")).select(*WORDS, F.xxhash64(*WORDS).alias("node"), "first_id")
        nodes = work.keep(nodes, "simhash-distinct")
        rows = nodes.count()
        masks = [mask for tables in _masks(radius, table_sizes(rows, radius, parts), parts) for mask in tables]
        every = F.from_json(F.lit(json.dumps([{"t": t, "h": h, "l": low} for t, (h, low) in enumerate(masks)])), "array<struct<t:int,h:bigint,l:bigint>>")

        def index(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
            entry = df.select(*columns, F.explode(every).alias("m"))
            key = F.xxhash64("m.t", F.col("hi").bitwiseAND(F.col("m.h")), F.col("lo").bitwiseAND(F.col("m.l")))
            # Neighbours are near in bits that the key lacks: the leading ones of either word.
            sub = F.shiftrightunsigned("hi", 60) * 16 + F.shiftrightunsigned("lo", 60)
            return entry.select(*columns, key.alias("key"), sub.alias("sub"))

        def near(a: str, b: str) -> Column:
            return sum((F.bit_count(F.col(f"{w}{a}").bitwiseXOR(F.col(f"{w}{b}"))) for w in WORDS), F.lit(0)) <= radius

        groups = graph.linked_components(nodes, WORDS, index, near)
        return work.give(nodes.join(sized(groups, rows), "node").select(*WORDS, F.col("component_id").alias("near_group")), "simhash-groups")


def _bucket_of(value: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are at most ``value``, looked up in two steps of about the root of their number."""
    step = max(1, math.isqrt(len(bounds)))
    every, coarse = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>") for x in (bounds, bounds[::step]))
    passed = F.greatest(F.size(F.filter(coarse, lambda x: x <= value)) - 1, F.lit(0)) * step
    return (passed + F.size(F.filter(F.slice(every, passed + 1, step), lambda x: x <= value))).cast("int")


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text``, ``next_id``, ``next_text``: the next document by descending id, after the last the first.

    Null texts are empty. Null ids come last; equal ids are ordered by a hash of the text, then the text,
    descending. A single row is its own next. The ids are cut at quantiles into buckets of about
    ``BUCKET_ROWS`` rows, an id (or none) that many rows share into ranges of the hash; every bucket also
    receives the first row of the one after it, so one shuffle puts each text beside its neighbour and no
    bucket holds more than its share, unless a row itself is repeated that often.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"at": F.coalesce("doc_id", F.lit(-(2**63))), "hash": text_key()})
    n = rows.count()
    parts = min(MAX_BUCKETS, n // BUCKET_ROWS)
    cuts = [int(x) for x in rows.select(F.percentile_approx("at", [k / parts for k in range(1, parts)], 20 * parts).alias("x")).first()["x"]] if parts > 1 else []
    shared = {at: n for at, n in Counter(cuts).items() if n > 1}
    bucket = _bucket_of(F.col("at"), sorted(set(cuts))) if cuts else F.lit(0)
    many = F.try_element_at(F.create_map(*(F.lit(x) for pair in shared.items() for x in pair)), F.col("at")) if shared else F.lit(None).cast("int")
    part = F.when(many.isNull(), F.lit(MAX_BUCKETS)).otherwise(F.floor((F.col("hash") / F.lit(2.0**64) + 0.5) * many)).cast("int")
    rows = rows.withColumn("bucket", F.struct(bucket.alias("range"), part.alias("part")))
    # One place per bucket, at most twice MAX_BUCKETS.
    heads = {tuple(r["bucket"]): tuple(r["head"]) for r in rows.groupBy("bucket").agg(F.max(F.struct("at", "hash")).alias("head")).collect()}
    order = sorted(heads, reverse=True)
    guests = [(*heads[after], before) for before, after in zip(order, [*order[1:], *order[:1]])]
    guests = docs.sparkSession.createDataFrame(guests, "at long, hash long, host struct<range:int,part:int>")
    visiting = rows.join(F.broadcast(guests), ["at", "hash"]).groupBy("host", "doc_id", "at", "hash").agg(F.max("text").alias("text"))
    own = rows.select("doc_id", "text", "at", "hash", "bucket", F.lit(0).alias("guest"))
    every = own.unionByName(visiting.select("doc_id", "text", "at", "hash", F.col("host").alias("bucket"), F.lit(1).alias("guest")))
    beside = Window.partitionBy("bucket").orderBy("guest", F.desc("at"), F.desc("hash"), F.desc("text"))
    return every.withColumns({f"next_{c}": F.lead(x).over(beside) for c, x in (("id", "doc_id"), ("text", "text"))}).where("guest = 0").select("doc_id", "text", "next_id", "next_text")


def edited_fingerprints(docs: DataFrame, radius: int = RADIUS, shingle_words: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every text and its edited text, one row per input row.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as many, or all, of
    the next document's first ones (``with_next_text``). Columns: ``doc_id``, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint`` (32 hex digits; zeros for a text without a word), ``near_edited``,
    ``near_next`` (share of equal bits) and ``near_group``, the least id of the documents that links of at
    most ``radius`` bits connect with this one, its own included (null where none of them has an id).
    Repeated rows stay rows; an empty table gives an empty table; columns other than id and text are not read.
    """
    with Workspace(docs.sparkSession) as work:
        rows = with_next_text(docs, id_col, text_col)
        half = F.expr("char_length(text) div 2").cast("int")
        kept = F.expr("substring(text, 1, char_length(text) - char_length(text) div 2)")
        edited = rows.select("doc_id", "text", "next_id", "next_text", F.char_length("text").cast("long").alias("n_chars"), F.concat(kept, F.col("next_text").substr(F.lit(1), half)).alias("edited"))
        keys = [F.col("doc_id"), F.col("next_id"), F.col("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), text_key("text").alias("own"), text_key("next_text").alias("beside")]
        both = edited.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("kind"), "text"), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x")).select("*", "x.*")
        # Both texts and all that is said of a row come out of one pass, so texts are shuffled once.
        columns = ("doc_id", "next_id", "n_chars", "edited_sha256", "own", "beside")
        made = work.keep(fingerprints(both, shingle_words, (*columns, "kind")), "simhash")
        of = {0: "own", 1: "edited"}
        pair = [F.max(F.when(F.col("kind") == k, F.col(w))).alias(f"{name}_{w}") for k, name in of.items() for w in WORDS]
        slim = made.groupBy(*columns).agg(F.max(F.when(F.col("kind") == 0, F.col("rows"))).alias("rows"), *pair)
        slim = work.keep(slim.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).drop("rows", "col"), "simhash-rows")

        # The next row is looked up by id and text; where both are this row's own, it has the same fingerprint.
        at = lambda c: F.coalesce(c, F.lit(-(2**63)))
        same = F.col("next_id").eqNullSafe(F.col("doc_id")) & (F.col("beside") == F.col("own"))
        known = slim.select(at("doc_id").alias("at"), F.col("own").alias("text_of"), *(F.col(f"own_{w}").alias(f"next_{w}") for w in WORDS)).distinct()
        out = slim.withColumns({"at": F.when(~same, at("next_id")), "text_of": F.when(~same, F.col("beside"))}).join(sized(known, slim.count()), ["at", "text_of"], "left")
        out = work.keep(out.select(*slim.columns, *(F.when(same, F.col(f"own_{w}")).otherwise(F.col(f"next_{w}")).alias(f"next_{w}") for w in WORDS)), "simhash-next")

        groups = near_groups(slim.select("doc_id", *(F.col(f"own_{w}").alias(w) for w in WORDS)), radius)
        groups = groups.select(*(F.col(w).alias(f"own_{w}") for w in WORDS), "near_group")
        out = out.join(sized(groups, groups.count()), [f"own_{w}" for w in WORDS])
        fp = {name: tuple(F.col(f"{name}_{w}") for w in WORDS) for name in ("own", "edited", "next")}
        out = out.select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            fingerprint_hex(*fp["own"]).alias("fingerprint"),
            fingerprint_hex(*fp["edited"]).alias("edited_fingerprint"),
            likeness(fp["own"], fp["edited"]).alias("near_edited"),
            likeness(fp["own"], fp["next"]).alias("near_next"),
            "near_group",
        )
        return work.give(out, "simhash-out")
