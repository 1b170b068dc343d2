"""Line dedup: an exact set-similarity join of lines, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import Workspace, fresh_names, materialize

NUM, DEN = 4, 5  # the least Jaccard similarity, as a fraction so that all comparisons are of integers
TABLE_BITS = 22  # of a word's hash that choose its place in the rarity table: 4 MB whatever the corpus
STEPS = 2  # of rarity in each doubling of a word's count
HASH = (1 << 56) - 1  # a token is a word's rarity above these bits of its hash
LIST = 512  # lines that a posting list is expected to have at most; a key takes more words beyond it
OFTEN = 64  # occurrences from which a word may be that of a large group
WIDE = 64  # words up to which common words are keyed by choices of them, and from 4/5 of which by neighbours
CROWD = 16  # lines from which a group meets its heads first
HEADS = 8  # parts of a group whose first lines are heads
BROADCAST_ROWS = 400_000  # rows (keys or places of lines, 60 bytes at most) up to which a table is broadcast
NULL_ID = -(2**63)  # stands for a null id, before all others
PARITY = ("odd", "odder")  # 64 bits, of which each token turns one, and what half of the tokens turn of them: lines that differ in few words differ in few bits
BRIEF = 96  # words up to which the 64 bits tell lines apart, so that nothing is made of the halves
GROUPS = ("first_pair", "second_pair", "third_pair")  # of neighbours among the words of a line that many lines hold
PLACE = ("doc", "text_key", "line_no")  # where a line stands; its order says which of two lines is earlier


def _words(lowered: Column) -> Column:
    """Runs without blanks of a lower-cased text; empty strings stand where blanks meet."""
    return F.split(lowered, " ")


def word_rarity(docs: DataFrame, text_col: str = "text", bits: int = TABLE_BITS, keep=materialize) -> DataFrame:
    """One row, ``rarity``: for each bucket of word hashes a byte that grows with the count of that bucket's words in all texts.

    The byte is ``STEPS`` times the binary logarithm, rounded down, and zero for one occurrence or none. The
    table has ``2 ** bits`` bytes whatever the corpus and is put together from pieces of 64. Any order of
    words makes the join exact; where words share a bucket, keys only take more words than they need.
    """
    word = docs.select(F.explode(_words(F.lower(F.replace(F.col(text_col), F.lit("\n"), F.lit(" "))))).alias("word"))
    counts = word.groupBy(F.shiftrightunsigned(F.xxhash64("word"), 64 - bits).alias("bucket")).agg(F.count("*").alias("n"))
    at, level = F.col("bucket").bitwiseAND(63).cast("int"), F.coalesce(F.floor(F.log2("n") * STEPS), F.lit(0)).cast("long")
    # Eight bytes of a piece are one long, so that numbers are added up and no piece needs a map.
    byte = F.expr("shiftleft(level, (at & 7) * 8)")
    longs = (F.sum(F.when(F.shiftright("at", 3) == k, byte).otherwise(F.lit(0).cast("long"))).alias(f"l{k}") for k in range(8))
    pieces = counts.select(F.shiftright("bucket", 6).alias("piece"), at.alias("at"), level.alias("level")).groupBy("piece").agg(*longs)
    every = docs.sparkSession.range(1 << bits - 6).join(pieces, F.col("id") == F.col("piece"), "left")
    dense = F.array(*(F.coalesce(F.shiftright(f"l{k}", 8 * m).bitwiseAND(127), F.lit(0)).cast("tinyint") for k in range(8) for m in range(8)))
    table = every.select("id", dense.alias("levels")).agg(F.flatten(F.sort_array(F.collect_list(F.struct("id", "levels")))["levels"]).alias("rarity"))
    return keep(table, "rarity")


def _level(token: Column) -> Column:
    return F.shiftright(token, 56).cast("int")


def _with_tokens(lines: DataFrame, rarity: DataFrame, bits: int) -> DataFrame:
    """``lines`` plus ``tokens``: distinct words as longs, rarest first. The table is a scalar subquery, so rows never carry it."""
    level = lambda h: F.coalesce(F.col("rarity")[F.shiftrightunsigned(h, 64 - bits)], F.lit(0).cast("tinyint"))
    token = lambda h: F.shiftleft(level(h).cast("long"), 56).bitwiseOR(h.bitwiseAND(F.lit(HASH)))
    hashes = F.array_remove(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))
    return lines.withColumn("rarity", rarity.scalar()).select(*lines.columns, F.sort_array(F.array_distinct(F.transform(hashes, token))).alias("tokens"))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # What a select computes beside an explode, it computes for each row made. So the text is hashed and cut below it.
    cut = docs.select(*_place_of(id_col, text_col), F.split(F.lower(text_col), "\n").alias("lines"))
    return cut.select("doc", "text_key", F.posexplode_outer("lines").alias("line_no", "line"))


def _place_of(id_col: str, text_col: str) -> list[Column]:
    """What says which row a line is in: the id and the text. Rows equal in both are one place."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(F.col(text_col)).alias("text_key")]


def _lacked() -> Column:
    """How many of its ``n`` words a line that is similar to this one lacks at most."""
    return F.expr(f"n - (n * {NUM} + {DEN - 1}) div {DEN}").cast("int")


def _differ() -> Column:
    """In how many words a similar line, of 5n / 4 words at most, and this one differ at most: a ninth of all their words."""
    return F.expr(f"(n + n * {DEN} div {NUM}) * {DEN - NUM} div {NUM + DEN}").cast("int")


def _repeats(docs: DataFrame, id_col: str, text_col: str, bits: int) -> DataFrame:
    """``doc``, ``text_key``, ``line_no`` of every line that repeats an earlier one, as often as rows have it."""
    with Workspace(docs.sparkSession) as work:
        rarity = word_rarity(docs, text_col, bits, work.keep)
        n = F.size("tokens")
        # A condition on the tokens would have them made twice.
        lines_ = _lines(docs, id_col, text_col).where(F.trim("line") != "")
        rows = _with_tokens(lines_, rarity, bits)
        odd = F.expr("aggregate(tokens, 0L, (bits, t) -> bits ^ shiftleft(1L, cast(t & 63 as int)))")
        odder = F.expr("aggregate(tokens, 0L, (bits, t) -> if(t & 64 = 64, bits ^ shiftleft(1L, cast(t & 63 as int)), bits))")
        parity = [odd.alias("odd"), F.when(n > BRIEF, odder).otherwise(F.lit(0).cast("long")).alias("odder")]
        rows = rows.select(*PLACE, F.xxhash64("line").alias("key"), n.alias("n"), *parity, "tokens")
        light = F.coalesce(_level(F.get("tokens", _lacked())) <= _steps(LIST), F.lit(True))
        head = F.greatest(F.when(F.col("n") <= WIDE, _lacked() + 3).otherwise(_lacked() + 1), F.when((F.col("n") * DEN >= WIDE * NUM) & ~light, _differ() * 3 + 3).otherwise(0))
        rows = rows.select(*PLACE, "key", "n", *PARITY, F.slice("tokens", F.lit(1), head).alias("head"))
        entries = rows.groupBy("key").agg(F.min(F.struct(*PLACE)).alias("place"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", *PARITY, "head")))
        often = F.filter(F.slice("head", F.lit(1), _lacked() + 3), lambda t: _level(t) > _steps(OFTEN))
        pair = lambda k: F.when(F.size("often") >= k + 2, F.xxhash64(F.get("often", F.lit(k)), F.get("often", F.lit(k + 1))))
        entries = entries.select("key", "place.*", "copies", "n", *PARITY, "head", often.alias("often"))
        entries = work.keep(entries.select("key", *PLACE, "copies", "n", *PARITY, "head", *(pair(k).alias(g) for g, k in zip(GROUPS, (0, 2, 4)))), "line-entries")

        check = [work, docs, entries, id_col, text_col]
        gone = work.keep(_later(_crowded(entries, work), *check), "line-gone")
        rest = _later(_met(postings(entries, gone)), *check)
        gone = gone.unionByName(rest).distinct()

        state = entries.select("key", *(F.col(c).alias(f"first_{c}") for c in PLACE), "copies").join(gone.withColumn("gone", F.lit(True)), "key", "left")
        state = work.keep(state.where("gone or copies > 1").drop("copies"), "line-state")
        few = state.count() <= BROADCAST_ROWS
        found = lines_.select(*PLACE, F.xxhash64("line").alias("key")).join(F.broadcast(state) if few else state, "key").where("gone or doc <> first_doc or text_key <> first_text_key or line_no <> first_line_no")
        return work.give(found.select(*PLACE), "line-repeats")


def _crowded(entries: DataFrame, work: Workspace) -> DataFrame:
    """``ka``, ``kb``: the entries of large groups, each with a few first entries and the most copied entry of its group.

    A group shares two neighbours among its words that many lines hold, so it is made of near copies and of
    little else. What is settled here need not be met by others of its group again; what is not is met as
    any other line. Nothing depends on which groups these are.
    """
    member = entries.select("key", *PLACE, "n", *PARITY, "copies", F.explode(F.array(*GROUPS)).alias("group")).where("group is not null")
    crowds = work.keep(member.groupBy("group").agg(F.count("*").alias("size")).where(F.col("size") >= CROWD).select("group"), "line-crowds")
    member = work.keep(member.join(F.broadcast(crowds) if crowds.count() <= BROADCAST_ROWS else crowds, "group"), "line-members")
    fields = {"kb": "key", "nb": "n", **{f"{p}b": p for p in PARITY}}
    told = F.struct(*PLACE, *(F.col(c).alias(x) for x, c in fields.items()))
    part = F.pmod(F.xxhash64("key"), F.lit(HEADS))
    early = member.groupBy("group", part.alias("part")).agg(F.min(told).alias("head")).select("group", "head")
    common = member.groupBy("group").agg(F.min(F.struct(-F.col("copies"), told.alias("head"))).alias("x")).select("group", "x.head")
    heads = early.unionByName(common).select("group", *(f"head.{x}" for x in fields)).distinct()
    a = member.select("group", F.col("key").alias("ka"), F.col("n").alias("na"), *(F.col(p).alias(f"{p}a") for p in PARITY))
    return a.join(heads, "group").where("ka <> kb").where(_alike()).select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb"))


def _steps(count: float) -> int:
    """The rarity of a word with that count."""
    return math.floor(math.log2(count) * STEPS)


def _room() -> Column:
    """Words in which lines of ``na`` and ``nb`` words may differ: the sizes less twice the overlap that the similarity needs."""
    return F.expr(f"na + nb - 2 * (((na + nb) * {NUM} + {NUM + DEN - 1}) div {NUM + DEN})")


def _alike() -> Column:
    """What sizes and parities of two similar lines satisfy: the length filter, and no more odd bits than words may differ."""
    turned, half = (F.col(f"{p}a").bitwiseXOR(F.col(f"{p}b")) for p in PARITY)
    halves = F.bit_count(half) + F.bit_count(turned.bitwiseXOR(half))
    odd = F.when(F.least("na", "nb") > BRIEF, halves).otherwise(F.bit_count(turned))
    return (F.least("na", "nb") * DEN >= F.greatest("na", "nb") * NUM) & (odd <= _room())


def postings(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """``token`` and what the join asks of a line: ``key``, ``doc``, ``n``, ``odd``, ``odder``, ``open``, ``miss``, ``wide``, ``prev``.

    Similar lines x and y share at least k of the first lacked + k words of both, words by rarity, for every
    k up to their overlap. If few lines have their first shared word, it is their key: it is among the first
    lacked + 1 words of both. Else all that they share is common, and so are words among the first lacked + 1 of
    either. Then the key is a choice of more words, in lines of ``WIDE`` words at most: the first two that they
    share, if few lines are expected to have both; else the first three (lines of two words, which match only
    such lines, stop at two, those of one word at one). ``miss`` is how many words before the key's last one are
    not in the key: none of them is shared.

    In lines of more words, and of at least 4/5 of ``WIDE`` for each other's sake, it is a run of neighbours, as
    choices grow with a power of the line: if x and y differ in D words, two neighbours are shared among the
    first 2D + 2 words of both together, and three among the first 3D + 3. The first such two are the key if few
    lines are expected to have both; else later ones are commoner still, and the first three are. So a word
    begins one key at most, and a line has fewer keys than words. ``miss`` is then the place of the first of them
    and ``prev`` the word before it (-1: none): where two lines agree in that too, an earlier run is shared.
    A word that occurs once in the corpus can't be shared.
    """
    lines_ = max(1, entries.count())
    often, paired = _steps(LIST), _steps(LIST * lines_)
    marks = gone.withColumn("gone", F.lit(True))
    open_ = entries.join(F.broadcast(marks) if gone.count() <= BROADCAST_ROWS else marks, "key", "left")
    base = open_.select("key", "doc", "n", *PARITY, F.col("gone").isNull().alias("open"), "head")
    kept = ("key", "doc", "n", *PARITY, "open")
    no = F.array(F.lit(-1).cast("long"))
    one = base.select(*kept, "head", _lacked().alias("d"), F.posexplode(F.slice("head", F.lit(1), _lacked() + 1)).alias("i", "t")).where(_level(F.col("t")) > 0)
    few = (_level(F.col("t")) <= often) | (F.col("n") == 1)
    two = one.where(few | (F.col("n") <= WIDE)).select(*kept, "head", "d", "i", "t", F.posexplode(F.when(few, no).otherwise(F.slice("head", F.col("i") + 2, F.col("d") + 1 - F.col("i")))).alias("j", "u"))
    few = (F.col("u") < 0) | (_level(F.col("t")) + _level(F.col("u")) <= paired) | (F.col("n") == 2)
    at = F.col("i") + F.col("j") + 1
    three = two.select(*kept, "i", "j", "t", "u", F.posexplode(F.when(few, no).otherwise(F.slice("head", at + 2, F.col("d") + 2 - at))).alias("k", "v"))
    chosen = three.select(F.xxhash64("t", "u", "v").alias("token"), *kept, (F.col("i") + F.col("j") + F.col("k")).alias("miss"), F.lit(False).alias("wide"), F.lit(-1).cast("long").alias("prev"))

    run = base.where(F.col("n") * DEN >= WIDE * NUM).select(*kept, "head", _differ().alias("most"), F.posexplode(F.slice("head", F.lit(1), _differ() * 3 + 1)).alias("miss", "t")).where(_level(F.col("t")) > often)
    prev = F.when(F.col("miss") > 0, F.get("head", F.col("miss") - 1)).otherwise(F.lit(-1).cast("long"))
    run = run.withColumns({"u": F.get("head", F.col("miss") + 1), "v": F.get("head", F.col("miss") + 2), "prev": prev})
    few = _level(F.col("t")) + _level(F.col("u")) <= paired
    token = F.when(few, F.when(F.col("miss") <= F.col("most") * 2, F.xxhash64("t", "u", F.lit(-2).cast("long")))).when(F.col("v").isNotNull(), F.xxhash64("t", "u", "v", F.lit(-3).cast("long")))
    return chosen.unionByName(run.select(token.alias("token"), *kept, "miss", F.lit(True).alias("wide"), "prev").where("token is not null"))


def _met(posting: DataFrame) -> DataFrame:
    """``ka``, ``kb``: entries that share a key, one of them not yet found to be a repeat, where sizes, parities and positions leave room for the similarity."""
    names = {"key": "k", "doc": "d", "n": "n", **{p: p for p in PARITY}, "miss": "m", "wide": "w", "prev": "p", "open": "open"}
    a, b = (posting.select("token", *(F.col(c).alias(f"{x}{s}") for c, x in names.items())) for s in "ab")
    # What is gone still counts as an earlier line of those that are not.
    once = F.expr("((opena and (openb or db <= da)) or (openb and da <= db)) and (na > nb or (na = nb and ka < kb))")
    # Words before a key that are not shared leave room for the overlap in either line. (Every condition is on both sides: one on a
    # single side would be pushed below the shuffle, and both sides are to read the same one.)
    need = F.expr(f"((na + nb) * {NUM} + {NUM + DEN - 1}) div {NUM + DEN}")
    # Of a run of shared neighbours only the beginning counts: near copies share most of their words, and would meet at each.
    begins = (F.col("pa") != F.col("pb")) | ((F.col("pa") == -1) & (F.col("pb") == -1))
    # Runs and choices are hashed apart, so tokens alone join them: a single long is sorted by its digits.
    runs = F.when(F.col("wa") & F.col("wb"), begins & (F.abs(F.col("ma") - F.col("mb")) <= _room()))
    fit = runs.when(~(F.col("wa") | F.col("wb")), (F.col("na") - F.col("ma") >= need) & (F.col("nb") - F.col("mb") >= need))
    pairs = a.join(b, a["token"] == b["token"]).where(once & _alike() & fit)
    return pairs.select(F.least("ka", "kb").alias("ka"), F.greatest("ka", "kb").alias("kb"))


def _later(pairs: DataFrame, work: Workspace, docs: DataFrame, entries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key``: the later entry of each pair whose whole word sets are similar enough.

    Only lines in a pair are read again, at their first place, and compared by 64-bit word hashes.
    """
    pairs = work.keep(pairs.distinct(), "line-pairs")
    keys = work.keep(pairs.select(F.col("ka").alias("key")).unionByName(pairs.select(F.col("kb").alias("key"))).distinct(), "line-keys")
    lines_ = entries.select("key", *PLACE).join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, "key")
    wanted = work.keep(lines_.groupBy("doc", "text_key").agg(F.collect_list(F.struct("line_no", "key")).alias("wanted")), "line-wanted")
    few = wanted.count() <= BROADCAST_ROWS
    text = docs.select(*_place_of(id_col, text_col), F.col(text_col).alias("text")).where("text is not null")
    cut = text.join(F.broadcast(wanted) if few else wanted, ["doc", "text_key"]).select("doc", "text_key", F.split(F.lower("text"), "\n").alias("lines"), "wanted")
    line = lambda w: F.struct(w["key"].alias("key"), w["line_no"].alias("line_no"), F.get("lines", w["line_no"]).alias("line"))
    found = cut.select("doc", "text_key", F.explode_outer(F.transform("wanted", line)).alias("w"))
    found = found.select(F.col("w.key").alias("key"), F.struct("doc", "text_key", "w.line_no").alias("place"), F.col("w.line").alias("line")).where(F.xxhash64("line") == F.col("key"))
    words = F.array_remove(F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    sets = work.keep(found.select("key", "place", words.alias("words")).dropDuplicates(["key"]), "line-sets")
    a, b = (sets.select(F.col("key").alias(f"k{s}"), F.col("place").alias(f"p{s}"), F.col("words").alias(f"w{s}")) for s in "ab")
    both = F.size(F.array_intersect("wa", "wb"))
    similar = pairs.join(a, "ka").join(b, "kb").where(both * (NUM + DEN) >= (F.size("wa") + F.size("wb")) * NUM)
    return similar.select(F.when(F.col("pa") < F.col("pb"), F.col("kb")).otherwise(F.col("ka")).alias("key")).distinct()


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = TABLE_BITS) -> DataFrame:
    """``doc_id``, ``line_no`` (from 0) of every line that repeats an earlier one: word sets with Jaccard of at least 4/5.

    Lines are the newline-separated parts of a text; their words are lower-cased runs without blanks.
    Earlier is by ``doc_id``, then (where rows share an id) by a hash of the text, then ``line_no``. A line
    goes if any earlier line matches it, whether that one stays or goes; so of an exact group only the first
    line stays. Lines without a word never match. Null texts have no lines. Rows whose id is null come before
    all others. Rows equal in id and text share their places, so they do not repeat each other, and a line
    number is reported as often as rows have it. An empty table gives an empty table; columns other than id
    and text are not read.

    Equal lines (case aside) are one entry of the join from its first shuffle on. Entries that share a key of
    rare words (``postings``) are candidates if sizes, word parities and positions leave room for the
    similarity, and are verified on their whole word sets, by 64-bit hashes. Before that, entries of large
    groups of near copies meet a few heads of their group only (``_crowded``); those not found to be repeats
    then meet all others.
    """
    found = _repeats(docs, id_col, text_col, bits)
    return found.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "line_no")


def _with_repeats(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, bits: int) -> tuple[DataFrame, str]:
    """``rows`` plus a column, named in the result's second part, with the numbers of each row's lines that repeat others; null: none.

    ``rows`` are those of ``docs`` with what says where they stand in their last two columns, which go.
    """
    doc, key = rows.columns[-2:]
    (gone,) = fresh_names(rows, "gone")
    lists = _repeats(docs, id_col, text_col, bits).groupBy(F.col("doc").alias(doc), F.col("text_key").alias(key)).agg(F.sort_array(F.collect_set("line_no")).alias(gone))
    return rows.join(lists, [doc, key], "left").drop(doc, key), gone


def without_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = TABLE_BITS) -> DataFrame:
    """``docs`` with the lines that ``duplicate_lines`` finds taken out of the text; all rows and columns stay.

    Lines go from the row they stand in, also where rows share an id or have none. A text that loses all its
    lines is empty; a null text stays null.
    """
    doc, key = fresh_names(docs, "doc", "text_key")
    at, text_key = _place_of(id_col, text_col)
    joined, gone = _with_repeats(docs.withColumns({doc: at, key: text_key}), docs, id_col, text_col, bits)
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda line, i: ~F.array_contains(gone, i))
    text = F.when(F.col(gone).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text_col))
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns))


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = TABLE_BITS) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_removed``, ``removed`` (line numbers from 0, ascending, joined by commas), one row per input row."""
    text = F.col(text_col)
    n_lines = F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), n_lines.alias("n_lines"), *_place_of(id_col, text_col))
    joined, gone = _with_repeats(rows, docs, id_col, text_col, bits)
    return joined.select("doc_id", "n_lines", F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(gone, ","), F.lit("")).alias("removed"))
