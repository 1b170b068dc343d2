"""Audit of how sources diverge in their words: exact term shares, compared in a systolic rotation of groups."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import Workspace

SLICE_TERMS = 32_768  # about so many terms of a language are compared in one task
SLICE_PARTS = 256  # parts of a slice in which its terms are numbered
BLOCK_GROUPS = 8  # groups that stay in one task while the others pass by
PENDING = 400_000  # entries a task counts before it hands them on
UNIT = 1_000_000_000  # shares are counted in billionths

_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences), ``docs`` (documents with it); a row without a term for every group.

    Terms are runs of ASCII letters and of characters beyond ASCII, only A-Z lower-cased. Nulls are empty
    strings. Whole texts are counted; a task hands its counts on whenever it holds ``PENDING`` of them.
    """
    some = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator:
            for (lang, source), (count, holds) in seen.items():
                terms = list(count)
                for a in range(0, max(len(terms), 1), 10_000):
                    part = terms[a : a + 10_000]
                    names, n, d = [t.decode() for t in part], [count[t] for t in part], [holds[t] for t in part]
                    if a == 0:
                        names, n, d = [*names, None], [*n, 0], [*d, 0]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n)), pa.array([source] * len(n)), pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "docs"])
            seen.clear()

        held = 0
        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
            for lang, source, text in zip(langs, sources, texts):
                terms = text.as_py().translate(_LETTERS).split()
                mine = seen.get((lang, source))
                if mine is None:
                    mine = seen[lang, source] = (Counter(), Counter())
                held -= len(mine[0])
                mine[0].update(terms)
                mine[1].update(set(terms))
                held += len(mine[0])
                if held > PENDING:
                    yield from flush()
                    held = 0
        yield from flush()

    parts = some.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, terms: str) -> str:
    """SQL of a smoothed share in billionths, plus one: exact integers of 38 digits."""
    return f"1 + cast((cast({UNIT} as decimal(10,0)) * cast({n} + 5 as decimal(20,0))) div cast({total} + 5 * {terms} as decimal(28,0)) as bigint)"


def divergence_audit(docs: DataFrame, min_docs: int = 30, top_terms: int = 50, slice_terms: int = SLICE_TERMS, block_groups: int = BLOCK_GROUPS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: how each (lang, source) group's words diverge.

    A language keeps the terms that ``min_docs`` of its documents hold. A group's share of a term is
    ``1 + floor(1e9 * (n + 5) / (N + 5 V))`` (n occurrences, N of all kept terms, V kept terms), and so is the
    language's. ``pair`` rows give every other source of the language with the sum of the absolute differences
    of shares over all kept terms; ``term`` rows the ``top_terms`` terms of the group whose share exceeds the
    language's most. Ranks go by value descending, then item in byte order.

    The kept terms of a language are dealt into slices and its groups into an odd number B of blocks. A task
    holds the vectors of one block and slice; the other blocks' sparse vectors come by in the order of the
    rounds. In round r blocks i and j meet where (i + j) mod B = r, at the one of both that the other follows
    by at most (B - 1)/2 places, so any two blocks meet once and every task receives as many. A meeting gives
    both directions. Each task keeps the best terms of its groups in heaps, and the heaps of all slices are
    merged by rank. A task's memory is one block's slice and one guest.

    Nulls count as empty strings, so they form groups too. A group without terms has the shares of no
    occurrence; where a language keeps no term its pairs have value 0 and it has no term rows. Repeated rows
    count each; other columns, whatever their names, are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    with Workspace(spark) as work:
        counts = work.keep(term_counts(docs, text_col, lang_col, source_col), "term-counts")
        kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
        kept = work.keep(kept.select("lang", "term", "lang_n"), "terms-kept")
        langs = counts.select("lang").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total")), "lang", "left")
        langs = langs.select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
        langs = work.keep(langs.withColumn("slices", F.greatest(F.lit(1), F.ceil(F.col("v") / slice_terms)).cast("int")), "langs")

        # Terms are numbered within parts of a slice, each from where the parts before it end.
        part = ["lang", "slice", "part"]
        place, before = Window.partitionBy(*part).orderBy("term"), Window.partitionBy("lang", "slice").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        terms = kept.join(langs, "lang").withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int")).withColumn("part", F.pmod(F.xxhash64("term", F.lit(1)), F.lit(SLICE_PARTS)).cast("int"))
        begins = terms.groupBy(*part).agg(F.count("*").alias("n")).select(*part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
        numbered = terms.withColumn("nth", F.row_number().over(place) - 1).join(begins, part)
        terms = numbered.select("lang", "term", "slice", (F.col("begin") + F.col("nth")).alias("idx"), F.expr(_share("lang_n", "lang_total", "v")).alias("q"))
        entries = work.keep(counts.where("n > 0").join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "slice", "idx", "q"), "term-entries")
        sizes = entries.groupBy("lang", "slice").agg((F.max("idx") + 1).alias("size"))

        number = Window.partitionBy("lang").orderBy("source")
        of_lang = Window.partitionBy("lang")
        groups = counts.where("term is null").select("lang", "source").join(entries.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang")
        groups = groups.select("lang", "source", "v", "slices", F.coalesce("total", F.lit(0)).alias("total"), (F.row_number().over(number) - 1).alias("num"), F.count("*").over(of_lang).alias("groups"))
        none = F.when(F.col("v") > 0, F.expr(_share("0", "total", "nullif(v, 0)"))).otherwise(0)
        blocks = (2 * F.floor(F.ceil(F.col("groups") / block_groups) / 2) + 1).cast("int")
        groups = work.keep(groups.select("lang", "source", "v", "slices", "total", "num", none.alias("none"), blocks.alias("blocks"), F.expr(f"cast(num div {block_groups} as int)").alias("block")), "groups")

        shares = entries.join(groups.select("lang", "source", "v", "total"), ["lang", "source"]).withColumn("p", F.expr(_share("n", "total", "v")))
        listed = F.sort_array(F.collect_list(F.struct("idx", "p", (F.col("p") - F.col("q")).alias("gain"), "term"))).alias("x")
        vectors = shares.groupBy("lang", "source", "slice").agg(listed)
        every = groups.select("lang", "source", "num", "none", "blocks", "block", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        every = every.join(sizes, ["lang", "slice"], "left").join(vectors, ["lang", "source", "slice"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
        every = work.keep(every, "group-vectors")

        found = work.give(_rotate(every, top_terms), "meetings")
    total = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return total.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top_terms)).select("lang", "source", "part", "item", "value", "rank")


def _rotate(vectors: DataFrame, top_terms: int) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` of all meetings (a row per slice and direction) and of the heaps."""
    base = ["lang", "slice", "source", "num", "none", "size", F.col("x.idx").alias("idx"), F.col("x.p").alias("p")]
    stay = vectors.select(F.col("block").alias("home"), F.lit(-1).alias("round"), *base, F.col("x.gain").alias("gain"), F.col("x.term").alias("term"))
    pass_by = vectors.where("blocks > 1").withColumn("step", F.explode(F.sequence(F.lit(1), F.expr("(blocks - 1) div 2").cast("int"))))
    home = F.pmod(F.col("block") - F.col("step"), F.col("blocks"))
    nothing = (F.lit(None).cast("array<bigint>").alias("gain"), F.lit(None).cast("array<string>").alias("term"))
    guests = pass_by.select(home.alias("home"), F.pmod(home + F.col("block"), F.col("blocks")).alias("round"), *base, *nothing)
    dealt = stay.unionByName(guests).repartition("lang", "slice", "home").sortWithinPartitions("lang", "slice", "home", "round", "num")

    def run(batches: Iterator) -> Iterator:
        import heapq

        import numpy as np
        import pyarrow as pa

        names, out = ["lang", "source", "part", "item", "value"], []
        place, residents, matrix = None, [], None
        for batch in batches:
            column = {n: batch.column(n) for n in batch.schema.names}
            plain = {n: column[n].to_pylist() for n in ("home", "round", "lang", "slice", "source", "none", "size")}
            for r in range(batch.num_rows):
                here = (plain["lang"][r], plain["slice"][r], plain["home"][r])
                if here != place:
                    place, residents, matrix = here, [], np.zeros((0, plain["size"][r]), np.int64)
                dense = np.full(plain["size"][r], plain["none"][r], np.int64)
                if column["idx"][r].is_valid:
                    dense[column["idx"][r].values.to_numpy()] = column["p"][r].values.to_numpy()
                lang, source = here[0], plain["source"][r]
                for other, value in zip(residents, np.abs(matrix - dense).sum(axis=1).tolist()):
                    out += [(lang, source, "pair", other, value), (lang, other, "pair", source, value)]
                if plain["round"][r] < 0:
                    residents.append(source)
                    matrix = np.vstack([matrix, dense])
                    if column["term"][r].is_valid:
                        gain = column["gain"][r].values.to_numpy()
                        term = column["term"][r].values
                        best = heapq.nsmallest(top_terms, ((-int(gain[k]), term[int(k)].as_py().encode()) for k in _largest(gain, top_terms)))
                        out += [(lang, source, "term", t.decode(), -g) for g, t in best]
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)

    return dealt.mapInArrow(run, "lang string, source string, part string, item string, value long")


def _largest(gain, k: int):
    """Places of the positive values that are no smaller than the ``k``-th largest."""
    import numpy as np

    least = max(1, int(np.partition(gain, len(gain) - k)[len(gain) - k])) if len(gain) > k else 1
    return np.flatnonzero(gain >= least)


AUDIT_SQL = r"""
        with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
             t as (select lang, source, r, unnest(ts) as term from d),
             k as (select lang, term, count(*) as n from t group by all having count(distinct r) >= 30),
             l as (select lang, count(*) as v, sum(n) as total from k group by all),
             g as (select distinct lang, source from d),
             gn as (select lang, source, term, count(*) as n from t semi join k using (lang, term) group by all),
             gt as (select g.lang, g.source, coalesce(sum(n), 0) as total from g left join gn on g.lang = gn.lang and g.source = gn.source group by all),
             p as (select gt.lang, gt.source, k.term, coalesce(gn.n, 0) as n,
                          1 + (1000000000::hugeint * (coalesce(gn.n, 0) + 5)) // (gt.total + 5 * l.v) as p,
                          1 + (1000000000::hugeint * (k.n + 5)) // (l.total + 5 * l.v) as q
                   from gt join k on k.lang = gt.lang join l on l.lang = gt.lang
                        left join gn on gn.lang = gt.lang and gn.source = gt.source and gn.term = k.term),
             pairs as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
                       from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
             x as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(z.value, 0) as value
                   from g a join g b on a.lang = b.lang and a.source <> b.source
                        left join pairs z on z.lang = a.lang and z.source = a.source and z.item = b.source
                   union all select lang, source, 'term', term, p - q from p where n > 0 and p > q),
             o as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from x)
        select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from o where part = 'pair' or rank <= 50"""
