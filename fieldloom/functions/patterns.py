"""Learned regular expressions as data: checked once per distinct pattern, and found by the literals that they require."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAM = 3  # characters of the literals in the index
CHECKED = T.StructType([T.StructField("error", T.StringType()), T.StructField("groups", T.IntegerType()), T.StructField("regex", T.StringType()), T.StructField("covers", T.ArrayType(T.ArrayType(T.StringType())))])
_OPEN = ""  # the key of patterns that require no literal: every text of their scope meets them


def inspect(pattern: str | None) -> dict:
    """What one pattern is: its error, or its number of groups, its form for the JVM and its ``covers``.

    A cover is a set of three-character strings of which every matching text has at least one. Patterns of
    which nothing is certain (case ignored, short literals, optional parts) have no cover.
    """
    out = {"error": None, "groups": None, "regex": None, "covers": []}
    if not pattern:
        return out | {"error": "empty"}
    try:
        compiled = re.compile(pattern)
    except (re.error, OverflowError, RecursionError) as e:
        return out | {"error": str(e) or type(e).__name__}
    named = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    named = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\\\k<{m[1].replace('_', '')}>".replace("\\\\", "\\"), named)
    literal = [] if compiled.flags & (re.IGNORECASE | re.VERBOSE) else _covers(_items(re._parser.parse(pattern)))
    return out | {"groups": compiled.groups, "regex": re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", named), "covers": [sorted(c) for c in {frozenset(c) for c in literal}]}


def _items(tree) -> list:
    """A parsed sequence with its plain groups opened, so that literals run on through them."""
    out = []
    for op, arg in tree:
        if str(op) == "SUBPATTERN" and not arg[1] and not arg[2]:
            out += _items(arg[3])
        else:
            out.append((str(op), arg))
    return out


def _covers(items: list) -> list[set[str]]:
    found, run = [], ""
    for op, arg in [*items, ("END", None)]:
        if op == "LITERAL":
            run += chr(arg)
            continue
        found += [{run[k : k + GRAM]} for k in range(len(run) - GRAM + 1)]
        run = ""
        if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            found += _covers(_items(arg[2]))
        elif op == "ATOMIC_GROUP":
            found += _covers(_items(arg))
        elif op == "BRANCH":
            each = [_covers(_items(branch)) for branch in arg[1]]
            if all(each):
                found.append(set().union(*(min(c, key=len) for c in each)))
    return found


@F.pandas_udf(CHECKED)
def _look(p: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([inspect(x) for x in p], columns=["error", "groups", "regex", "covers"])


def checked(patterns: DataFrame, pattern_col: str = "pattern") -> DataFrame:
    """``pattern``, ``regex``, ``groups``, ``covers``, ``error`` of every distinct pattern; only those without an error may be run.

    A pattern must compile where it was learned (Python) and where it runs (the JVM); what fails either is set
    aside with the reason. Null patterns have no row.
    """
    seen = patterns.select(F.col(pattern_col).alias("pattern")).where("pattern is not null").distinct().withColumn("x", _look("pattern")).select("pattern", "x.*")
    compiles = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("regex"))
    told = seen.withColumn("jvm", compiles)
    error = F.coalesce("error", F.when(F.col("jvm").isNull(), "does not compile on the JVM"))
    return told.select("pattern", "regex", "groups", "covers", error.alias("error"))


def grams(text: Column) -> Column:
    """The distinct three-character strings of a text."""
    last = F.char_length(text) - GRAM + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda k: F.substr(text, k, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def pattern_index(patterns: DataFrame, scope: str, looked: DataFrame | None = None) -> DataFrame:
    """``scope``, ``gram``, ``pattern``, ``regex``, ``groups``: the posting lists of the valid patterns.

    Every pattern is posted under the strings of one of its covers, the one whose strings the fewest patterns
    of its scope require; without a cover it is posted once for all texts of the scope.
    """
    own = patterns.select(scope, "pattern").distinct().join((checked(patterns) if looked is None else looked).where("error is null"), "pattern")
    told = own.select(scope, "pattern", F.posexplode("covers").alias("nth", "cover")).select(scope, "pattern", "nth", F.explode("cover").alias("gram"))
    demand = told.groupBy(scope, "gram").agg(F.count_distinct("pattern").alias("demand"))
    costs = told.join(demand, [scope, "gram"]).groupBy(scope, "pattern", "nth").agg(F.sum("demand").alias("cost"), F.sort_array(F.collect_set("gram")).alias("cover"))
    best = costs.groupBy(scope, "pattern").agg(F.min(F.struct("cost", "cover"))["cover"].alias("cover"))
    posted = own.join(best, [scope, "pattern"], "left").withColumn("cover", F.coalesce("cover", F.array(F.lit(_OPEN))))
    return posted.select(scope, F.explode("cover").alias("gram"), "pattern", "regex", "groups", (F.size("cover") > 1).alias("several"))


def pattern_matches(texts: DataFrame, index: DataFrame, scope: str, text: str = "text") -> DataFrame:
    """``scope``, ``text``, ``pattern``, ``regex``, ``groups`` where a pattern of the text's scope is found in it.

    ``texts`` has distinct (scope, text). A text meets only the patterns that its three-character strings are
    posted for, and of these it is tried on the whole pattern; so the work follows the matches and not texts
    times patterns. Null texts match nothing.
    """
    asked = texts.where(F.col(text).isNotNull()).select(scope, text, F.explode(F.array_append(grams(F.col(text)), F.lit(_OPEN))).alias("gram"))
    met = asked.join(index, [scope, "gram"]).where(F.rlike(F.col(text), F.col("regex"))).select(scope, text, "pattern", "regex", "groups")
    return met.distinct()


def found_value(text: Column, regex: Column, groups: Column) -> Column:
    """What a checked pattern that matches finds: its first group if it has one, else the whole match; trimmed."""
    return F.trim(F.when(groups > 0, F.call_function("regexp_extract", text, regex, F.lit(1))).otherwise(F.call_function("regexp_extract", text, regex, F.lit(0))))
