"""Decision ladders as column expressions, with the thresholds they turn on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strategy_name(raw: Column) -> Column:
    """crf, rule_based or position_based by what the name contains, in that order; anything else is rule_based."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    return F.when(low.contains("crf"), "crf").when(low.contains("rule"), "rule_based").when(low.contains("position"), "position_based").otherwise("rule_based")


def confidence_threshold(accuracy: Column, n: Column) -> Column:
    """Lower for strategies that proved themselves; never under 0.3."""
    ladder = F.when((accuracy >= 0.7) & (n >= 10), 0.3).when((accuracy >= 0.5) & (n >= 5), 0.4).otherwise(0.5)
    return F.greatest(ladder, F.lit(0.3))


def scoring_weights(n: Column) -> Column:
    """Weights of confidence, strategy and performance by how much history there is."""
    w = lambda c, s, p: F.struct(F.lit(c).alias("confidence"), F.lit(s).alias("strategy"), F.lit(p).alias("performance"))
    return F.when(n >= 10, w(0.15, 0.05, 0.80)).when(n >= 5, w(0.20, 0.10, 0.70)).otherwise(w(0.35, 0.25, 0.40))


def hybrid_score(confidence: Column, strategy_weight: Column, accuracy: Column, n: Column) -> Column:
    w = scoring_weights(n)
    return confidence * w["confidence"] + strategy_weight * w["strategy"] + accuracy * w["performance"]


def conflict_level(similarity: Column) -> Column:
    return F.when(similarity > 0.8, "minor").when(similarity > 0.5, "moderate").otherwise("major")


def needs_validation(scores: Column, methods: Column, threshold: float = 0.7) -> Column:
    """No scores, a low mean, any low score, or nothing but rules behind the values."""
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    only_rules = (F.size(F.array_distinct(methods)) == 1) & F.array_contains(methods, "rule_based")
    return F.coalesce((F.size(scores) == 0) | (mean < threshold) | F.exists(scores, lambda x: x < 0.5) | only_rules, F.lit(True))


def pattern_decision(idle_days: Column, usage: Column, success: Column, boost: Column) -> Column:
    rate = F.try_divide(success, usage)
    return F.when(idle_days > 30, "delete").when(usage < 10, "keep").when(boost < -0.2, "deactivate").when(rate < 0.3, "deactivate").otherwise("keep")


def decision_reason(idle_days: Column, usage: Column, success: Column, boost: Column) -> Column:
    rate = F.try_divide(success, usage)
    return F.concat_ws(", ", F.when(idle_days > 30, "unused"), F.when((usage >= 10) & (rate < 0.3), "low success"), F.when(boost < -0.2, "negative boost"))


def usage_boost(rate: Column, matched: Column, boost: Column) -> Column:
    """A hit sets the boost by the new rate; a miss lowers it below 0.3 and else leaves it."""
    hit = F.when(rate >= 0.9, 0.2).when(rate >= 0.7, 0.1).otherwise(0.0)
    return F.when(matched, hit).when(rate < 0.3, -0.1).otherwise(boost)


def template_kind(name: Column) -> Column:
    low, out = F.lower(name), F
    for kind in ("form", "table", "letter", "mixed"):
        out = out.when(low.contains(kind), kind)
    return out.otherwise("unknown")


def traffic_light(accuracy: Column) -> Column:
    return F.when(accuracy < 0.5, "Low").when(accuracy < 0.8, "Medium").otherwise("Good")


def validation_choice(force: Column, previous: Column, current: Column, incremental: Column) -> Column:
    """Whether a data-quality check runs in full, in part or not at all, by how much the data grew."""
    growth = F.try_divide(F.abs(current - previous).cast("double"), previous)
    return F.when(force, "full").when(previous.isNull() | (previous == 0), "full").when(incremental, "skip").when(growth > 0.5, "full").when(growth > 0.1, "sample").otherwise("skip")


def recommendations(n: Column, diversity: Column, leaks: Column) -> Column:
    """Three ladders of advice on a training set, absent ones left out."""
    size = F.when(n < 20, "collect more samples").when(n < 50, "more samples help").when(n < 100, "enough samples")
    variety = F.when(diversity < 0.3, "very low diversity").when(diversity < 0.5, "low diversity").when(diversity < 0.7, "moderate diversity")
    return F.array_compact(F.array(size, variety, F.when(leaks, "remove leaked samples")))


def training_trigger(unused: Column, total: Column) -> Column:
    """none, incremental, or full when the total has just passed a multiple of twenty."""
    return F.when(unused < 5, "none").when(total % 20 < unused, "full").otherwise("incremental")


def crf_weight(accuracy: Column, fields: Column) -> Column:
    trust = F.least(F.lit(1.0), fields / 10)
    w = (0.3 + 0.6 * accuracy) * trust + 0.5 * (1 - trust)
    return F.when(accuracy.isNull(), 0.5).otherwise(F.greatest(F.lit(0.3), F.least(F.lit(0.9), w)))


def position_confidence(value: Column, label: Column, before: Column) -> Column:
    full = F.least(F.lit(1.0), 0.9 + F.when(label, 0.05).otherwise(0.0) + F.when(before, 0.03).otherwise(0.0))
    return F.when(F.coalesce(value, F.lit("")) == "", full - 0.3).otherwise(full)


def multiline_by_length(n: Column, newline: Column, p90: Column, mean: Column, before: Column) -> Column:
    """1 once evidence shows values that span lines; sticky."""
    now = F.when((n >= 5) & newline, 1).when((n >= 5) & (p90 >= 90) & (mean >= 70), 1).otherwise(0)
    return F.greatest(now, before)
