"""Scorecard and findings from a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabulant.operators.profile import KEY_ROW

# Finding texts.
DUPLICATES = "Detected %d duplicate key combinations in FileKey columns."
MISSINGNESS = "Average null ratio exceeds 10%; review missingness patterns."
PARSING = "Type parsing success below 95%; metadata type mismatch likely."
SKEW = "Distribution hint: %s appears %s (mean/median gap ratio %s)."
OUTLIER = "Outlier hint: %s shows wide spread (max/min-style ratio indicator %s)."
DESCRIPTIONS = "%d fields are missing FieldDesc metadata."
ALL_CLEAR = "No major data quality risks detected from quick profile."


def _rates(profiled: DataFrame, *more: Column) -> DataFrame:
    """Averages over fields, the key's counts and more aggregates, in one row even for an empty profile."""
    is_key = F.col("field_name") == KEY_ROW
    parse_rate = F.when(~is_key, F.coalesce("parse_success_rate", F.lit(1.0)))
    null_rate = F.when(~is_key, F.try_divide(F.col("null_count"), F.col("row_count")))
    return profiled.agg(
        F.coalesce(F.avg(parse_rate), F.lit(1.0)).alias("parse_rate"),
        F.coalesce(F.avg(null_rate), F.lit(0.0)).alias("null_rate"),
        F.coalesce(F.max(F.when(is_key, F.col("duplicate_key_count"))), F.lit(0)).alias("duplicate_key_count"),
        F.coalesce(F.max(F.when(is_key, F.col("row_count"))), F.lit(0)).alias("key_rows"),
        *more,
    )


def scorecard(profiled: DataFrame, warnings: DataFrame) -> DataFrame:
    """Six headline numbers in one row; percentages to two places."""
    duplicate_share = F.coalesce(F.try_divide("duplicate_key_count", "key_rows"), F.lit(0.0))
    warned = warnings.agg(F.count(F.lit(1)))

    def percent(share: Column, name: str) -> Column:
        return F.round(share * 100.0, 2).alias(name)

    return _rates(profiled).select(
        percent(F.col("parse_rate"), "avg_parse_success_pct"),
        percent(1.0 - F.col("parse_rate"), "invalid_parse_pct"),
        percent(F.col("null_rate"), "avg_null_pct"),
        percent(duplicate_share, "duplicate_pk_pct"),
        "duplicate_key_count",
        warned.scalar().alias("schema_warning_count"),
    )


def _widest(measure: Column, *told: str) -> Column:
    """The numeric field with the largest measure, the earliest field winning ties, and columns of it.

    A measure that is no number, as the mean of opposite infinities, exceeds none.
    """
    measure = F.nanvl(measure, F.lit(None).cast("double"))
    scored = F.struct(measure.alias("score"), (-F.col("ordinal")).alias("earlier"), "field_name", *told)
    return F.max(F.when((F.col("stat_type") == "Num") & measure.isNotNull(), scored))


def _told(score: Column, form: str) -> Column:
    """A score as findings show it."""
    return F.when(score == float("inf"), F.lit("inf")).otherwise(F.format_string(form, score))


def _finding(rule: str, holds: Column, message: Column) -> Column:
    return F.when(holds, F.struct(F.lit(rule).alias("rule"), message.alias("finding")))


def findings(
    profiled: DataFrame,
    catalogs: DataFrame,
    warnings: DataFrame,
    most: int | None = None,
    most_warnings: int | None = None,
) -> DataFrame:
    """Ranked findings ``(rank, rule, finding)``, or the all-clear; all of them, or the first ones.

    ``catalogs`` holds the declared fields and ``warnings`` the ranked schema warnings. All inputs
    have one row per field. The profile is read once, into one row from which every rule is judged.
    """
    gap = F.abs(F.col("mean") - F.col("median")) / F.abs(F.when(F.col("median") != 0, F.col("median")))
    spread = F.when(F.col("min") > 0, F.col("max") / F.when(F.col("min") > 0, F.col("min"))).when(
        (F.col("min") < 0) & (F.col("max") > 0), F.col("max") - F.col("min")
    )
    undescribed = catalogs.agg(F.count_if(F.trim(F.coalesce("field_desc", F.lit(""))) == "")).scalar()
    warned = warnings.agg(F.array_sort(F.collect_list(F.struct("rank", "warning")))).scalar()
    judged = _rates(profiled, _widest(gap, "mean", "median").alias("skew"), _widest(spread).alias("outlier"))
    judged = judged.select("*", undescribed.alias("undescribed"), warned.alias("warned"))
    side = F.when(F.col("skew.mean") > F.col("skew.median"), "right-skewed").otherwise("left-skewed")
    skew, outlier = ((F.col(f"{c}.field_name"), F.col(f"{c}.score")) for c in ("skew", "outlier"))
    rules = F.array(
        _finding("duplicate_keys", F.col("duplicate_key_count") > 0, F.format_string(DUPLICATES, "duplicate_key_count")),
        _finding("missingness", F.col("null_rate") > 0.1, F.lit(MISSINGNESS)),
        _finding("parse_success", F.col("parse_rate") < 0.95, F.lit(PARSING)),
        _finding("skew", skew[1] >= 0.5, F.format_string(SKEW, skew[0], side, _told(skew[1], "%.2f"))),
        _finding("outlier", outlier[1] >= 20.0, F.format_string(OUTLIER, outlier[0], _told(outlier[1], "%,.2f"))),
        _finding("missing_descriptions", F.col("undescribed") > 0, F.format_string(DESCRIPTIONS, "undescribed")),
    )
    shown = F.col("warned") if most_warnings is None else F.slice("warned", 1, most_warnings)
    told = F.transform(shown, lambda w: F.struct(F.lit("schema_warning").alias("rule"), w["warning"].alias("finding")))
    found = F.concat(F.filter(rules, lambda r: r.isNotNull()), told)
    clear = F.array(F.struct(F.lit("all_clear").alias("rule"), F.lit(ALL_CLEAR).alias("finding")))
    found = F.when(F.size(found) > 0, found).otherwise(clear)
    ranked = judged.select(F.posexplode(found if most is None else F.slice(found, 1, most)).alias("rank", "f"))
    return ranked.select((F.col("rank") + 1).alias("rank"), "f.rule", "f.finding")
