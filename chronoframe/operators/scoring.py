"""Scores from named parts: market blocks, fundamentals' confidence, data quality, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.functions.expr import ratio
from chronoframe.operators import rules as R


def mean_of(*parts: Column) -> Column:
    return sum(parts, F.lit(0.0)) / F.lit(float(len(parts)))


def blocks(df: DataFrame, weights: dict[str, float] = R.BLOCK_WEIGHT) -> DataFrame:
    """Adds the seven blocks, their weighted total and the status to rows of the standard features with
    regime (a name), frequency (share of positive outcomes of like days) and n (how many those are).

    An unknown part counts 0; an unknown turnover counts as its mean.
    """
    b, c = R.bounded, F.col
    scores = F.create_map(*[F.lit(x) for kv in R.REGIME_SCORE.items() for x in kv])
    turnover = F.when(F.coalesce(c("turnover_to_mean_20"), F.lit(0.0)) == 0, 1.0).otherwise(c("turnover_to_mean_20"))
    parts = {
        "trend": mean_of(b(c("price_to_sma_50"), 0.1), b(c("price_to_sma_200"), 0.2)),
        "momentum": mean_of(b(c("return_20"), 0.1), b(c("return_60"), 0.2)),
        "relative_strength": b(c("relative_strength_60"), 0.15),
        "risk": -mean_of(b(c("volatility_60"), 0.5), b(c("current_drawdown"), -0.3)),
        "liquidity": b(turnover - 1, 1.0),
        "market_regime": F.coalesce(F.try_element_at(scores, c("regime")), F.lit(0.0)),
        "historical_analogues": b(c("frequency") - 0.5, 0.25),
    }
    rows = df.withColumns({f"block_{k}": x for k, x in parts.items()})
    rows = rows.withColumn("total", sum((weights[k] * c(f"block_{k}") for k in parts), F.lit(0.0)))
    return rows.withColumn("status", R.label(R.STATUS, R.STATUS_ELSE))


def fundamental_confidence(df: DataFrame) -> DataFrame:
    """Adds completeness, freshness, evidence, consistency, source, penalty and the confidences of data,
    valuation and backtest to rows (key_metrics, total_key_metrics, age_days, has_ifrs, has_ras,
    consistency_checks, consistency_passed, has_shares, history_years, validated_releases, manual_ratio,
    ambiguities, stable_methodology)."""
    c, top, one = F.col, F.lit(100.0), F.lit(1)
    flag = lambda name: c(name).cast("int")
    rows = df.withColumns({
        "completeness": F.least(top, 100 * c("key_metrics") / F.greatest(c("total_key_metrics"), one)),
        "freshness": F.greatest(F.lit(0.0), 100 - c("age_days") / 7),
        "evidence": F.least(top, c("validated_releases") * 8 + c("history_years") * 4),
        "consistency": 100 * c("consistency_passed") / F.greatest(c("consistency_checks"), one),
        "source": 25 * flag("has_ifrs") + 20 * flag("has_ras") + 20 * flag("has_shares") + 35 * flag("stable_methodology"),
        "penalty": F.least(F.lit(60.0), c("manual_ratio") * 40 + c("ambiguities") * 10)})
    data = 0.3 * c("completeness") + 0.15 * c("freshness") + 0.2 * c("evidence") + 0.2 * c("consistency") + 0.15 * c("source") - c("penalty")
    rows = rows.withColumn("_data", F.greatest(F.lit(0.0), F.least(top, data)))
    return rows.withColumns({"data_confidence": F.round("_data", 1), "valuation_confidence": F.round(c("_data") * 0.85, 1), "backtest_confidence": F.round(F.least("_data", "evidence") * 0.8, 1)}).drop("_data")


def security_quality(df: DataFrame) -> DataFrame:
    """Adds feature_coverage, tier and reason to rows (years, observations, missing, volume_coverage,
    trade_coverage, flags)."""
    cover = (1 - F.col("missing") + F.col("volume_coverage") + F.col("trade_coverage")) / 3
    reason = F.nullif(R.label(R.SECURITY_REASON, ""), F.lit(""))
    return df.withColumns({"feature_coverage": cover, "tier": R.label(R.SECURITY_TIER, "excluded"), "reason": reason})


def quality_policy(df: DataFrame) -> DataFrame:
    """Adds the weighted score 0..100, tier and reason of the second quality policy to rows (years,
    observations, missing, volume_coverage, trade_coverage, boards, periods, episodes, resolved)."""
    c, one = F.col, F.lit(1.0)
    settled = F.when(c("episodes") == 0, 1.0).otherwise(ratio(c("resolved").cast("double"), c("episodes").cast("double")))
    single = F.when(c("boards") == 1, 1.0).otherwise(0.8)
    score = 100 * (0.20 * F.least(c("years") / 10, one) + 0.15 * (1 - c("missing")) + 0.15 * c("volume_coverage") + 0.10 * c("trade_coverage") + 0.10 * single + 0.15 * settled + 0.10 * 0.8
                   + 0.05 * F.least(c("periods") / 5.0, one))
    rows = df.withColumns({"resolution": settled, "unresolved": c("episodes") - c("resolved"), "score": score})
    return rows.withColumns({"tier": R.label(R.QUALITY_TIER, "excluded"), "reason": F.nullif(R.label(R.QUALITY_REASON, ""), F.lit(""))})


def training_adequacy(df: DataFrame, horizons: tuple[int, ...] = (5, 20, 60, 120)) -> DataFrame:
    """A row for each row (observations, years, tier, feature_coverage) and horizon: usable samples,
    independent samples, rating by history (4, 2, 1), and whether it suffices: tier A or B and ten
    horizons of observations."""
    rows = df.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    usable = F.greatest(F.col("observations") - F.col("horizon"), F.lit(0))
    rating = F.when(F.col("years") >= 10, 4).when(F.col("years") >= 5, 2).otherwise(1)
    enough = F.col("tier").isin("A", "B") & (F.col("observations") >= F.col("horizon") * 10)
    return rows.withColumns({"samples": usable, "independent": usable / F.col("horizon"), "rating": rating, "missingness": 1 - F.col("feature_coverage"), "adequate": enough})


def missing_fields(*required: str) -> Column:
    """Names of the columns that are null, empty or zero, in the order given."""
    def absent(name: str) -> Column:
        text = F.col(name).cast("string")
        return text.isNull() | (text == "") | (F.try_to_number(text, F.lit("9")) == 0)

    return F.array_compact(F.array(*[F.when(absent(n), F.lit(n)) for n in required]))


#: Fields that must be known before a gate opens.
FUTURES_UNITS = ("spot_scale", "futures_scale", "multiplier", "lot", "currency", "expiration")
REVIEW_FIELDS = ("document_id", "metric", "source_page", "source_table", "source_line", "raw_text_fragment", "unit")


def review_gate(df: DataFrame) -> DataFrame:
    """Adds missing and status to statement reviews: validated with every field, a value and a confidence
    of 0.9 or more, else requires_manual_review."""
    none = F.when(F.col("candidate_value").isNull(), F.lit("candidate_value"))
    rows = df.withColumn("missing", F.array_compact(F.concat(missing_fields(*REVIEW_FIELDS), F.array(none))))
    sure = (F.size("missing") == 0) & (F.coalesce("confidence", F.lit(0.0)) >= 0.9)
    return rows.withColumn("status", F.when(sure, "validated").otherwise("requires_manual_review"))


def identity_gate(old: str, new: str, conversion: str, evidence: str) -> Column:
    """Errors of a transition from one security to another; none where it may be chained."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    return F.array_compact(F.array(
        F.when(blank(old) | blank(new), F.lit("both SECID required")),
        F.when(F.coalesce(F.col(conversion), F.lit(0.0)) <= 0, F.lit("positive conversion ratio required")),
        F.when(~F.coalesce(F.col(evidence), F.lit(False)), F.lit("legal continuity evidence required"))))
