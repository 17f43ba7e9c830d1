"""Ordered decision rules over named columns: the first that holds gives the label.

A rule set is data, (condition, label) in SQL text; `label` makes a column of it, `case` the text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, str]]


def case(rules: Rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{x}'" for c, x in rules) + f" ELSE '{default}' END"


def label(rules: Rules, default: str) -> Column:
    return F.expr(case(rules, default))


# Labels, thresholds and word lists that results are compared by.

#: Columns sd (of steps), low, high, terminal, ups (share of steps not falling).
PATH_SHAPE: Rules = (
    ("sd > 0.04 OR high - low > 0.20", "high_volatility"),
    ("low <= -0.05 AND terminal >= 0.02", "dip_then_recover"),
    ("high >= 0.05 AND terminal <= 0.0", "rise_then_fall"),
    ("terminal >= 0.03 AND ups >= 0.60", "steady_up"),
    ("terminal <= -0.03 AND ups <= 0.40", "steady_down"),
)
#: Columns terminal, low, high.
SCENARIO: Rules = (
    ("low <= -0.05 AND terminal > 0", "dip_then_recover"),
    ("terminal >= 0.03 AND low > -0.05", "growth_without_deep_drawdown"),
    ("terminal <= -0.03 AND high < 0.05", "continued_decline"),
    ("abs(terminal) < 0.03 AND high - low < 0.10", "sideways"),
)
#: Columns drawdown, vol, r20, r60, p50, p200, slope.
REGIME: Rules = (
    ("drawdown IS NULL OR vol IS NULL OR r20 IS NULL OR r60 IS NULL OR p50 IS NULL OR p200 IS NULL OR slope IS NULL", "недостаточно данных"),
    ("drawdown <= -0.20 OR vol >= 0.35", "стрессовый режим"),
    ("drawdown <= -0.10 AND r20 >= 0.08", "восстановление после стресса"),
    ("p50 > 0 AND p200 > 0 AND slope > 0 AND r60 >= 0.10", "устойчивый восходящий тренд"),
    ("p200 > 0 AND r60 >= 0.03", "умеренный восходящий тренд"),
    ("p50 < 0 AND p200 < 0 AND slope < 0 AND r60 <= -0.10", "устойчивый нисходящий тренд"),
    ("p200 < 0 AND r60 <= -0.03", "умеренный нисходящий тренд"),
)
REGIME_ELSE = "боковой рынок"
#: What each regime was read from.
REGIME_REASONS = {
    "недостаточно данных": "недостаточная история для правил",
    "стрессовый режим": "глубокая просадка или высокая волатильность",
    "восстановление после стресса": "сильный рост после заметной просадки",
    "устойчивый восходящий тренд": "выше SMA50/200;SMA200 растёт",
    "умеренный восходящий тренд": "выше SMA200;положительная доходность",
    "устойчивый нисходящий тренд": "ниже SMA50/200;SMA200 снижается",
    "умеренный нисходящий тренд": "ниже SMA200;отрицательная доходность",
    "боковой рынок": "нет достаточного подтверждения направленного режима",
}
#: Score of each regime; others count 0.
REGIME_SCORE = {
    "устойчивый восходящий тренд": 1.0,
    "умеренный восходящий тренд": 0.5,
    "боковой рынок": 0.0,
    "умеренный нисходящий тренд": -0.5,
    "устойчивый нисходящий тренд": -1.0,
    "стрессовый режим": -1.0,
    "восстановление после стресса": 0.25,
}
BLOCK_WEIGHT = {"trend": 0.20, "momentum": 0.15, "relative_strength": 0.15, "risk": 0.15, "liquidity": 0.10, "market_regime": 0.10, "historical_analogues": 0.15}
#: Columns n, total.
STATUS: Rules = (
    ("n < 10", "недостаточно данных"),
    ("total >= 0.45", "статистически благоприятные условия"),
    ("total >= 0.15", "умеренно благоприятные условия"),
    ("total <= -0.45", "статистически неблагоприятные условия"),
    ("total <= -0.15", "умеренно неблагоприятные условия"),
)
STATUS_ELSE = "нейтральные условия"
#: Columns ret60, drawdown.
MARKET_TREND: Rules = (
    ("ret60 IS NULL", "insufficient"),
    ("drawdown <= -0.25 OR ret60 <= -0.15", "crisis"),
    ("ret60 <= -0.10", "strong_bear"),
    ("ret60 <= -0.03", "weak_bear"),
    ("ret60 < 0.03", "sideways"),
    ("ret60 < 0.15", "weak_bull"),
)
#: Columns n (volatilities known so far), vol, q25, q75, q90 (of them).
VOLATILITY_REGIME: Rules = (
    ("vol IS NULL OR n < 60", "insufficient"),
    ("vol >= q90", "extreme"),
    ("vol >= q75", "elevated"),
    ("vol <= q25", "low"),
)
#: Columns n (levels known so far), level, change (over 20 rows), meaningful (a tenth of the deviation so far), q75 (of the levels so far).
RATES_REGIME: Rules = (
    ("level IS NULL OR n < 60 OR meaningful IS NULL", "insufficient"),
    ("change < -meaningful", "easing"),
    ("change > meaningful", "tightening"),
    ("level > q75", "stable_high"),
)
#: Columns r20, r60, drawdown, p20 (distance to the 20-row mean).
STOCK_STATE: Rules = (
    ("r20 IS NULL OR r60 IS NULL OR drawdown IS NULL", "insufficient"),
    ("drawdown <= -0.35 AND r20 <= -0.12", "capitulation"),
    ("r60 <= -0.10", "downtrend"),
    ("r20 <= -0.05", "correction"),
    ("r20 >= 0.08 AND drawdown <= -0.08", "recovery"),
    ("r20 >= 0.10 AND p20 > 0", "breakout"),
    ("r20 >= 0.03", "uptrend"),
    ("r20 > 0 AND p20 <= 0", "accumulation"),
)
#: Columns breadth_z, trend, dispersion (negative spread of returns).
MARKET_STATE: Rules = (
    ("coalesce(breadth_z, 0) > 0.5 AND trend > 0.2", "broad_risk_on"),
    ("coalesce(breadth_z, 0) < -0.5 AND trend < -0.2", "broad_risk_off"),
    ("dispersion < -0.03", "high_dispersion"),
)
#: Column p, a percentile of distance.
NOVELTY: Rules = (("p < 0.8", "familiar"), ("p < 0.95", "somewhat_unusual"), ("p < 0.995", "rare"))
#: Columns h (historical) and r (recent) rank correlation.
DRIFT: Rules = (
    ("h IS NULL OR r IS NULL", "insufficient_sample"),
    ("h * r < 0 OR abs(r - h) >= 0.15", "significant_drift"),
    ("abs(r - h) >= 0.075", "watch"),
)
#: Column clock, 'HH:mm' in exchange time.
SESSION_3: Rules = (("clock < '10:00'", "morning"), ("clock < '18:50'", "main"))
SESSION_4: Rules = (("clock < '09:50'", "pre_market"), ("clock <= '18:50'", "main"), ("clock <= '23:50'", "evening"))
SESSION_5: Rules = (("clock < '10:00'", "morning"), ("clock < '10:10'", "opening_auction"), ("clock < '18:40'", "main"), ("clock < '19:00'", "closing_auction"))
#: Patterns over lower-cased text, the first that matches.
EVENT_CLASS = (
    ("central_bank", r"central bank|bank of russia|federal reserve|ecb|ключев.*ставк"),
    ("rates", r"interest rate|key rate|ставк"),
    ("inflation", r"inflation|инфляц"),
    ("FX", r"rouble|ruble|currency|exchange rate|рубл|валют"),
    ("oil", r"\boil\b|\bbrent\b|нефт"),
    ("sanctions", r"sanction|санкц"),
    ("geopolitics", r"geopolit|military|conflict|геополит|военн"),
    ("earnings", r"earnings|results|revenue|profit|отч[её]т|прибыл"),
    ("dividends", r"dividend|дивиденд"),
    ("regulation", r"regulat|закон|регулирован"),
    ("M&A", r"merger|acquisition|takeover|слияни|поглощен"),
    ("buyback", r"buyback|обратн.*выкуп"),
    ("SPO/FPO", r"\bspo\b|\bfpo\b"),
)
POSITIVE = r"improv|growth|record high|повыш|рост|улучш"
NEGATIVE = r"declin|risk|loss|sanction|сниж|риск|убыт|санкц"


def integrity(available: Column, ordered: Column, revisions: Column, duplicates: Column, impossible: Column, stale: Column, frequency: Column) -> Column:
    """100 less fixed penalties, at least 0, to one decimal."""
    lost = [F.when(available, 0).otherwise(25), F.when(ordered, 0).otherwise(30), F.when(revisions, 0).otherwise(10), F.least(F.lit(15), duplicates * 3),
            F.least(F.lit(15), impossible * 5), F.least(F.lit(10.0), F.greatest(F.lit(0.0), stale) * 20), F.when(frequency, 0).otherwise(10)]
    return F.greatest(F.lit(0.0), F.round(F.lit(100.0) - sum(lost, F.lit(0.0)), 1))


def source_priority(relevance: Column, depth: Column, integrity_: Column, value: Column, breadth: Column, cost: Column, complexity: Column, license_risk: Column) -> tuple[Column, Column]:
    """Score and status of a data source from judgements 0..3; costly ones of the upper two are optional."""
    score = relevance * 3 + depth * 2 + integrity_ * 3 + value * 3 + breadth * 2 - cost * 2 - complexity - license_risk * 3
    upper = F.when(cost >= 2, "paid_optional")
    status = F.when(score >= 27, F.coalesce(upper, F.lit("critical"))).when(score >= 20, F.coalesce(upper, F.lit("high"))).when(score >= 12, "medium").otherwise("low")
    return score, status


def confounding(same_day: Column, market_move: Column, dividend_day: Column) -> Column:
    """Clean, partially or heavily confounded by what else happened that day."""
    n = (same_day > 1).cast("int") + (F.abs(market_move) > 0.03).cast("int") + dividend_day.cast("int")
    return F.when(n >= 2, "heavily_confounded").when(n == 1, "partially_confounded").otherwise("clean_event")


def bounded(c: Column, scale: float) -> Column:
    """c / scale within -1..1; 0 for null."""
    x = c / F.lit(scale)
    return F.coalesce(F.when(c.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))), F.lit(0.0))


#: Columns years, observations, missing, volume_coverage, trade_coverage, flags.
SECURITY_TIER: Rules = (
    ("years >= 10 AND observations >= 1500 AND missing <= 0.02 AND volume_coverage >= 0.95 AND trade_coverage >= 0.8 AND flags = 0", "A"),
    ("years >= 5 AND observations >= 750 AND missing <= 0.05 AND volume_coverage >= 0.8", "B"),
    ("observations >= 250 AND missing <= 0.15", "C"),
)
#: Why a security has no tier, or is to be reviewed; columns as above.
SECURITY_REASON: Rules = (
    ("observations < 250", "short_history"),
    ("missing > 0.15", "excessive_missingness"),
    ("flags > 0", "corporate_action_review"),
)
#: Columns years, observations, missing, volume_coverage, trade_coverage, unresolved.
QUALITY_TIER: Rules = (
    ("years >= 8 AND observations >= 1200 AND missing <= 0.03 AND volume_coverage >= 0.9 AND trade_coverage >= 0.7 AND unresolved <= greatest(1, observations * 0.001)", "A"),
    ("years >= 4 AND observations >= 600 AND missing <= 0.08 AND volume_coverage >= 0.7 AND unresolved <= greatest(3, observations * 0.005)", "B"),
    ("observations >= 250 AND missing <= 0.15", "C"),
)
QUALITY_REASON: Rules = (
    ("observations < 250", "short_history"),
    ("missing > 0.15", "excessive_missingness"),
    ("unresolved > greatest(3, observations * 0.005)", "corporate_action_uncertainty"),
)
#: Columns high (gain at the median or over it), calm (risk at the median or under it).
QUADRANT: Rules = (
    ("high AND calm", "high_opportunity_low_downside"),
    ("high", "high_opportunity_high_downside"),
    ("calm", "low_opportunity_low_downside"),
)
QUADRANT_ELSE = "low_opportunity_high_downside"
#: Column n, a number of outcomes.
SAMPLE_QUALITY: Rules = (("n < 10", "недостаточно данных"), ("n < 20", "очень слабая статистика"), ("n < 50", "ограниченная статистика"))
SAMPLE_QUALITY_ELSE = "приемлемая историческая база, но не гарантия"
#: Column psi, null where either sample has fewer values than bins.
PSI_STATUS: Rules = (("psi IS NULL", "insufficient_sample"), ("psi >= 0.25", "significant_drift"), ("psi >= 0.1", "watch"))
#: Patterns of named things over lower-cased text.
ENTITY_PATTERNS = {
    "Russia": r"\brussia|росси",
    "CBR": r"bank of russia|банк росс|key rate|ключев.*ставк",
    "MOEX": r"moscow exchange|московск.*бирж|\bmoex\b",
    "USA": r"united states|\bu\.s\.\b|сша",
    "Fed": r"federal reserve|\bfed\b|фрс",
    "oil": r"\boil\b|нефт",
    "Brent": r"\bbrent\b",
    "RUB": r"rouble|ruble|рубл",
    "sanctions": r"sanction|санкц",
    "SBERP": r"sber|сбер",
    "LKOH": r"lukoil|лукойл",
    "MTSS": r"\bmts\b|мтс",
    "TRNFP": r"transneft|транснефт",
    "PHOR": r"phosagro|фосагро",
    "TATNP": r"tatneft|татнефт",
    "LSNGP": r"lenenergo|ленэнерго",
    "X5": r"\bx5\b|пят[её]рочк",
}
#: Columns n, ic, recent, signs (distinct fold signs over 0.01), stability (share of folds with ic's sign).
IC_CLASS: Rules = (
    ("n < 80 OR ic IS NULL", "insufficient_sample"),
    ("signs > 1 AND stability < 0.65", "sign_flip"),
    ("recent IS NOT NULL AND abs(recent) < abs(ic) * 0.4 AND abs(ic) >= 0.03", "decaying"),
    ("abs(ic) < 0.015", "noise"),
    ("stability >= 0.7 AND ic > 0", "stable_positive"),
    ("stability >= 0.7", "stable_negative"),
)
