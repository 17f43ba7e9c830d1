"""Data-quality rules.  Rules report; nothing is repaired."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.functions.expr import ratio
from chronoframe.operators import windows as W

ISSUE = ["issue_type", "entity", "d", "detail"]


def _issue(df: DataFrame, kind: str, detail: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("issue_type"), "entity", "d", detail.cast("string").alias("detail"))


def row_rules(prices: DataFrame) -> DataFrame:
    """Rules on one row: all in one pass, a row an issue.  prices(entity, d, open, high, low, close,
    value, volume)."""
    c = F.col
    bad = {
        "negative_price": F.least("open", "high", "low", "close") < 0,
        "negative_volume": c("volume") < 0,
        "high_below_low": c("high") < c("low"),
        "open_outside_range": (c("open") > c("high")) | (c("open") < c("low")),
        "close_outside_range": (c("close") > c("high")) | (c("close") < c("low")),
        "missing_required": c("close").isNull() | c("volume").isNull() | c("value").isNull(),
        "not_finite": F.isnan("close") | (F.abs("close") == float("inf")),
    }
    found = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in bad.items()]), lambda x: x.isNotNull())
    return prices.select("entity", "d", F.explode(found).alias("issue_type")).select("issue_type", "entity", "d", F.lit("").alias("detail"))


def duplicates(prices: DataFrame, keys: Sequence[str] = ("entity", "d")) -> DataFrame:
    n = prices.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return _issue(n, "duplicate_key", F.col("n"))


def scale_jumps(prices: DataFrame, price_factor: float = 10.0, volume_factor: float = 100.0) -> DataFrame:
    """Price ten times the row before or a tenth of it; volume a hundred times it."""
    w = W.by_time("entity", "d")
    rows = prices.withColumn("p", F.lag("close").over(w)).withColumn("v", F.lag("volume").over(w))
    price = rows.where((ratio("close", "p") >= price_factor) | (ratio("close", "p") <= 1 / price_factor))
    volume = rows.where(ratio("volume", "v") >= volume_factor)
    return _issue(price, "price_scale", F.round(ratio("close", "p"), 4)).unionByName(_issue(volume, "volume_scale", F.round(ratio("volume", "v"), 4)))


def calendar_gaps(prices: DataFrame, calendar: DataFrame, most: int) -> DataFrame:
    """Sessions missing in a row, over `most`, between two rows of an entity."""
    s = W.sessions(calendar, "d")
    rows = prices.select("entity", "d").join(s, "d")
    rows = rows.withColumn("gap", F.col("session") - F.lag("session").over(W.by_time("entity", "d")) - 1)
    return _issue(rows.where(F.col("gap") > most), "missing_sessions", F.col("gap"))


def segment_issues(segments: DataFrame) -> DataFrame:
    """Overlaps and gaps of validity intervals by entity (valid_from, valid_to)."""
    w = Window.partitionBy("entity").orderBy("valid_from", "board")
    rows = segments.withColumn("before", F.max("valid_to").over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("d", F.col("valid_from"))
    over = _issue(rows.where(F.col("valid_from") <= F.col("before")), "segment_overlap", F.col("board"))
    return over.unionByName(_issue(rows.where(F.datediff("valid_from", "before") > 1), "segment_gap", F.col("board")))


def board_jumps(canonical: DataFrame, share: float = 0.25) -> DataFrame:
    """A move over `share` where the chain changes board."""
    w = W.by_time("entity", "d")
    rows = canonical.withColumn("b", F.lag("board").over(w)).withColumn("m", ratio("close", F.lag("close").over(w)) - 1)
    return _issue(rows.where((F.col("b") != F.col("board")) & (F.abs("m") > share)), "board_boundary_jump", F.concat_ws(">", "b", "board"))


def orphans(facts: DataFrame, prices: DataFrame, kind: str) -> DataFrame:
    """Facts on no row of the panel."""
    return _issue(facts.join(prices.select("entity", "d"), ["entity", "d"], "left_anti"), kind, F.lit(""))


def suite(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [p.select(*ISSUE) for p in parts])


def require_no_future(df: DataFrame, source: str, decision: str) -> DataFrame:
    """df, failing at run time on the first row whose source date is after its decision date."""
    message = F.concat(F.lit("future data: "), F.col(source).cast("string"), F.lit(" > "), F.col(decision).cast("string"))
    guard = F.when(F.col(source) > F.col(decision), F.raise_error(message).cast("date")).otherwise(F.col(source))
    return df.withColumn(source, guard)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, failing at run time where a key repeats."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("_n", F.when(n > 1, F.raise_error(F.lit("duplicate key")).cast("long")).otherwise(n)).where("_n = 1").drop("_n")


def dividend_rules(dividends: DataFrame, prices: DataFrame) -> DataFrame:
    """Dividends that are not positive, lie on no trading day, or outside the entity's history."""
    span = prices.groupBy("entity").agg(F.min("d").alias("_a"), F.max("d").alias("_b"))
    rows = dividends.join(span, "entity", "left")
    parts = [_issue(dividends.where("dividend <= 0"), "nonpositive_dividend", F.col("dividend")), orphans(dividends, prices, "orphan_dividend"),
             _issue(rows.where(F.col("_a").isNull() | ~F.col("d").between(F.col("_a"), F.col("_b"))), "dividend_out_of_history", F.lit(""))]
    return suite(parts)


def index_rules(returns: DataFrame) -> DataFrame:
    """Total-return indices that are null, not positive or not finite."""
    x = F.col("total_return_index")
    return _issue(returns.where(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x <= 0)), "invalid_index", F.lit(""))


def history_audit(prices: DataFrame, rules: dict[str, Column], jump: float = 0.5) -> DataFrame:
    """(issue_id, issue, entity, board, d, r): rows of prices(entity, board, d, close) for which a named
    condition holds, and returns on the board's row before beyond `jump` either way, for review."""
    w = Window.partitionBy("entity", "board").orderBy("d")
    rows = prices.withColumn("r", ratio("close", F.lag("close").over(w)) - 1)
    rules = {"large_return_corporate_action_review": F.abs("r") > jump, **rules}
    named = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    out = rows.select("entity", "board", "d", F.explode(named).alias("issue"), "r").withColumn("r", F.when(F.col("issue") == "large_return_corporate_action_review", F.col("r")))
    issue_id = F.substring(F.sha2(F.concat_ws(":", "issue", F.col("entity").cast("string"), "board", F.col("d").cast("string")), 256), 1, 24)
    return out.select(issue_id.alias("issue_id"), "issue", "entity", "board", "d", "r")


def event_issues(events: DataFrame) -> DataFrame:
    """(event_id, issue, severity) of events(event_id, available_from, announcement_time, effective_time,
    event_start, scheduled, surprise, content_hash, status, source_url): what must be known and in order.
    Of events with one content hash, all but the first by id are copies."""
    c = F.col
    first = F.min("event_id").over(Window.partitionBy("content_hash"))
    x = events.withColumn("_first", F.when(c("content_hash").isNotNull(), first))
    rule = lambda when, name, severity: F.when(when, F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity")))
    found = F.array_compact(F.array(
        rule(c("available_from").isNull(), "missing_available_from", "critical"), rule(c("announcement_time") > c("available_from"), "publication_leakage", "critical"), rule(c("scheduled") & c("surprise"), "schedule_conflict", "critical"),
        rule((c("status") == "validated") & c("event_start").isNull(), "missing_event_time", "critical"), rule(c("effective_time") < c("announcement_time"), "effective_before_announcement", "warning"),
        rule(c("_first") < c("event_id"), "duplicate_source_copy", "warning"), rule(F.coalesce(c("source_url"), F.lit("")) == "", "missing_source", "critical"), rule(c("status") == "manual_review", "manual_review", "warning")))
    return x.select("event_id", F.inline(found))


def fundamental_issues(facts: DataFrame, standards: Sequence[str] = ("IFRS", "RAS"), positive: Sequence[str] = ("assets", "equity", "ordinary_shares", "client_funds")) -> DataFrame:
    """(metric, period_end, standard, revision, issue) of facts(metric, period_end, standard, revision,
    published, available, value): repeated keys (all but one), a publication before the period's end,
    availability before publication, an unknown standard, a negative value of what can't be."""
    c, key = F.col, ["metric", "period_end", "standard", "revision"]
    again = F.row_number().over(Window.partitionBy(*key).orderBy("published", "available", "value")) > 1
    x = facts.withColumn("_again", again)
    rules = {"duplicate": c("_again"), "publication_before_period_end": c("published") < c("period_end"), "available_before_publication": F.to_date("available") < c("published"),
             "unknown_standard": ~F.coalesce(c("standard").isin(*standards), F.lit(False)), "impossible_negative": c("metric").isin(*positive) & (c("value") < 0)}
    return x.select(*key, F.explode(F.array_compact(F.array(*[F.when(w, F.lit(n)) for n, w in rules.items()]))).alias("issue"))
