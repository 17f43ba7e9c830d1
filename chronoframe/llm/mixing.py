"""Mixing sources to target weights by budgets that descend a domain-language-source tree."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm import common

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mixture:
    """Integer weights of a node among its siblings, by name; names that are not listed weigh `other`."""

    domain: dict[str, int] = field(default_factory=lambda: {"reference": 2, "web": 3})
    lang: dict[str, int] = field(default_factory=lambda: {"en": 3})
    source: dict[str, int] = field(default_factory=dict)
    other: int = 1
    budget_percent: int = 100  # of all tokens
    max_epochs: int = 4
    seed: int = 17


def default_domain() -> Column:
    """The documents have no domain: sources are dealt to two by the first hex digit of their MD5."""
    return F.when(F.substring(F.md5(F.col("source").cast("binary")), 1, 1) < "8", "reference").otherwise("web")


def _weight(level: str, mixture: Mixture) -> Column:
    names = getattr(mixture, level)
    if any(w <= 0 for w in [*names.values(), mixture.other]):
        raise ValueError("weights must be positive")
    known = [F.when(F.col(level) == name, F.lit(w)) for name, w in sorted(names.items())]
    return F.coalesce(*known, F.lit(mixture.other)).cast("long")


def _pour(nodes: DataFrame, parents: tuple[str, ...], level: str, mixture: Mixture) -> DataFrame:
    """Share each parent's budget among its children: weight's share each, no more than the capacity
    below the child; what a child can't take goes to its siblings in proportion to their weights.

    A child's level is the largest (budget - capacities before) / (weights from here on) over the
    siblings in order of capacity by weight.  Whole numbers enter, so the result is the same anywhere.
    """
    by = Window.partitionBy(*parents)
    order = by.orderBy(F.col("capacity") / F.col("weight"), level)
    rows = nodes.withColumn("weight", _weight(level, mixture))
    rows = rows.withColumn("before", F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    passed = F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("onward", F.sum("weight").over(by) - passed)
    rows = rows.withColumn("height", F.max((F.col("budget") - F.col("before")).cast("double") / F.col("onward")).over(by))
    poured = F.least(F.col("capacity"), F.floor(F.col("height") * F.col("weight")).cast("long"))
    return rows.withColumn("budget", poured).drop("weight", "before", "onward", "height")


def units(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens): what is chosen or left as one.  Tokens are words.

    Rows of one doc_id, language and source are one unit.  A null or missing lang or source is ''.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.regexp_count(common.text_of("text"), F.lit(common.WORD)).cast("long").alias("n"))
    base = base.withColumn("domain", default_domain() if domain is None else domain)
    return base.groupBy("doc_id", *LEVELS).agg(F.sum("n").alias("n_tokens"))


def budgets(unit_rows: DataFrame, mixture: Mixture) -> DataFrame:
    """(domain, lang, source, leaf_tokens, leaf_budget): a row a leaf, budgets poured from the root.

    A node's capacity is max_epochs times the tokens below it.  A shortage is shared among siblings
    first; only when all of them are full does their parent's capacity bind, and the rest goes to the
    parent's siblings.
    """
    leaves = unit_rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("leaf_tokens"))
    leaves = leaves.withColumn("capacity", F.col("leaf_tokens") * mixture.max_epochs)
    root = leaves.agg(F.floor(F.sum("leaf_tokens") * mixture.budget_percent / 100).cast("long").alias("budget"))
    domains = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity")).join(root)
    domains = _pour(domains, (), "domain", mixture).select("domain", "budget")
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).join(domains, "domain")
    langs = _pour(langs, ("domain",), "lang", mixture).select("domain", "lang", "budget")
    poured = _pour(leaves.join(langs, ["domain", "lang"]), ("domain", "lang"), "source", mixture)
    return poured.select(*LEVELS, "leaf_tokens", F.col("budget").alias("leaf_budget"))


def choose(docs: DataFrame, mixture: Mixture = Mixture(), domain: Column | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epoch, leaf_tokens, leaf_budget): a row a unit and epoch.

    A leaf's budget takes whole epochs first; the last epoch is taken in seeded order as a prefix:
    units before which fewer tokens stand than the epoch's share.  So a leaf gives its budget and
    less than one document more.  Prefix sums go by leading digits of the order key first, then
    within them, so that a leaf of any size is never one task.

    Null and empty texts have 0 tokens and go with the units around them; a leaf without tokens gives
    nothing.  A null doc_id is a unit like any other, and repeated rows are one unit.  Very long texts are
    counted whole.  Units whose order keys tie follow by doc_id.  An empty table gives no rows.  Columns of
    docs named like a result's (domain, n_tokens, epoch, leaf_tokens, leaf_budget) are ignored.
    """
    rows = common.kept(units(docs, domain), "units")
    leaf = common.kept(budgets(rows, mixture), "budgets")
    digits = max(1, math.ceil(math.log(max(1, rows.count()) / 5000, 16))) if rows.take(1) else 1
    tokens = F.greatest(F.col("leaf_tokens"), F.lit(1))
    leaf = leaf.withColumn("whole", F.floor(F.col("leaf_budget") / tokens).cast("long"))
    leaf = leaf.withColumn("rest", F.col("leaf_budget") - F.col("whole") * F.col("leaf_tokens"))
    rows = rows.join(leaf, list(LEVELS))
    key = F.md5(F.concat_ws(":", F.lit(str(mixture.seed)), F.col("whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = rows.withColumn("key", key).withColumn("lead", F.substring("key", 1, digits))
    sums = rows.groupBy(*LEVELS, "lead").agg(F.sum("n_tokens").alias("here"))
    ahead = Window.partitionBy(*LEVELS).orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*LEVELS, "lead", F.coalesce(F.sum("here").over(ahead), F.lit(0)).alias("base"))
    rows = rows.join(sums, [*LEVELS, "lead"])
    within = Window.partitionBy(*LEVELS, "lead").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    last = F.col("whole") - F.when(F.col("ahead") < F.col("rest"), 0).otherwise(1)
    rows = rows.withColumn("last", last).where("last >= 0")
    epoch = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("epoch")
    return rows.select("doc_id", *LEVELS, "n_tokens", epoch, "leaf_tokens", "leaf_budget")


def mix(docs: DataFrame, mixture: Mixture = Mixture(), domain: Column | None = None) -> DataFrame:
    """The chosen rows of docs with its own columns, a row as often as it has epochs.  Repeated rows come
    and go together; columns of docs named like a unit's keep their own values."""
    times = choose(docs, mixture, domain).groupBy("doc_id", "lang", "source").agg((F.max("epoch") + 1).alias("_times"))
    times = times.select(F.col("doc_id").alias("_doc"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), "_times")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.coalesce("lang", F.lit("")) == F.col("_lang")) & (F.coalesce("source", F.lit("")) == F.col("_source"))
    rows = docs.join(times, same).withColumn("_epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return rows.select(*[docs[c] for c in docs.columns])


def oracle_sql(mixture: Mixture = Mixture()) -> str:
    """choose() over the table documents, in DuckDB's SQL."""

    def weight(level: str) -> str:
        names = sorted(getattr(mixture, level).items())
        return f"CAST(CASE {' '.join(f"WHEN {level} = '{n}' THEN {w}" for n, w in names)} ELSE {mixture.other} END AS BIGINT)" if names else f"CAST({mixture.other} AS BIGINT)"

    def pour(source: str, parents: str, level: str, keys: str) -> str:
        part = f"PARTITION BY {parents}" if parents else ""
        return f"""(SELECT {keys}, capacity, least(capacity, CAST(floor(height * weight) AS BIGINT)) AS budget FROM (
  SELECT *, max(CAST(budget - ahead AS DOUBLE) / onward) OVER ({part}) AS height FROM (
    SELECT *, coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead,
      sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward
    FROM (SELECT *, {weight(level)} AS weight FROM {source}) w
    WINDOW o AS ({part} ORDER BY CAST(capacity AS DOUBLE) / weight, {level})) x) y)"""

    return f"""
WITH base AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '8' THEN 'reference' ELSE 'web' END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents),
unit AS (SELECT doc_id, domain, lang, source, CAST(sum(n) AS BIGINT) AS n_tokens FROM base GROUP BY ALL),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS leaf_tokens,
    CAST(sum(n_tokens) * {mixture.max_epochs} AS BIGINT) AS capacity FROM unit GROUP BY ALL),
d0 AS (SELECT domain, CAST(sum(capacity) AS BIGINT) AS capacity,
    (SELECT CAST(floor(sum(leaf_tokens) * {mixture.budget_percent} / 100) AS BIGINT) FROM leaf) AS budget FROM leaf GROUP BY domain),
d1 AS (SELECT * FROM {pour('d0', '', 'domain', 'domain')} t),
l0 AS (SELECT leaf.domain, lang, CAST(sum(leaf.capacity) AS BIGINT) AS capacity, any_value(d1.budget) AS budget
    FROM leaf JOIN d1 USING (domain) GROUP BY leaf.domain, lang),
l1 AS (SELECT * FROM {pour('l0', 'domain', 'lang', 'domain, lang')} t),
s0 AS (SELECT leaf.domain, leaf.lang, source, leaf_tokens, leaf.capacity, l1.budget
    FROM leaf JOIN l1 ON leaf.domain = l1.domain AND leaf.lang = l1.lang),
s1 AS (SELECT * FROM {pour('s0', 'domain, lang', 'source', 'domain, lang, source, leaf_tokens')} t),
b AS (SELECT domain, lang, source, leaf_tokens, budget AS leaf_budget, budget // greatest(leaf_tokens, 1) AS whole,
    budget - (budget // greatest(leaf_tokens, 1)) * leaf_tokens AS rest FROM s1),
u AS (SELECT unit.*, leaf_tokens, leaf_budget, whole, rest,
    md5('{mixture.seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
    FROM unit JOIN b USING (domain, lang, source)),
p AS (SELECT *, whole - CASE WHEN coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < rest THEN 0 ELSE 1 END AS last FROM u)
SELECT doc_id, domain, lang, source, n_tokens, CAST(unnest(range(0, last + 1)) AS BIGINT) AS epoch, leaf_tokens, leaf_budget
FROM p WHERE last >= 0"""
