"""Sources over landed files: columnar JSON blocks, histories, currency XML, HTML tables, RSS, CSV.

Network access stays outside: payloads are landed first (sinks.land_raw) and read from there."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoframe.functions.expr import key_hash
from chronoframe.operators.windows import latest

PRICES = T.StructType([T.StructField(n, T.StringType()) for n in ("entity", "board")] + [T.StructField("d", T.DateType())] + [T.StructField(n, T.DoubleType()) for n in ("open", "high", "low", "close", "volume", "value")])


class Retry(Exception):
    """An answer worth another try: too many requests or a server's failure."""


def with_retry(fetch: Callable[[], dict], tries: int = 4, backoff: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> dict:
    """fetch(), again after backoff * 2^attempt seconds on Retry or a timeout."""
    for attempt in range(tries):
        try:
            return fetch()
        except (Retry, TimeoutError):
            if attempt == tries - 1:
                raise
            sleep(backoff * 2**attempt)
    raise AssertionError


def pages(fetch: Callable[[int], dict], block: str = "history") -> Iterator[dict]:
    """Payloads of a cursor-paginated history: the cursor block gives index, total and page size."""
    start = 0
    while True:
        payload = fetch(start)
        yield payload
        cursor = payload.get(f"{block}.cursor", {}).get("data") or []
        if not cursor:
            return
        index, total, size = cursor[0][:3]
        start = index + size
        if size <= 0 or start >= total:
            return


def columnar(payloads: DataFrame, block: str, fields: dict[str, str], text: str = "payload") -> DataFrame:
    """Rows of a {"block": {"columns": [...], "data": [[...], ...]}} document; fields: name -> type.

    A data row shorter or longer than the columns fails; a field that is not among them is null."""
    schema = f"`{block}` struct<columns: array<string>, data: array<array<string>>>"
    rows = payloads.withColumn("_b", F.from_json(text, schema)[block]).withColumn("_r", F.explode("_b.data"))
    names = F.transform("_b.columns", F.lower)
    fits = F.when(F.size("_r") != F.size(names), F.raise_error(F.lit("a data row doesn't fit its columns")).cast("array<string>")).otherwise(F.col("_r"))
    rows = rows.withColumn("_m", F.map_from_arrays(names, fits))
    cells = [F.expr(f"try_cast(try_element_at(_m, '{name.lower()}') AS {kind})").alias(name) for name, kind in fields.items()]
    return rows.select(*[c for c in payloads.columns if c != text], *cells)


HISTORY = {"secid": "string", "boardid": "string", "tradedate": "date", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double", "value": "double"}


def price_history(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """History blocks as price rows in the panel's columns."""
    rows = columnar(payloads.select(text), "history", HISTORY, text)
    return rows.select(F.col("secid").alias("entity"), F.col("boardid").alias("board"), F.col("tradedate").alias("d"), "open", "high", "low", "close", "volume", "value")


def history_boards(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Boards with a stock history in shares or indices."""
    rows = columnar(payloads.select(text), "boards", {"secid": "string", "boardid": "string", "engine": "string", "market": "string", "is_primary": "int", "history_from": "date", "history_till": "date"}, text)
    return rows.where((F.col("engine") == "stock") & F.col("market").isin("shares", "index") & F.col("history_from").isNotNull())


def primary_board(boards: DataFrame) -> DataFrame:
    return latest(boards.where("is_primary = 1"), ["secid"], [F.col("history_from"), F.col("boardid")])


def dividends(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Registry dates and values; declared and payment dates are unknown here and stay null."""
    rows = columnar(payloads.select(text), "dividends", {"secid": "string", "registryclosedate": "date", "value": "double", "currencyid": "string"}, text)
    none = F.lit(None).cast("date")
    return rows.select(F.col("secid").alias("entity"), F.col("registryclosedate").alias("d"), F.col("value").alias("dividend"), F.col("currencyid").alias("currency"), none.alias("declared"), none.alias("paid"))


def seed_jobs(universe: DataFrame, boards: DataFrame, jobs: DataFrame | None) -> DataFrame:
    """New (secid, board) jobs of eligible entities, pending, primary boards first."""
    wanted = universe.select("secid").join(boards, "secid").select("secid", "boardid", F.when(F.col("is_primary") == 1, 0).otherwise(1).alias("priority"))
    if jobs is not None:
        wanted = wanted.join(jobs.select("secid", "boardid"), ["secid", "boardid"], "left_anti")
    return wanted.select("secid", "boardid", "priority", F.lit("pending").alias("status"), F.lit(0).cast("long").alias("next_start"))


def run_jobs(jobs: Sequence[dict], fetch: Callable[[dict, int], dict], land: Callable[[dict, dict], int], most_requests: int, paused: Callable[[], bool] = lambda: False, deadline: float | None = None, clock: Callable[[], float] = time.monotonic) -> list[dict]:
    """Work pending, running and failed jobs in order of priority, a page at a time, within the request
    budget; each page is landed before its checkpoint moves.  A failure marks only its job."""
    out, requests, began = [], 0, clock()
    stop = lambda: requests >= most_requests or paused() or (deadline is not None and clock() - began > deadline)
    for job in sorted(jobs, key=lambda j: (j["priority"], j["secid"], j["boardid"])):
        job = dict(job)
        if job["status"] in ("pending", "running", "failed") and not stop():
            job["status"] = "running"
            try:
                while not stop():
                    payload = fetch(job, job["next_start"])
                    requests += 1
                    job["rows"] = job.get("rows", 0) + land(job, payload)
                    cursor = (payload.get("history.cursor", {}).get("data") or [[0, 0, 0]])[0]
                    job["next_start"] = cursor[0] + cursor[2]
                    if cursor[2] <= 0 or job["next_start"] >= cursor[1]:
                        job["status"] = "completed"
                        break
            except Exception as e:  # noqa: BLE001  the error is kept with the job
                job["status"], job["error"] = "failed", f"{type(e).__name__}: {e}"
        out.append(job)
    return out


def currency_rates(spark: SparkSession, path: str) -> DataFrame:
    """(code, d, rate) of currency XML files: <Record Date="dd.MM.yyyy"> with Nominal and Value, commas
    as decimal marks.  A rate holds from the day after its publication."""
    rows = spark.read.format("xml").option("rowTag", "Record").schema("_Date string, _Id string, Nominal string, Value string").load(path)
    number = lambda c: F.try_to_number(F.regexp_replace(F.regexp_replace(c, r"[\s ]", ""), ",", "."), F.lit("999999999.999999")).cast("double")
    d = F.to_date("_Date", "dd.MM.yyyy")
    return rows.select(F.col("_Id").alias("code"), d.alias("d"), (number("Value") / number("Nominal")).alias("rate"), F.date_add(d, 1).alias("available"))


class _Tables(HTMLParser):
    """Cells of all tables of a page."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_rows(pages_df: DataFrame, html: str = "html", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, row, cells) of every table row of the pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for record in b.to_dict("records"):
                parser = _Tables()
                parser.feed(record[html] or "")
                out += [{**{k: record[k] for k in keys}, "row": n, "cells": r} for n, r in enumerate(parser.rows) if r]
            yield pd.DataFrame(out, columns=[*keys, "row", "cells"])

    schema = T.StructType([*[pages_df.schema[k] for k in keys], T.StructField("row", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType()))])
    return pages_df.select(*keys, html).mapInPandas(run, schema)


def number(c: Column | str) -> Column:
    """A printed number: spaces between thousands, comma or point, brackets or a dash for minus."""
    x = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[\s  ']", "")
    negative = x.rlike(r"^(\(.*\)|[-−–].*)$")
    digits = F.regexp_replace(F.regexp_replace(x, r"[()−–-]", ""), ",", ".")
    value = digits.try_cast("double")
    return F.when(negative, -value).otherwise(value)


def rate_table(pages_df: DataFrame, html: str = "html") -> DataFrame:
    """(d, value, available) of two-column date/value tables; a rate is known the day after."""
    rows = html_rows(pages_df, html)
    d = F.try_to_timestamp(F.element_at("cells", 1), F.lit("dd.MM.yyyy")).cast("date")
    rows = rows.where(F.size("cells") >= 2).select(d.alias("d"), number(F.element_at("cells", 2)).alias("value"))
    return rows.where("d IS NOT NULL AND value IS NOT NULL").withColumn("available", F.date_add("d", 1))


def zero_curve(pages_df: DataFrame, tenors: Sequence[float], html: str = "html") -> DataFrame:
    """(d, tenor, yield) of a table with a date and a yield a tenor; rows with a missing yield or one
    outside 0..100 are left out whole."""
    rows = html_rows(pages_df, html).where(F.size("cells") == len(tenors) + 1)
    d = F.try_to_timestamp(F.element_at("cells", 1), F.lit("dd.MM.yyyy")).cast("date")
    values = F.transform(F.slice("cells", 2, len(tenors)), number)
    rows = rows.select(d.alias("d"), values.alias("v")).where("d IS NOT NULL").where(F.forall("v", lambda x: F.coalesce((x >= 0) & (x <= 100), F.lit(False))))
    return rows.select("d", F.explode(F.arrays_zip(F.array(*[F.lit(float(t)) for t in tenors]).alias("tenor"), F.col("v").alias("yield"))).alias("p")).select("d", F.col("p.tenor").alias("tenor"), F.col("p.yield").alias("yield"))


def rss(spark: SparkSession, path: str, source: str, retrieved: Column, most: int = 500) -> DataFrame:
    """News items: id from source, link and title; available when retrieved, never before."""
    rows = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string").load(path)
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]*>", " "), r"\s+", " "))
    published = F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w+,\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    language = F.when(F.col("title").rlike("[Ѐ-ӿ]"), "ru").otherwise("en")
    out = rows.select(key_hash(F.lit(source), "link", "title", length=20).alias("news_id"), F.lit(source).alias("source"), published.alias("published"), retrieved.alias("available_from"), plain(F.col("title")).alias("headline"),
                      F.left(plain(F.col("description")), F.lit(most)).alias("summary"), language.alias("language"))
    return out.withColumn("content_hash", F.sha2(F.concat_ws("|", "headline", "summary"), 256))


def series_csv(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(d, value, available) of a date,value CSV with '.' for missing; known the next day."""
    rows = spark.read.option("header", True).schema(f"d string, {value} string").csv(path)
    d = F.try_to_timestamp("d", F.lit("yyyy-MM-dd")).cast("date")
    return rows.select(d.alias("d"), F.col(value).try_cast("double").alias("value")).where("d IS NOT NULL AND value IS NOT NULL").withColumn("available", F.date_add("d", 1))


REPORT = ("issuer", "period", "metric", "value", "unit")


def report(spark: SparkSession, path: str) -> DataFrame:
    """A controlled report in CSV: exactly the expected columns, every value a number."""
    rows = spark.read.option("header", True).csv(path)
    if tuple(rows.columns) != REPORT:
        raise ValueError(f"columns {rows.columns}; expected {list(REPORT)}")
    value = F.coalesce(number("value"), F.raise_error(F.concat(F.lit("not a number: "), F.coalesce("value", F.lit("null")))).cast("double"))
    return rows.withColumn("period", F.to_date("period")).withColumn("value", value)


def report_html(pages_df: DataFrame, html: str = "html") -> DataFrame:
    """The same from a page's table: its first row must be the expected columns, by name and in order; a
    page without them, a row of another width and a value that isn't a number fail."""
    named = pages_df.withColumn("_page", F.sha2(html, 256))
    rows = html_rows(named, html, ["_page"])
    head = rows.groupBy("_page").agg(F.min_by("cells", "row").alias("_head"))
    expected = F.array(*[F.lit(c) for c in REPORT])
    wrong = F.raise_error(F.concat(F.lit("columns "), F.to_json("_head"), F.lit(f"; expected {list(REPORT)}"))).cast("array<string>")
    body = rows.join(head.withColumn("_head", F.when(F.transform("_head", F.lower) == expected, F.col("_head")).otherwise(wrong)), "_page").where(F.col("cells") != F.col("_head"))
    cells = F.when(F.size("cells") == len(REPORT), F.col("cells")).otherwise(F.raise_error(F.concat(F.lit("a row doesn't fit its columns: "), F.to_json("cells"))).cast("array<string>"))
    body = body.withColumn("cells", cells).select(*[F.element_at("cells", k + 1).alias(c) for k, c in enumerate(REPORT)])
    value = F.coalesce(number("value"), F.raise_error(F.concat(F.lit("not a number: "), F.coalesce("value", F.lit("null")))).cast("double"))
    return body.withColumn("period", F.to_date("period")).withColumn("value", value)


#: Where a series can be judged by what was known: its release rule, and whether that is verified.
DEFINITION = "series string, title string, unit string, frequency string, source string, first_day date, release_rule string, revision_rule string, safe boolean, note string"


def definitions(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Series definitions; a series whose history has no verified release times is kept as metadata with
    safe = false."""
    return spark.createDataFrame(list(rows), DEFINITION)


def safe_observations(observations: DataFrame, known: DataFrame) -> DataFrame:
    """Observations of the defined series that are point-in-time safe; all others stay out of strict use."""
    return observations.join(known.where("safe").select("series"), "series", "left_semi")


def overnight_rate(pages_df: DataFrame, hour: int = 15, zone: str = "Europe/Moscow", html: str = "html") -> DataFrame:
    """(d, value, available) of an overnight rate's table: published on the next business day at `hour`
    of the exchange's zone; Friday's and the weekend's on Monday."""
    rows = rate_table(pages_df, html).drop("available")
    ahead = F.when(F.dayofweek("d") == 6, 3).when(F.dayofweek("d") == 7, 2).otherwise(1)
    local = F.date_add("d", ahead).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hour))
    return rows.withColumn("available", F.convert_timezone(F.lit(zone), F.lit("UTC"), local))


#: Fields of the landed history blocks of other markets, as in HISTORY.
FUTURES = {"secid": "string", "tradedate": "date", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double", "value": "double", "openposition": "double"}
CANDLES = {"begin": "timestamp", "end": "timestamp", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double", "value": "double"}
SERIES_BLOCK = {"secid": "string", "tradedate": "date", "close": "double", "waprice": "double", "yield": "double"}


def futures_history(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Futures and option contracts' days as contract rows; days without a close are left out."""
    rows = columnar(payloads.select(text), "history", FUTURES, text)
    return rows.select(F.col("secid").alias("contract"), F.col("tradedate").alias("d"), "open", "high", "low", "close", "volume", "value", F.col("openposition").alias("open_interest")).where("close IS NOT NULL")


def candles(payloads: DataFrame, keys: Sequence[str], text: str = "payload") -> DataFrame:
    """Intraday candles with the payload's own keys (entity, interval); a candle is known at its end."""
    rows = columnar(payloads.select(*keys, text), "candles", CANDLES, text)
    return rows.select(*keys, F.col("begin").alias("ts"), F.col("end").alias("available"), "open", "high", "low", "close", "volume", "value")


def index_series(payloads: DataFrame, prefix: str, text: str = "payload") -> DataFrame:
    """(series, observed, available, value): index, currency and bond series of landed history blocks,
    named prefix_secid; the close, else the weighted price, known the day after."""
    rows = columnar(payloads.select(text), "history", SERIES_BLOCK, text)
    value = F.coalesce("close", "waprice")
    out = rows.select(F.concat(F.lit(f"{prefix}_"), F.lower("secid")).alias("series"), F.col("tradedate").alias("observed"), F.date_add("tradedate", 1).alias("available"), value.alias("value"))
    return out.where("observed IS NOT NULL AND value IS NOT NULL")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Files with their SHA-256, one row a content: the first path by name."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("content_hash"))
    return latest(rows, ["content_hash"], [F.col("path")])


def liquid_universe(stats: DataFrame, n: int) -> DataFrame:
    """The n most liquid entities; unknown liquidity counts as none."""
    return stats.orderBy(F.coalesce("liquidity", F.lit(0.0)).desc(), "entity").limit(n)


def securities(payloads: DataFrame, text: str = "payload") -> DataFrame:
    """Every share card found, inactive ones too: (entity, name, isin, active, kind), one row an entity, an
    active card before an inactive one; without the inactive ones a history would hold survivors only."""
    rows = columnar(payloads.select(text), "securities", {"secid": "string", "shortname": "string", "isin": "string", "is_traded": "int", "type": "string"}, text)
    rows = rows.select(F.col("secid").alias("entity"), F.col("shortname").alias("name"), "isin", (F.coalesce("is_traded", F.lit(0)) == 1).alias("active"), F.col("type").alias("kind")).where("entity IS NOT NULL")
    shares = rows.where(F.col("kind").isin("common_share", "preferred_share"))
    return latest(shares, ["entity"], [F.col("active").desc(), F.col("name").asc_nulls_last(), F.col("isin").asc_nulls_last()])
