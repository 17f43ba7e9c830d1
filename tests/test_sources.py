import hashlib
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from chronoframe.sources import readers as R
from chronoframe.sources import sinks as S


def _history(start, total, size, rows):
    return {"history": {"columns": ["SECID", "BOARDID", "TRADEDATE", "CLOSE", "VOLUME"], "data": rows}, "history.cursor": {"columns": ["INDEX", "TOTAL", "PAGESIZE"], "data": [[start, total, size]]}}


ROWS = [["AAA", "TQ", "2024-01-02", 10.5, 100], ["AAA", "TQ", "2024-01-03", None, 5]]


def test_columnar_history(spark):
    df = spark.createDataFrame([(json.dumps(_history(0, 2, 100, ROWS)),)], "payload string")
    got = R.price_history(df).orderBy("d").collect()
    assert [(r.entity, r.board, r.d, r.close, r.volume, r.open) for r in got] == [("AAA", "TQ", dt.date(2024, 1, 2), 10.5, 100.0, None), ("AAA", "TQ", dt.date(2024, 1, 3), None, 5.0, None)]


def test_columnar_rejects_ragged_rows(spark):
    df = spark.createDataFrame([(json.dumps(_history(0, 1, 1, [["AAA", "TQ"]])),)], "payload string")
    with pytest.raises(Exception, match="fit its columns"):
        R.price_history(df).collect()


def test_pages_follow_the_cursor():
    asked = []

    def fetch(start):
        asked.append(start)
        return _history(start, 250, 100, [])

    assert len(list(R.pages(fetch))) == 3 and asked == [0, 100, 200]


def test_retry_backs_off():
    waits, tries = [], iter([R.Retry(), TimeoutError(), {"ok": 1}])

    def fetch():
        x = next(tries)
        if isinstance(x, Exception):
            raise x
        return x

    assert R.with_retry(fetch, backoff=0.5, sleep=waits.append) == {"ok": 1} and waits == [0.5, 1.0]


def test_jobs_resume_and_fail_alone():
    jobs = [{"secid": s, "boardid": "TQ", "priority": p, "status": "pending", "next_start": 0} for s, p in (("B", 1), ("A", 0), ("X", 2))]

    def fetch(job, start):
        if job["secid"] == "X":
            raise ValueError("broken")
        return _history(start, 20, 10, [])

    out = {j["secid"]: j for j in R.run_jobs(jobs, fetch, lambda j, p: 10, most_requests=3)}
    assert (out["A"]["status"], out["A"]["rows"], out["B"]["status"], out["B"]["next_start"], out["X"]["status"]) == ("completed", 20, "running", 10, "pending")
    out = {j["secid"]: j for j in R.run_jobs(list(out.values()), fetch, lambda j, p: 10, most_requests=30)}
    assert out["B"]["status"] == "completed" and out["X"]["status"] == "failed" and "broken" in out["X"]["error"]


def test_boards_seed_once(spark):
    block = {"boards": {"columns": ["secid", "boardid", "engine", "market", "is_primary", "history_from"], "data": [["A", "TQ", "stock", "shares", 1, "2010-01-01"], ["A", "SM", "stock", "shares", 0, "2011-01-01"], ["A", "FX", "currency", "selt", 0, "2011-01-01"], ["A", "NO", "stock", "shares", 0, None]]}}
    boards = R.history_boards(spark.createDataFrame([(json.dumps(block),)], "payload string"))
    assert sorted(r.boardid for r in boards.collect()) == ["SM", "TQ"] and R.primary_board(boards).first().boardid == "TQ"
    universe = spark.createDataFrame([("A",)], "secid string")
    jobs = R.seed_jobs(universe, boards, None)
    assert jobs.count() == 2 and R.seed_jobs(universe, boards, jobs).count() == 0


def test_currency_xml(spark, tmp_path):
    (tmp_path / "x.xml").write_text('<ValCurs><Record Date="02.01.2024" Id="USD"><Nominal>10</Nominal><Value>905,5</Value></Record></ValCurs>')
    r = R.currency_rates(spark, str(tmp_path / "x.xml")).first()
    assert (r.code, r.d, r.rate, r.available) == ("USD", dt.date(2024, 1, 2), 90.55, dt.date(2024, 1, 3))


def test_html_tables_and_numbers(spark):
    html = "<table><tr><th>Date</th><th>Rate</th></tr><tr><td>02.01.2024</td><td>16,00</td></tr><tr><td>bad</td><td>1</td></tr></table>"
    r = R.rate_table(spark.createDataFrame([(html,)], "html string")).collect()
    assert [(x.d, x.value) for x in r] == [(dt.date(2024, 1, 2), 16.0)]
    curve = "<table><tr><td>02.01.2024</td><td>7,5</td><td>8</td></tr><tr><td>03.01.2024</td><td>7</td><td>-</td></tr></table>"
    c = R.zero_curve(spark.createDataFrame([(curve,)], "html string"), (1, 5)).orderBy("tenor").collect()
    assert [(x.tenor, x["yield"]) for x in c] == [(1.0, 7.5), (5.0, 8.0)]
    n = spark.createDataFrame([("1 234,5",), ("(7)",), ("-3.5",), ("x",)], "s string").select(R.number("s").alias("n"))
    assert [x.n for x in n.collect()] == [1234.5, -7.0, -3.5, None]


def test_rss(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>Profit &amp; growth</title><link>u</link><description>&lt;b&gt;Long&lt;/b&gt;  text</description><pubDate>Tue, 02 Jan 2024 10:00:00 +0000</pubDate></item></channel></rss>")
    now = F.lit(dt.datetime(2024, 1, 3, 12, 0))
    r = R.rss(spark, str(tmp_path / "f.xml"), "s", now).first()
    assert (r.headline, r.summary, r.language, len(r.news_id)) == ("Profit & growth", "Long text", "en", 20) and r.published < r.available_from


def test_csv_series_and_report(spark, tmp_path):
    (tmp_path / "s.csv").write_text("DATE,X\n2024-01-02,1.5\n2024-01-03,.\n")
    assert [(r.d, r.value, r.available) for r in R.series_csv(spark, str(tmp_path / "s.csv"), "X").collect()] == [(dt.date(2024, 1, 2), 1.5, dt.date(2024, 1, 3))]
    (tmp_path / "r.csv").write_text("issuer,period,metric,value,unit\nA,2024-03-31,profit,\"1 000,5\",rub\n")
    assert R.report(spark, str(tmp_path / "r.csv")).first().value == 1000.5
    (tmp_path / "bad.csv").write_text("issuer,period\nA,2024-03-31\n")
    with pytest.raises(ValueError, match="expected"):
        R.report(spark, str(tmp_path / "bad.csv"))


def test_documents_by_content(spark, tmp_path):
    for name, text in (("a.txt", "x"), ("b.txt", "x"), ("c.txt", "y")):
        (tmp_path / name).write_text(text)
    assert sorted(r.path[-5:] for r in R.documents(spark, str(tmp_path)).collect()) == ["a.txt", "c.txt"]


def test_append_upsert_and_replace(spark, tmp_path):
    t = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string, at int")
    assert S.append_absent(rows((1, "a", 1), (1, "b", 1), (2, "c", 1)), t, ["k"]) == 2
    assert S.append_absent(rows((1, "z", 9), (3, "d", 1)), t, ["k"]) == 1
    assert sorted(map(tuple, spark.read.parquet(t).collect())) == [(1, "a", 1), (2, "c", 1), (3, "d", 1)]
    S.upsert(rows((1, "new", 5), (4, "e", 1)), t, ["k"], "at")
    assert sorted(map(tuple, spark.read.parquet(t).collect())) == [(1, "new", 5), (2, "c", 1), (3, "d", 1), (4, "e", 1)]
    with pytest.raises(ValueError, match="repeat"):
        S.staged_replace(rows((1, "a", 1), (1, "b", 1)), t, ["k"])
    assert spark.read.parquet(t).count() == 4 and S.staged_replace(rows((7, "x", 1)), t, ["k"]) == 1


def test_versioned_replace_and_raw_landing(spark, tmp_path):
    t, raw = str(tmp_path / "v"), str(tmp_path / "raw")
    S.replace_version(spark.createDataFrame([(1, "v1"), (2, "v2")], "x int, calculation_version string"), t)
    S.replace_version(spark.createDataFrame([(9, "v2")], "x int, calculation_version string"), t)
    assert sorted((r.x, r.calculation_version) for r in spark.read.parquet(t).collect()) == [(1, "v1"), (9, "v2")]
    pay = spark.createDataFrame([("p",), ("p",), ("q",)], "payload string")
    S.land_raw(pay, raw)
    S.land_raw(pay, raw)
    assert spark.read.parquet(raw).count() == 2


def test_ledger_runs_once(spark, tmp_path):
    ledger, done = S.Ledger(spark, str(tmp_path / "l")), []
    assert ledger.run("r1", lambda: done.append(1)) and not ledger.run("r1", lambda: done.append(1)) and done == [1]


def test_stream_ingest_is_idempotent(spark, tmp_path):
    from chronoframe.streaming import streams as St

    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    frame = lambda *x: spark.createDataFrame(list(x), "k long, v string")
    frame((1, "a"), (2, "b")).write.parquet(src)
    go = lambda: St.ingest(St.source(spark, src, "k long, v string"), out, ck, ["k"])
    go()
    frame((2, "x"), (3, "c")).write.mode("append").parquet(src)
    go()
    go()
    assert sorted((r.k, r.v) for r in spark.read.option("recursiveFileLookup", "true").schema("k long, v string").parquet(out).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_securities_keep_inactive_cards(spark):
    from chronoframe.sources import readers as Rd

    block = json.dumps({"securities": {"columns": ["SECID", "SHORTNAME", "ISIN", "IS_TRADED", "TYPE"], "data": [["A", "a", "1", 1, "common_share"], ["A", "old", "0", 0, "common_share"], ["B", "b", None, 0, "preferred_share"], ["C", "c", "3", 1, "bond"]]}})
    got = {r.entity: (r.name, r.active) for r in Rd.securities(spark.createDataFrame([(block,)], "payload string")).collect()}
    assert got == {"A": ("a", True), "B": ("b", False)}


def test_futures_candles_and_series(spark):
    from chronoframe.sources import readers as Rd

    one = lambda d: spark.createDataFrame([("E", json.dumps(d))], "entity string, payload string")
    f = one({"history": {"columns": ["SECID", "TRADEDATE", "CLOSE", "OPENPOSITION"], "data": [["SiH4", "2024-01-09", 10.5, 77], ["SiH4", "2024-01-10", None, 78]]}})
    assert [(r.contract, str(r.d), r.close, r.open_interest) for r in Rd.futures_history(f).collect()] == [("SiH4", "2024-01-09", 10.5, 77.0)]
    c = one({"candles": {"columns": ["begin", "end", "open", "close"], "data": [["2024-01-09 10:00:00", "2024-01-09 10:00:59", 1.0, 2.0]]}})
    r = Rd.candles(c, ["entity"]).first()
    assert (r.entity, str(r.available), r.close, r.volume) == ("E", "2024-01-09 10:00:59", 2.0, None)
    s = one({"history": {"columns": ["SECID", "TRADEDATE", "CLOSE", "WAPRICE"], "data": [["MAIN", "2024-01-09", None, 5.0], ["MAIN", None, 1.0, 1.0]]}})
    assert [(r.series, str(r.available), r.value) for r in Rd.index_series(s, "idx").collect()] == [("idx_main", "2024-01-10", 5.0)]


def test_html_report_is_strict(spark):
    from chronoframe.sources import readers as Rd

    head = "<table><tr><th>issuer</th><th>period</th><th>metric</th><th>value</th><th>unit</th></tr>"
    page = lambda body: spark.createDataFrame([(head + body + "</table>",)], "html string")
    row = "<tr><td>X</td><td>2024-03-31</td><td>profit</td><td>(1 234,5)</td><td>mln</td></tr>"
    assert [(r.issuer, str(r.period), r.value) for r in Rd.report_html(page(row)).collect()] == [("X", "2024-03-31", -1234.5)]
    for bad in (page("<tr><td>X</td></tr>"), page(row.replace("(1 234,5)", "many")), spark.createDataFrame([("<table><tr><th>a</th></tr><tr><td>1</td></tr></table>",)], "html string")):
        with pytest.raises(Exception):
            Rd.report_html(bad).collect()


def test_overnight_rate_is_known_on_the_next_business_day(spark):
    from chronoframe.sources import readers as Rd

    html = "<table>" + "".join(f"<tr><td>{d}</td><td>7,{k}</td></tr>" for k, d in enumerate(("11.01.2024", "12.01.2024", "13.01.2024"))) + "</table>"
    got = [(str(r.d), r.value, str(r.available)) for r in Rd.overnight_rate(spark.createDataFrame([(html,)], "html string")).orderBy("d").collect()]
    assert got == [("2024-01-11", 7.0, "2024-01-12 12:00:00"), ("2024-01-12", 7.1, "2024-01-15 12:00:00"), ("2024-01-13", 7.2, "2024-01-15 12:00:00")]


def test_unsafe_series_stay_out(spark):
    from chronoframe.sources import readers as Rd

    known = Rd.definitions(spark, [("a", "A", "%", "daily", "s", None, "next day", "final", True, ""), ("b", "B", "%", "monthly", "s", None, "unknown", "unknown", False, "metadata only")])
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "series string, value double")
    assert [r.series for r in Rd.safe_observations(rows, known).collect()] == ["a"]


def test_timestamped_landing_is_never_overwritten(spark, tmp_path):
    from chronoframe.sources import sinks as Sk

    rows = spark.createDataFrame([("x",)], "payload string")
    target = f"file://{tmp_path}/raw"
    Sk.land_timestamped(rows, target, "20240109T100000", "iss")
    Sk.land_timestamped(rows, target, "20240109T100001", "iss")
    with pytest.raises(ValueError, match="already landed"):
        Sk.land_timestamped(rows, target, "20240109T100000", "iss")
    got = spark.read.parquet(target).collect()
    assert len(got) == 2 and {r.content_hash for r in got} == {hashlib.sha256(b"x").hexdigest()}
