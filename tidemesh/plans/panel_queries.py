"""Queries of sources, calendar, cleaning, joins and scalar functions."""

from __future__ import annotations

import datetime as dt
import io
import zipfile
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import calendar, cleaning, events, monthly
from ..sources import archives, scratch, sinks
from ..sources import panel as panels
from ..sources import quotes as files
from ..streaming import ingest
from .base import PAIRS, QUERIES, RETURNS, WINDOWED, WINDOWS, pairs, query, returns, rounded, windowed  # noqa: F401

RAW, QUOTES = panels.RAW_SQL, panels.QUOTES_SQL
TRADED = QUOTES + """,
tr AS (SELECT *, coalesce(close IS NOT NULL AND filled_close > 0 AND volume > 0 AND filled_close IS DISTINCT FROM lag(filled_close) OVER (PARTITION BY ticker ORDER BY obs_date), false) AS traded
       FROM (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY obs_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled_close FROM quotes))"""
QWINDOWS = WINDOWS.replace("FROM panel)", "FROM quotes)")
TWIN = TRADED + "," + QWINDOWS + """,
tw AS (SELECT tr.*, window_id, window_start, window_end FROM tr JOIN windows ON obs_date BETWEEN window_start AND window_end)"""
SUFFIX_CLASS = "CASE regexp_extract(ticker, '(\\d+)$', 1) WHEN '11' THEN 'UNIT' WHEN '4' THEN 'PN' WHEN '6' THEN 'PN' WHEN '8' THEN 'PN' WHEN '3' THEN 'ON' WHEN '5' THEN 'ON' WHEN '7' THEN 'ON' ELSE 'OUTRO' END"
ORDER = "CASE kind WHEN 'PN' THEN 0 WHEN 'ON' THEN 1 WHEN 'UNIT' THEN 2 ELSE 3 END"


def traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.traded_days(panels.quotes(spark, sf_dir))


def traded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traded(spark, sf_dir)
    return calendar.assign_windows(rows, calendar.month_windows(rows))


# Sources.


@query(f"WITH {QUOTES} SELECT obs_date, ticker, company, round(open, 2) AS open, round(close, 2) AS close, round(volume, 2) AS volume FROM quotes WHERE close IS NOT NULL")
def s1_fixed_width_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the panel as fixed-width lines and reads them back (S1, S2, S3); prices have two decimals."""
    lines = files.format_records(_records(spark, sf_dir))
    parsed = files.spot_market(files.parse_records(lines, files.EXTENDED))
    return rounded(parsed.select("obs_date", "ticker", "company", "open", "close", "volume"), 2)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = panels.quotes(spark, sf_dir).filter("close is not null")
    return q.withColumns({"market": F.lit("010"), "class_text": F.lit("PN"), "average": F.col("open"), "trades": F.lit(1)})


@query(f"WITH {QUOTES} SELECT count(*) AS records, count(DISTINCT ticker) AS assets, count(DISTINCT obs_date) AS days, min(obs_date) AS first_day, max(obs_date) AS last_day FROM quotes")
def s30_dataset_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.dataset_info(panels.quotes(spark, sf_dir))


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def s15_html_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as one HTML table a nation, with marks inside the cells, and read back."""
    s, n = panels.read(spark, sf_dir, "supplier"), panels.read(spark, sf_dir, "nation")
    row = F.concat(F.lit('<tr class="r">\n<td> '), "s_suppkey", F.lit("</td><TD><b>"), "s_name", F.lit("</b></TD><td>"), "n_name", F.lit("</td></tr>"))
    pages = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_nationkey").alias("page_id")).agg(F.concat(F.lit("<html><table>"), F.array_join(F.collect_list(row), "\n"), F.lit("</table></html>")).alias("html"))
    cells = files.companies_of_pages(pages)
    return cells.select(F.col("cells")[0].cast("long").alias("s_suppkey"), F.col("cells")[1].alias("s_name"), F.col("cells")[2].alias("n_name"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'N' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def s19_incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows, then a batch that repeats every third key: the batch's rows win."""
    old = panels.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return cleaning.append_batch(old, old.filter("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("N")), ["o_orderkey"])


@query("SELECT DISTINCT s_suppkey AS code, s_name AS company_name FROM supplier")
def s16_company_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("company_name")).distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5)")
def s17_filter_first_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the first five keys of a dimension (the feature is the limit)."""
    keys = panels.read(spark, sf_dir, "customer").select("c_custkey").orderBy("c_custkey").limit(5)
    return panels.read(spark, sf_dir, "orders").join(F.broadcast(keys), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders WHERE year(o_orderdate) % 2 = 1")
def s6_cached_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The years among archive paths; files of other series or without a year are none."""
    y = F.year("o_orderdate")
    name = F.when(y % 2 == 1, F.concat(F.lit("/raw/COTAHIST_A"), y, F.lit(".ZIP"))).otherwise(F.concat(F.lit("/raw/COTAHIST_M01"), y, F.lit(".ZIP")))
    return files.cached_years(panels.read(spark, sf_dir, "orders").select(name.alias("path")))


@query("""WITH c AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) % 2 = 1)
SELECT CAST(y AS INT) AS year FROM (SELECT unnest(generate_series(1990, 2001)) AS y) WHERE y = 2001 OR y NOT IN (SELECT y FROM c)""")
def s5_years_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past years that are cached stay; the present one, here 2001, is fetched again whether cached or not."""
    cached = s6_cached_years(spark, sf_dir)
    return files.years_to_fetch(cached.unionByName(cached.limit(1).withColumn("year", F.lit(2001))), 1990, 2001)


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 10")
def s9_bounded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten rows of a delimited file (the bound is the feature)."""
    path = scratch.folder(spark)
    sinks.write_csv(panels.read(spark, sf_dir, "nation").orderBy("n_nationkey").coalesce(1), path)
    return files.read_delimited(spark, path, "n_nationkey int, n_name string, n_regionkey int", rows=10).select("n_nationkey", "n_name")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s7_s8_s21_delimited_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written with a header and another appended; columns are projected from the typed scan."""
    path = scratch.folder(spark)
    sinks.write_csv(panels.read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), path)
    sinks.write_csv(panels.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal")), path, mode="append")
    return files.read_delimited(spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, NULL AS r_name FROM nation UNION ALL SELECT NULL, NULL, r_name FROM region")
def s22_rows_with_inferred_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.folder(spark)
    sinks.write_rows([panels.read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), panels.read(spark, sf_dir, "region").select("r_name")], path)
    return files.read_rows(spark, path)


@query("SELECT CAST(count(*) AS BIGINT) AS fetches, CAST(1 AS BIGINT) AS failed, CAST(sum(n) AS BIGINT) AS total_rows, min(a) AS first_day, max(b) AS last_day FROM (SELECT count(*) AS n, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY year(o_orderdate) UNION ALL SELECT 0, NULL, NULL)")
def s20_ingest_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fetch a year and one that failed, written to the log as one table, and the log's totals."""
    path = scratch.folder(spark)
    day = F.col("o_orderdate").cast("date")
    year = F.concat(F.lit("A"), F.year("o_orderdate").cast("string"))
    good = panels.read(spark, sf_dir, "orders").groupBy(year.alias("source")).agg(F.lit("success").alias("status"), F.count(F.lit(1)).alias("rows"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    bad = spark.range(1).select(F.lit("A2050").alias("source"), F.lit("failed").alias("status"), F.lit(7).cast("long").alias("rows"), F.lit(None).cast("date").alias("first_day"), F.lit(None).cast("date").alias("last_day"))
    sinks.append_logs(good.unionByName(bad), path)
    return sinks.log_summary(spark.read.parquet(path)).drop("last_update")


@query("""WITH o AS (SELECT CAST(year(o_orderdate) AS INT) AS year, o_orderkey, CAST(CASE WHEN o_orderdate < DATE '1998-01-01' THEN 0 ELSE 1 END AS BIGINT) AS batch_id FROM orders)
SELECT year, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, batch_id, any_value(batch_rows) AS batch_rows FROM o JOIN (SELECT batch_id, count(*) AS batch_rows FROM o GROUP BY 1) USING (batch_id) GROUP BY year, batch_id""")
def s19_s20_restartable_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders arrive in two lots and are ingested after each, and once more without anything new; rows by year and batch, and what the log says of the batch."""
    path = scratch.folder(spark)
    orders = panels.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("date")
    for lot in (early, ~early, None):
        if lot is not None:
            orders.filter(lot).coalesce(1).write.mode("append").parquet(f"{path}/in")
        ingest.ingest_files(spark, f"{path}/in", f"{path}/stream", f"{path}/table", f"{path}/log", lambda b: b.withColumn("year", F.year("o_orderdate")), "year", "o_orderdate")
    rows = spark.read.parquet(f"{path}/table").groupBy("year", F.col("batch_id").cast("long").alias("batch_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
    log = spark.read.parquet(f"{path}/log").select(F.col("batch_id").cast("long").alias("batch_id"), F.col("rows").alias("batch_rows"))
    return rows.join(log, "batch_id").select("year", "n", "keys", "batch_id", "batch_rows")


def _zipped(rows: DataFrame, keys: list[str], member: str, value: str = "value") -> DataFrame:
    """One ZIP archive (keys, content) for the lines of each key, in Latin-1: what a publisher's folder holds, made from the given tables.

    Spark sorts the lines, and each goes into its archive as it comes, so a
    task holds a batch of lines and what an archive has compressed so far.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, archive, file = None, None, None, None

        def closed() -> pa.RecordBatch:
            file.close()
            archive.close()
            return pa.RecordBatch.from_pylist([dict(zip(keys, now, strict=True), content=out.getvalue())], schema)

        for batch in batches:
            schema = pa.schema([*[batch.schema.field(k) for k in keys], ("content", pa.binary())])
            lines = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for key, part in groupby(lines, lambda x: x[:-1]):
                text = "\n".join(x[-1] for x in part).encode("latin-1")
                if key == now:
                    file.write(b"\n" + text)
                    continue
                if now is not None:
                    yield closed()
                now, out = key, io.BytesIO()
                archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                file = archive.open(member, "w", force_zip64=True)
                file.write(text)
        if now is not None:
            yield closed()

    kinds = dict(rows.dtypes)
    lines = rows.select(*keys, value).repartition(*keys).sortWithinPartitions(*keys, value)
    return lines.mapInArrow(pack, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "content binary"]))


@query(f"""WITH {QUOTES} SELECT obs_date, ticker, company, round(open, 2) AS open, round(close, 2) AS close, round(volume, 2) AS volume FROM quotes WHERE close IS NOT NULL AND obs_date BETWEEN DATE '1996-03-05' AND DATE '1998-09-20'""")
def s4_s5_archives_of_a_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly archives, and for 1997 monthly ones beside; those of a period are chosen by their names and scanned, spot market only.

    Every record is there twice, once in another market, and 1997's in both kinds of archive.
    """
    lines = files.format_records(_records(spark, sf_dir))
    lines = lines.unionByName(files.format_records(_records(spark, sf_dir).withColumn("market", F.lit("020"))))
    year, month = F.substring("value", 3, 4).cast("int"), F.substring("value", 7, 2).cast("int")
    yearly = lines.select(year.alias("year"), F.lit(None).cast("int").alias("month"), "value")
    monthly_ = lines.filter(year == 1997).select(year.alias("year"), month.alias("month"), "value")
    made = _zipped(yearly.unionByName(monthly_), ["year", "month"], "COTAHIST.TXT")
    name = F.concat(F.lit("/raw/COTAHIST_"), F.coalesce(F.concat(F.lit("M"), F.lpad(F.col("month").cast("string"), 2, "0")), F.lit("A")), F.col("year").cast("string"), F.lit(".ZIP"))
    found = archives.catalogue(made.select(name.alias("path"), "content"))
    first, last = dt.date(1996, 3, 5), dt.date(1998, 9, 20)
    chosen = archives.holding(found, archives.months_of(spark, first, last))
    rows = archives.records_of(chosen, first, last, files.EXTENDED, market="010")
    return rounded(rows.select("obs_date", "ticker", "company", "open", "close", "volume"), 2)


@query("SELECT CAST(y AS INT) AS year, CAST(m AS INT) AS month FROM (SELECT unnest(generate_series(1995, 1998)) AS y), (SELECT unnest(generate_series(1, 12)) AS m) WHERE y * 100 + m BETWEEN 199511 AND 199806 AND NOT (y = 1996 AND m IN (SELECT month(o_orderdate) FROM orders WHERE year(o_orderdate) = 1996)) AND y <> 1997")
def s4_months_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months of a period that neither 1996's monthly archives nor 1997's yearly one hold."""
    d = F.col("o_orderdate")
    name = F.when(F.year(d) == 1996, F.concat(F.lit("/raw/COTAHIST_M"), F.date_format(d, "MMyyyy"), F.lit(".ZIP"))).when(F.year(d) == 1997, F.lit("/raw/cotahist_a1997.zip")).otherwise(F.lit("/raw/readme.txt"))
    held = archives.catalogue(panels.read(spark, sf_dir, "orders").select(name.alias("path")).distinct())
    return archives.missing_months(held, archives.months_of(spark, dt.date(1995, 11, 20), dt.date(1998, 6, 2)))


@query("SELECT c_name AS name, CAST(c_custkey AS VARCHAR) AS key, round(c_acctbal, 2) AS balance FROM customer WHERE c_custkey IN (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5) OR c_mktsegment = 'MACHINERY'")
def s17_zipped_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as semicolon-separated Latin-1 files, one archive a market segment; rows of the first five keys (the limit is the feature) and of one segment."""
    c = panels.read(spark, sf_dir, "customer")
    line = F.concat_ws(";", F.lpad(F.col("c_custkey").cast("string"), 12, "0"), F.concat("c_name", F.lit(" Ação")), F.format_string("%.2f", "c_acctbal"), "c_mktsegment")
    head = c.select("c_mktsegment").distinct().select("c_mktsegment", F.lit("#KEY;NAME;BALANCE;SEGMENT").alias("value"))
    made = _zipped(c.select("c_mktsegment", line.alias("value")).unionByName(head), ["c_mktsegment"], "dfp_con.csv")
    rows = files.unpack_delimited(made, "_con", ["#KEY", "NAME", "BALANCE", "SEGMENT"]).withColumn("key", F.col("`#KEY`").cast("long"))
    first = F.broadcast(c.select("c_custkey").orderBy("c_custkey").limit(5).withColumn("_first", F.lit(True)))
    kept = rows.join(first, F.col("key") == F.col("c_custkey"), "left").filter(F.coalesce("_first", F.lit(False)) | (F.col("SEGMENT") == "MACHINERY"))
    return kept.select(F.regexp_replace("NAME", " Ação$", "").alias("name"), F.col("key").cast("string").alias("key"), F.col("BALANCE").cast("double").alias("balance"))


# Calendar.


@query(f"WITH {panels.PANEL_SQL}, {WINDOWS} SELECT window_id, window_start, window_end FROM windows")
def s12_windows_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows written as one JSON document and read back."""
    w, path = calendar.month_windows(panels.dates(spark, sf_dir)), scratch.folder(spark)
    item = F.struct(F.col("window_id").alias("id"), F.col("window_start").cast("string").alias("start"), F.col("window_end").cast("string").alias("end"))
    w.agg(F.to_json(F.struct(F.collect_list(item).alias("windows"))).alias("value")).coalesce(1).write.text(path)
    return files.read_windows(spark, path)


@query(f"WITH {panels.PANEL_SQL}, {WINDOWS} SELECT * FROM windows")
def w1_month_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.month_windows(panels.dates(spark, sf_dir))


@query(f"""WITH {panels.PANEL_SQL}, b AS (SELECT min(obs_date) AS lo, max(obs_date) AS hi FROM panel),
k AS (SELECT CAST(unnest(generate_series(0, 400)) AS INT) AS k)
SELECT k + 1 AS window_id, CAST(lo + to_months(k) AS DATE) AS window_start, CAST(lo + to_months(k + 12) AS DATE) AS window_end,
       strftime(lo + to_months(k), '%Y-%m') || ' a ' || strftime(lo + to_months(k + 12), '%Y-%m') AS label FROM b, k WHERE CAST(lo + to_months(k + 12) AS DATE) <= hi""")
def w2_offset_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.offset_windows(panels.dates(spark, sf_dir))


@query(f"WITH {WINDOWED} SELECT window_id, count(*) AS n, count(DISTINCT obs_date) AS days, round(sum(volume), 2) AS volume FROM win GROUP BY 1")
def w3_window_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monthly.window_totals(returns(spark, sf_dir), calendar.month_windows(panels.dates(spark, sf_dir))), 2)


@query(f"WITH {panels.PANEL_SQL}, {WINDOWS} SELECT window_id, CAST(datediff('month', window_start, window_end + 1) AS INT) AS months_covered, coalesce(CAST(datediff('month', lag(window_start) OVER (ORDER BY window_id), window_start) AS INT), 0) AS months_lag, true AS valid FROM windows")
def w4_window_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.validate_windows(calendar.month_windows(panels.dates(spark, sf_dir))).fillna({"months_lag": 0})


@query(f"WITH {panels.PANEL_SQL}, {WINDOWS} SELECT count(*) AS windows, min(window_start) AS first_start, min(window_end) AS first_end, max(window_start) AS last_start, max(window_end) AS last_end FROM windows")
def w5_window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.summarise_windows(calendar.month_windows(panels.dates(spark, sf_dir)))


@query(f"""WITH {panels.PANEL_SQL}, {WINDOWS} SELECT window_id, '{{"id":' || window_id || ',"start":"' || window_start || '","end":"' || window_end || '"}}' AS json FROM windows""")
def s25_windows_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar.windows_json(calendar.month_windows(panels.dates(spark, sf_dir)))


BUSINESS = "days AS (SELECT CAST(unnest(generate_series(min(l_shipdate), max(l_shipdate), INTERVAL 1 DAY)) AS DATE) AS day FROM lineitem), cal AS (SELECT day FROM days WHERE isodow(day) < 6)"


def _business(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = panels.read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("obs_date"))
    return calendar.business_days(dates)


@query(f"WITH {BUSINESS} SELECT day FROM cal")
def w6_business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _business(spark, sf_dir)


@query(f"WITH {BUSINESS} SELECT day FROM cal WHERE NOT (month(day) = 12 AND dayofmonth(day) = 25) AND NOT (month(day) = 1 AND dayofmonth(day) = 1)")
def w7_trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = panels.read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("obs_date"))
    days = _business(spark, sf_dir)
    holidays = days.filter(((F.month("day") == 12) & (F.dayofmonth("day") == 25)) | ((F.month("day") == 1) & (F.dayofmonth("day") == 1)))
    return calendar.trading_days(dates, holidays)


@query(f"""WITH {panels.PANEL_SQL}, {WINDOWS} SELECT window_id, CASE window_id % 4 WHEN 0 THEN window_start || ' a ' || window_end WHEN 1 THEN 'ate ' || window_end WHEN 2 THEN 'desde ' || window_start ELSE 'Janela ' || window_id END AS label FROM windows""")
def w8_window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = calendar.month_windows(panels.dates(spark, sf_dir))
    k = F.col("window_id") % 4
    return w.select("window_id", calendar.window_label(F.col("window_id"), F.when(k.isin(0, 2), F.col("window_start")), F.when(k.isin(0, 1), F.col("window_end"))).alias("label"))


MORE_WINDOWS = "more AS (SELECT * FROM windows UNION ALL SELECT CAST(max(window_id) + k AS INT), CAST(max(window_start) + to_months(CAST(k AS INT)) AS DATE), CAST(last_day(max(window_start) + to_months(CAST(k AS INT) + 11)) AS DATE) FROM windows, (SELECT unnest([1, 2, 3]) AS k) GROUP BY k)"


def and_three_more(windows: DataFrame) -> DataFrame:
    """The windows and the three that would follow, which have no data yet."""
    last = windows.agg(F.max("window_id").alias("_n"), F.max("window_start").alias("_s")).select("_n", "_s", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k"))
    return windows.unionByName(last.select((F.col("_n") + F.col("k")).alias("window_id"), F.add_months("_s", F.col("k")).alias("window_start"), F.last_day(F.add_months("_s", F.col("k") + 11)).alias("window_end")))


@query(f"""WITH {WINDOWED}, {MORE_WINDOWS}, st AS (SELECT window_id, count(*) AS n FROM win GROUP BY 1)
SELECT w.window_id, window_start, window_end, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 0 ELSE 1 END AS modeled, CASE WHEN n IS NULL THEN 'no data' ELSE 'ok' END AS model_reason FROM more w LEFT JOIN st USING (window_id)""")
def w9_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, windows = windowed(spark, sf_dir)
    return calendar.with_placeholders(and_three_more(windows), rows.groupBy("window_id").agg(F.count(F.lit(1)).alias("n")), ["n"])


@query(f"WITH {panels.PANEL_SQL}, {WINDOWS} SELECT * FROM windows WHERE (window_id - 1) % 10 = 0 OR window_id = (SELECT max(window_id) FROM windows)")
def p12_every_nth_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.every_nth(calendar.month_windows(panels.dates(spark, sf_dir)), 10)


# Cleaning.


@query(f"WITH {RAW} SELECT obs_date, ticker, min(company) AS company, round(avg(price) + 3e-7, 6) AS price, round(avg(volume) + 3e-7, 6) AS volume FROM raw GROUP BY 1, 2")
def a1_mean_of_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleaning.mean_of_duplicates(panels.raw_quotes(spark, sf_dir), ["obs_date", "ticker"], ["price", "volume"], ["company"])
    # Means of decimals end in a 5 often; the shift keeps engines from rounding those two ways.
    return rounded(out.withColumns({c: F.col(c) + 3e-7 for c in ("price", "volume")}))


@query(f"WITH {TRADED} SELECT obs_date, ticker, filled_close, traded FROM tr")
def a3_traded_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traded(spark, sf_dir).select("obs_date", "ticker", "filled_close", "traded")


@query(f"WITH {TRADED} SELECT obs_date, ticker, round(coalesce(CASE WHEN filled_close > 0 AND p > 0 THEN ln(filled_close / p) END, 0), 6) + 0.0 AS log_return FROM (SELECT *, lag(filled_close) OVER (PARTITION BY ticker ORDER BY obs_date) AS p FROM tr)")
def a4_log_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cleaning.log_returns(traded(spark, sf_dir)).select("obs_date", "ticker", "log_return"))


@query(f"WITH {RETURNS} SELECT obs_date, asset, round(log_return, 6) + 0.0 AS log_return FROM ret")
def a5_log_returns_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(returns(spark, sf_dir).select("obs_date", "asset", "log_return"))


@query(f"WITH {QUOTES} SELECT obs_date, ticker, coalesce(close, 0) AS close FROM quotes")
def a6_fill_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.fill_constant(panels.quotes(spark, sf_dir), ["close"]).select("obs_date", "ticker", "close")


MISSING = f"WITH {QUOTES}, m AS (SELECT ticker, count(*) AS total, count(close) AS valid, count(*) - count(close) AS missing, round(100.0 * (count(*) - count(close)) / count(*), 6) AS missing_pct, min(obs_date) FILTER (WHERE close IS NOT NULL) AS first_valid, max(obs_date) FILTER (WHERE close IS NOT NULL) AS last_valid FROM quotes GROUP BY 1)"


@query(MISSING + " SELECT * FROM m")
def a7_missing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cleaning.missing_report(panels.quotes(spark, sf_dir)))


@query(MISSING + " SELECT * FROM m ORDER BY missing_pct DESC, ticker LIMIT 10")
def a7_missing_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a7_missing_report(spark, sf_dir).orderBy(F.col("missing_pct").desc(), "ticker").limit(10)


LIFE = TRADED + """,
td AS (SELECT obs_date, row_number() OVER (ORDER BY obs_date) AS day FROM (SELECT DISTINCT obs_date FROM tr WHERE traded)),
life AS (SELECT ticker, min(company) AS company, count(DISTINCT tr.obs_date) AS traded_days, max(day) - min(day) + 1 AS life_days, avg(volume) AS mean_volume, count(DISTINCT tr.obs_date) / (max(day) - min(day) + 1) AS completeness
         FROM tr JOIN td USING (obs_date) WHERE traded GROUP BY 1)"""


@query(f"WITH {LIFE} SELECT ticker, company, traded_days, life_days, round(mean_volume, 4) AS mean_volume, round(completeness, 6) AS completeness FROM life WHERE completeness >= 0.3 AND mean_volume >= 1000")
def a8_life_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleaning.eligible(cleaning.life_completeness(traded(spark, sf_dir)), 0.3, 1000)
    return out.select("ticker", "company", "traded_days", "life_days", F.round("mean_volume", 4).alias("mean_volume"), F.round("completeness", 6).alias("completeness"))


@query(f"WITH {LIFE} SELECT company, ticker, traded_days FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY CASE WHEN ticker LIKE '%11' THEN 2 WHEN ticker LIKE '%4' THEN 0 WHEN ticker LIKE '%3' THEN 1 ELSE 3 END, traded_days DESC, ticker) AS rn FROM life) WHERE rn = 1")
def a9_one_per_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.one_per_company(cleaning.life_completeness(traded(spark, sf_dir)), "traded_days").select("company", "ticker", "traded_days")


@query(f"""WITH {QUOTES} SELECT DISTINCT ticker, CASE WHEN ticker LIKE '%11' THEN 'UNIT' WHEN ticker LIKE '%4' THEN 'PN' WHEN ticker LIKE '%3' THEN 'ON' ELSE 'OUTRO' END AS by_end, {SUFFIX_CLASS} AS by_suffix, regexp_replace(ticker, '[^A-Za-z]', '', 'g') AS company FROM quotes""")
def a10_a11_a13_ticker_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = panels.quotes(spark, sf_dir).select("ticker").distinct()
    return t.select("ticker", cleaning.class_of_ticker("ticker").alias("by_end"), cleaning.class_of_suffix("ticker").alias("by_suffix"), cleaning.company_of_ticker("ticker").alias("company"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(t, 'UNIT|UNT') THEN 'UNIT' WHEN regexp_matches(t, '\\bPN[A-Z]*\\b') THEN 'PN' WHEN regexp_matches(t, '\\bON\\b') THEN 'ON' ELSE '' END AS kind FROM (SELECT p_partkey, upper(['unt n2', 'PNA ej', 'x on nm', 'ponte'][p_partkey % 4 + 1]) AS t FROM part)")
def a12_class_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.element_at(F.array(*map(F.lit, ("unt n2", "PNA ej", "x on nm", "ponte"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return panels.read(spark, sf_dir, "part").select("p_partkey", texts.alias("t")).select("p_partkey", cleaning.class_of_text("t").alias("kind"))


COVER = TWIN + """,
wd AS (SELECT window_id, count(DISTINCT obs_date) AS window_days FROM tw WHERE traded GROUP BY 1)"""


@query(f"WITH {COVER} SELECT window_id, ticker, count(DISTINCT obs_date) AS days, any_value(window_days) AS window_days, round(count(DISTINCT obs_date) / any_value(window_days), 6) AS ratio FROM tw JOIN wd USING (window_id) WHERE traded GROUP BY 1, 2")
def a14_window_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cleaning.window_completeness(traded_windows(spark, sf_dir), ["ticker"]))


CLASS_COVER = COVER + f""",
cc AS (SELECT window_id, company, kind, count(DISTINCT obs_date) AS days, least(count(DISTINCT obs_date) / any_value(window_days), 1.0) AS ratio FROM (SELECT *, {SUFFIX_CLASS} AS kind FROM tw WHERE traded) JOIN wd USING (window_id) GROUP BY 1, 2, 3),
ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY window_id, company ORDER BY {ORDER}, days DESC, kind) AS rn FROM cc WHERE ratio >= 0.5) WHERE rn = 1)"""


@query(f"WITH {CLASS_COVER} SELECT window_id, company, kind, days, round(ratio, 6) AS ratio FROM ch")
def a15_a16_class_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traded_windows(spark, sf_dir).withColumn("kind", cleaning.class_of_suffix("ticker"))
    cover = cleaning.window_completeness(rows, ["company", "kind"], clip=True)
    return rounded(cleaning.choose_class(cover, 0.5).select("window_id", "company", "kind", "days", "ratio"))


CANON = TRADED + f""",
cd AS (SELECT company, ticker, {SUFFIX_CLASS} AS kind, count(DISTINCT obs_date) AS days FROM tr WHERE traded GROUP BY 1, 2),
ca AS (SELECT company, ticker AS canonical, days FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY {ORDER}, days DESC, ticker) AS rn FROM cd) WHERE rn = 1)"""


@query(f"WITH {CANON} SELECT * FROM ca")
def a17_canonical_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.canonical_ticker(traded(spark, sf_dir), ["company"])


@query("""WITH c AS (SELECT 'C' || c_custkey AS company, 'T' || (c_custkey // 3) AS canonical, CAST(c_nationkey AS BIGINT) AS days FROM customer)
SELECT company, canonical, (SELECT max_by(b.company, (b.days, b.company)) FROM c b WHERE b.canonical = c.canonical) AS unified, count(*) OVER (PARTITION BY canonical) AS aliases FROM c""")
def a18_unify_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = panels.read(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("company"), F.concat(F.lit("T"), F.floor(F.col("c_custkey") / 3)).alias("canonical"), F.col("c_nationkey").cast("bigint").alias("days"))
    return cleaning.unify_aliases(c)


@query(f"""WITH {CLASS_COVER},
kd AS (SELECT company, {SUFFIX_CLASS} AS kind, ticker, count(DISTINCT obs_date) AS days FROM tw WHERE traded GROUP BY 1, 2, 3),
kn AS (SELECT company, kind, ticker AS canonical FROM (SELECT *, row_number() OVER (PARTITION BY company, kind ORDER BY {ORDER}, days DESC, ticker) AS rn FROM kd) WHERE rn = 1)
SELECT window_id, obs_date, canonical AS ticker, company, filled_close FROM (
  SELECT tw.window_id, tw.obs_date, coalesce(canonical, ticker) AS canonical, tw.company, filled_close, row_number() OVER (PARTITION BY tw.window_id, coalesce(canonical, ticker), obs_date ORDER BY volume DESC NULLS LAST, ticker) AS rn
  FROM (SELECT *, {SUFFIX_CLASS} AS kind FROM tw) tw JOIN ch ON tw.window_id = ch.window_id AND tw.company = ch.company AND tw.kind = ch.kind LEFT JOIN kn ON tw.company = kn.company AND tw.kind = kn.kind) WHERE rn = 1""")
def a20_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.consolidate(traded_windows(spark, sf_dir), 0.5).select("window_id", "obs_date", "ticker", "company", "filled_close")


@query(f"""WITH {WINDOWED}, s AS (SELECT window_id, count(DISTINCT asset) AS assets, count(DISTINCT obs_date) AS days, round(avg(log_return), 6) + 0.0 AS mean_return, round(stddev_samp(log_return), 6) AS volatility FROM win GROUP BY 1)
SELECT *, assets >= 0.9 * (SELECT max(assets) FROM s) AS complete, assets < 0.5 * (SELECT max(assets) FROM s) AS problematic FROM s""")
def a25_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(monthly.window_stats(returns(spark, sf_dir), calendar.month_windows(panels.dates(spark, sf_dir))))


@query(f"""WITH {BUSINESS}, p AS (SELECT DISTINCT CASE WHEN l_orderkey % 5 = 0 THEN CAST(l_shipdate AS DATE) END AS day FROM lineitem)
SELECT strftime(cal.day, '%Y-%m') AS year_month, count(*) AS expected_days, count(p.day) AS present_days, count(*) - count(p.day) AS missing_days, round(100.0 * count(p.day) / count(*), 6) AS coverage_pct FROM cal LEFT JOIN p ON cal.day = p.day GROUP BY 1""")
def a24_monthly_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other orders have an unknown date here, which makes gaps."""
    rows = panels.read(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 5 == 0, F.col("l_shipdate").cast("date")).alias("obs_date"))
    return rounded(cleaning.monthly_coverage(rows, _business(spark, sf_dir)))


@query(f"WITH {QUOTES}, w AS (SELECT DISTINCT company || s AS ticker FROM quotes, (SELECT unnest(['3', '4', '5', '6', '7', '8', '11']) AS s) WHERE regexp_matches(company, '^[A-Z]{{4}}$')) SELECT ticker FROM w")
def a22_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.whitelist(panels.quotes(spark, sf_dir).select(F.col("company").alias("base")))


@query(f"WITH {QUOTES} SELECT DISTINCT ticker FROM quotes WHERE ticker NOT IN (SELECT company || '3' FROM quotes)")
def a23_outside_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = panels.quotes(spark, sf_dir)
    return cleaning.outside(q, q.select(F.concat("company", F.lit("3")).alias("ticker")).distinct())


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1")
def a26_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panels.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return cleaning.keep_last(rows, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]).drop("l_linenumber")


@query(f"""WITH {QUOTES}, cal AS (SELECT DISTINCT obs_date FROM quotes), t AS (SELECT DISTINCT ticker FROM quotes)
SELECT cal.obs_date, t.ticker, close FROM cal CROSS JOIN t LEFT JOIN quotes ON quotes.obs_date = cal.obs_date AND quotes.ticker = t.ticker""")
def j1_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = panels.quotes(spark, sf_dir)
    return cleaning.densify(q.select("obs_date", "ticker", "close"), q.select(F.col("obs_date").alias("day")).distinct()).select("obs_date", "ticker", "close")


@query(f"WITH {PAIRS} SELECT window_id, asset_1, asset_2, round(rho, 6) + 0.0 AS rho FROM (SELECT window_id, asset_1, asset_2, rho FROM pairs UNION ALL SELECT window_id, asset_2, asset_1, rho FROM pairs)")
def j13_symmetrise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import correlation

    return rounded(correlation.symmetric(pairs(spark, sf_dir).select("window_id", "asset_1", "asset_2", "rho"), ["rho"]))


OFFICE = """
tl AS (SELECT 'N' || c_nationkey AS ticker, c_name AS name, DATE '1995-01-01' + CAST(c_custkey % 2000 AS INT) AS start, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE DATE '1995-01-01' + CAST(c_custkey % 2000 + 300 AS INT) END AS "end" FROM customer),
dd AS (SELECT 'N' || n_nationkey AS ticker, CAST(x AS DATE) AS day, 'R' || n_regionkey AS sigla FROM nation, (SELECT unnest(generate_series(DATE '1995-01-15', DATE '2000-12-15', INTERVAL 1 MONTH)) AS x))"""


@query(f"""WITH {OFFICE}, o AS (SELECT dd.ticker, day, max_by(name, (start, name)) AS name FROM dd JOIN tl ON dd.ticker = tl.ticker AND start <= day AND ("end" IS NULL OR "end" > day) GROUP BY 1, 2),
k AS (SELECT dd.ticker, dd.day, max_by(name, (start, name)) AS name FROM dd JOIN (SELECT DISTINCT ticker, sigla FROM dd) s ON dd.sigla = s.sigla AND dd.ticker <> s.ticker JOIN tl ON s.ticker = tl.ticker AND start <= dd.day AND ("end" IS NULL OR "end" > dd.day) GROUP BY 1, 2)
SELECT dd.ticker, dd.day, coalesce(o.name, k.name) AS name FROM dd LEFT JOIN o USING (ticker, day) LEFT JOIN k USING (ticker, day)""")
def j15_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = panels.read(spark, sf_dir, "customer")
    start = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 2000).cast("int"))
    tl = c.select(F.concat(F.lit("N"), "c_nationkey").alias("ticker"), F.col("c_name").alias("name"), start.alias("start"), F.when(F.col("c_custkey") % 3 != 0, F.date_add(start, 300)).alias("end"))
    n = panels.read(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("ticker"), F.concat(F.lit("R"), "n_regionkey").alias("sigla"))
    days = n.select("ticker", F.explode(F.expr("sequence(date'1995-01-15', date'2000-12-15', interval 1 month)")).alias("day"))
    return events.in_office(days, tl, n)


@query(f"WITH {TWIN} SELECT window_id, list_sort(list(DISTINCT upper(trim(ticker)))) AS tickers FROM tw GROUP BY 1")
def p13_window_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traded_windows(spark, sf_dir).select("window_id", F.upper(F.trim("ticker")).alias("t")).filter("t <> ''")
    return rows.groupBy("window_id").agg(F.sort_array(F.collect_set("t")).alias("tickers"))


# Scalars.


@query("SELECT doc_id, upper(regexp_replace(upper(trim(source)), '[^A-Z0-9]', '', 'g')) AS symbol, regexp_matches(upper(source), '^[A-Z]{1,4}\\d{1,2}$') AS legacy FROM documents")
def x1_x2_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = panels.read(spark, sf_dir, "documents")
    return d.select("doc_id", scalars.normalize_symbol(F.col("source")).alias("symbol"), scalars.is_legacy_symbol(F.upper("source")).alias("legacy"))


@query("SELECT c_custkey, CASE WHEN n_nationkey IS NULL THEN t ELSE 'NEW' || n_nationkey END AS ticker FROM (SELECT c_custkey, 'OLD' || (c_custkey % 50) AS t, c_custkey % 50 AS k FROM customer) LEFT JOIN nation ON k = n_nationkey")
def x3_remap_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = panels.read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("OLD"), F.col("c_custkey") % 50).alias("ticker"))
    m = panels.read(spark, sf_dir, "nation").select(F.concat(F.lit("OLD"), "n_nationkey").alias("legacy"), F.concat(F.lit("NEW"), "n_nationkey").alias("present"))
    return scalars.remap_legacy(c, m)


@query("SELECT p_partkey, trim(regexp_replace(upper(strip_accents(p_name)), '[^A-Z0-9]+', ' ', 'g')) || ' ACAO N SA N1' AS company FROM part")
def x4_company_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks and class words go, listing segments such as N1 stay."""
    return panels.read(spark, sf_dir, "part").select("p_partkey", scalars.normalize_company(F.concat("p_name", F.lit(" Ação ñ - SA PNC (PN)  N1 on"))).alias("company"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 4 THEN 'QQ' || (p_partkey % 100) ELSE substr(p_type, 1, 4) || '4' END AS resolved FROM part""")
def x5_x6_resolve_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as quotes of their type, by each step in turn: known ticker, known company, four letters, a name with something behind it, and a stranger."""
    parts = panels.read(spark, sf_dir, "part")
    cat = parts.select("p_type").distinct().select(F.concat(F.substring("p_type", 1, 4), F.lit("4")).alias("ticker"), F.col("p_type").alias("company"), F.lit("PN").alias("kind"))
    k, code = F.col("p_partkey") % 5, F.substring("p_type", 1, 4)
    ticker = F.when(k == 0, F.concat(code, F.lit("4"))).when(k == 2, F.concat(code, F.lit("9"))).otherwise(F.concat(F.lit("QQ"), F.col("p_partkey") % 100))
    company = F.when(k == 1, F.col("p_type")).when(k == 3, F.concat("p_type", F.lit(" XY"))).otherwise("QWXYZ")
    raw = parts.select("p_partkey", ticker.alias("ticker"), company.alias("company"), F.lit("PN").alias("kind"))
    return scalars.resolve_ticker(raw, cat).select("p_partkey", "resolved")


@query("SELECT event_id, TRY_CAST(TRY_CAST(regexp_extract(props, '\\d+') AS DOUBLE) AS BIGINT) AS as_int, TRY_CAST(event_type AS DOUBLE) AS as_float, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS as_bool FROM events")
def x8_safe_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = panels.read(spark, sf_dir, "events")
    word = F.element_at(F.array(F.lit(" Sim"), F.lit("não"), F.lit("?")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select("event_id", scalars.safe_int(F.regexp_extract("props", r"\d+", 0)).alias("as_int"), scalars.safe_float(F.col("event_type")).alias("as_float"), scalars.safe_bool(word).alias("as_bool"))


@query(r"SELECT p_partkey, replace(replace(replace(p_brand || '_50%', '%', '\%'), '#', '\#'), '_', '\_') AS latex FROM part")
def x9_latex_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.read(spark, sf_dir, "part").select("p_partkey", scalars.latex_escape(F.concat("p_brand", F.lit("_50%"))).alias("latex"))


@query("SELECT c_custkey, printf('%02d.%03d.%03d/0001-%02d', c_custkey % 100, c_custkey % 1000, c_custkey % 1000, c_custkey % 100) AS number FROM customer")
def x10_registry_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.format_string("%02d.%03d.%03d/0001-%02d", F.col("c_custkey") % 100, F.col("c_custkey") % 1000, F.col("c_custkey") % 1000, F.col("c_custkey") % 100)
    return panels.read(spark, sf_dir, "customer").select("c_custkey", scalars.company_number(F.concat(F.lit("reg. "), n, F.lit(" ok"))).alias("number"))


@query("""SELECT 'name' AS field, p_partkey FROM part WHERE upper(p_name) LIKE '%RING%' UNION ALL SELECT 'aliases', p_partkey FROM part WHERE upper(p_type) LIKE '%RING%' OR upper(p_name) LIKE '%RING%'
UNION ALL SELECT 'sigla', p_partkey FROM part WHERE p_brand = 'Brand#3'""")
def x11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = panels.read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("sigla"), F.col("p_name").alias("name"), F.array("p_type", "p_name").alias("aliases"))
    found = [scalars.search_dimension(dim, term, field).select(F.lit(field).alias("field"), "p_partkey") for term, field in (("ring", "name"), ("Ring", "aliases"), ("brand#3", "sigla"))]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""SELECT n_nationkey, n_name AS full_name, upper(n_name) AS english, n_nationkey % 3 = 0 AS is_legacy, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 1 END AS aliases_kept,
CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE (SELECT min_by(b.n_name, 'N' || b.n_nationkey) FROM nation b WHERE b.n_regionkey = nation.n_regionkey AND b.n_nationkey % 2 = 0) END AS in_office FROM nation""")
def x12_dimension_getters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in two languages, a type's tickers, aliases without legacy ones, and timelines that siblings of a sigla lend."""
    n = panels.read(spark, sf_dir, "nation")
    line = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.struct(F.col("n_name").alias("name"), F.lit("2000-01-01").cast("date").alias("start"), F.lit(None).cast("date").alias("end")))).otherwise(F.expr("cast(array() as array<struct<name: string, start: date, end: date>>)"))
    kind = F.when(F.col("n_nationkey") % 3 == 0, "legacy").otherwise("principal")
    dim = n.select(F.concat(F.lit("N"), "n_nationkey").alias("ticker"), F.concat(F.lit("r"), "n_regionkey").alias("sigla"), kind.alias("kind"), F.col("n_name").alias("name"), F.upper("n_name").alias("name_en"), F.array("n_name").alias("aliases"), line.alias("timeline"))
    out = dim.select("ticker").join(scalars.full_names(dim), "ticker").join(scalars.full_names(dim, "en").withColumnRenamed("full_name", "english"), "ticker")
    out = out.join(scalars.of_type(dim, "legacy").withColumn("is_legacy", F.lit(True)), "ticker", "left").join(scalars.aliases_of(dim, include_legacy=False), "ticker").join(scalars.timelines(dim), "ticker")
    return out.select(F.substring("ticker", 2, 9).cast("int").alias("n_nationkey"), "full_name", "english", F.coalesce("is_legacy", F.lit(False)).alias("is_legacy"), F.size("aliases").alias("aliases_kept"), F.element_at("timeline", -1)["name"].alias("in_office"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 4 = 0 THEN 'Outros' ELSE n_name END AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def x13_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = panels.read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("ticker"))
    dim = panels.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ticker"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).alias("sector"))
    return scalars.sector_of(s, dim).select("s_suppkey", "sector")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_discount > 0 THEN 1 / (l_discount + 1e-9) WHEN l_tax > 0 THEN l_tax ELSE 1 END, 4) AS strength, CASE WHEN l_discount - l_tax > 0 THEN 'up' WHEN l_discount - l_tax < 0 THEN 'down' ELSE 'flat' END AS direction FROM lineitem")
def x15_x18_strength_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panels.read(spark, sf_dir, "lineitem")
    return rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", scalars.edge_strength(F.col("l_discount"), F.col("l_tax")).alias("strength"), scalars.direction(F.col("l_discount") - F.col("l_tax")).alias("direction")), 4)
