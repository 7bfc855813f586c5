"""Queries over typed readers and pruned scans."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from forelake.functions.clock import floor_minutes, shift_minutes
from forelake.plans.registry import query, r, shown
from forelake.plans.views import BUCKET30, EVENT_REGIONS, Views
from forelake.sources.reports import HOURLY_NODE, parse_hourly, parse_report, parse_xml_prices, read_actuals, read_vintages, resolve_month_files
from forelake.sources.tables import load_curves, read_json, write_table
from forelake.streaming.run import shared_folder


def raw_report(v: Views):
    """The events as the all-text rows a report file holds, with malformed and intervention rows."""
    e = F.col("event_id")
    start = shift_minutes(floor_minutes("ts", 30), -240)
    code = F.concat(
        F.date_format(start, "yyyyMMdd"),
        F.lpad((F.floor((F.hour(start) * 60 + F.minute(start)) / 30) + 1).cast("string"), 2, "0"),
    )
    target = shift_minutes(floor_minutes("ts", 240), (F.col("user_id") % 3) * 240)
    return v.table("events").select(
        code.alias("PREDISPATCHSEQNO"),
        F.when(e % 7 == 0, "x").otherwise((e % 7).cast("string")).alias("RUNNO"),
        F.col("event_type").alias("REGIONID"),
        F.when(e % 5 == 0, "1").otherwise("0").alias("INTERVENTION"),
        F.when(e % 11 == 0, "bad").otherwise(F.col("value").cast("string")).alias("RRP"),
        F.date_format("ts", "yyyy/MM/dd HH:mm:ss").alias("LASTCHANGED"),
        F.when(e % 23 == 0, "never").otherwise(F.date_format(target, "yyyy/MM/dd HH:mm:ss")).alias("DATETIME"),
    )


@query("read_vintages", f"""
SELECT region, target, as_of, nominal_issue, run_no, {r('forecast')} FROM (
  SELECT event_type AS region, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2000-01-01') + INTERVAL 4 HOUR * (user_id % 3) AS target, date_trunc('second', ts) AS as_of,
    {BUCKET30} AS nominal_issue, CAST(CASE WHEN event_id % 7 = 0 THEN -1 ELSE event_id % 7 END AS DOUBLE) AS run_no, value AS forecast
  FROM events WHERE event_id % 5 <> 0 AND event_id % 11 <> 0 AND event_id % 23 <> 0) WHERE target > as_of""")
def read_vintages_query(v: Views):
    return shown(read_vintages(raw_report(v), EVENT_REGIONS).drop("seq", "run"))


@query("read_report", """
SELECT event_type || ' "' || event_id || '", ' || user_id AS REGIONID, CAST(event_id * 3 AS VARCHAR) AS RRP, CAST(event_id % 2 AS VARCHAR) AS FLAG FROM events""")
def read_report_query(v: Views):
    """Report lines of several files, every second of which orders its columns otherwise."""
    e = v.table("events").withColumn("file", (F.col("user_id") % 10).cast("string"))
    other = F.col("file").cast("int") % 2 == 1
    name = F.concat(F.lit('"'), "event_type", F.lit(' ""'), F.col("event_id").cast("string"), F.lit('"", '), F.col("user_id").cast("string"), F.lit('"'))
    rrp, flag = (F.col("event_id") * 3).cast("string"), (F.col("event_id") % 2).cast("string")
    keys = F.lit("PREDISPATCH,REGION_PRICES,1")
    rows = e.select("file", F.when(other, F.concat_ws(",", F.lit("D"), keys, name, flag, rrp)).otherwise(F.concat_ws(",", F.lit("D"), keys, rrp, name, flag)).alias("value"))
    heads = e.select("file").distinct().select("file", F.when(other, F.concat_ws(",", F.lit("I"), keys, F.lit("REGIONID,FLAG,RRP"))).otherwise(F.concat_ws(",", F.lit("I"), keys, F.lit("RRP,REGIONID,FLAG"))).alias("value"))
    return parse_report(rows.unionByName(heads), "PREDISPATCH", "REGION_PRICES", ["REGIONID", "RRP", "FLAG"])


@query("read_actuals", f"""
SELECT region, target, {r('actual')}, CASE WHEN target <= TIMESTAMP '2024-01-15' THEN 'report' ELSE 'curated' END AS source FROM actuals
WHERE target > TIMESTAMP '2024-01-15' OR hour(target) <> 8""", "actuals")
def read_actuals_query(v: Views):
    pre = v.actuals.select(
        F.date_format("target", "yyyy/MM/dd HH:mm:ss").alias("SETTLEMENTDATE"), F.col("region").alias("REGIONID"), F.col("actual").cast("string").alias("RRP"),
        F.lit("0").alias("INVALIDFLAG"), F.when(F.hour("target") == 8, "NOT FIRM").otherwise("FIRM").alias("PRICE_STATUS"),
    )
    return shown(read_actuals(pre, v.actuals, "2024-01-15", EVENT_REGIONS))


@query("load_curves", f"""
SELECT event_id, event_type, ts, {r('value')} FROM events WHERE event_type IN ('view', 'click') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'""")
def load_curves_query(v: Views):
    return shown(load_curves(
        v.spark, f"{v.sf_dir}/events.parquet", ["view", "click"], span=("2024-01-10", "2024-01-20"),
        columns=["event_id", "event_type", "ts", "value"], target="ts", policy_column="event_type",
    ))


@query("month_files", """
WITH n AS (SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS month FROM orders)
SELECT month, 'PUBLIC_DVD_PREDISPATCHPRICE_' || month || '010000.zip' AS file_name FROM n WHERE month BETWEEN '199601' AND '199706'""")
def month_files(v: Views):
    """One archive per asked month; daily files, other tables and months that were not asked are passed over."""
    month = F.date_format("o_orderdate", "yyyyMM").alias("month")
    months = v.table("orders").select(month).distinct()
    kinds = F.array(*[F.concat(F.lit(f"PUBLIC_DVD_{kind}_"), "month", F.lit("010000.zip")) for kind in ("PREDISPATCHPRICE", "PREDISPATCHPRICE_D", "TRADINGPRICE")])
    files = months.select(F.explode(kinds).alias("file_name"))
    asked = [f"{y}{m:02d}" for y, last in ((1996, 12), (1997, 6)) for m in range(1, last + 1)]
    return resolve_month_files(files, "PREDISPATCHPRICE", asked)


_HOURS = """SELECT event_type AS file, CAST(ts AS DATE) AS day, hour(ts) + 1 AS hour, avg(value) AS price, avg(value) FILTER (WHERE user_id % 3 = 0) AS lead1,
  avg(value) FILTER (WHERE user_id % 3 = 1) AS lead2, avg(value) FILTER (WHERE user_id % 3 = 2) AS lead3 FROM events GROUP BY ALL"""


def hours(v: Views):
    leads = [F.avg(F.when(F.col("user_id") % 3 == k, F.col("value"))).alias(f"lead{k + 1}") for k in range(3)]
    return v.table("events").groupBy(F.col("event_type").alias("file"), F.to_date("ts").alias("day"), (F.hour("ts") + 1).alias("hour")).agg(F.avg("value").alias("price"), *leads)


@query("hourly_prices", f"""
WITH h AS ({_HOURS})
SELECT file, day, CAST(hour AS INTEGER) AS hour, {r('price')}, {r('lead1')}, {r('lead2')}, {r('lead3')}, CAST(day AS TIMESTAMP) + INTERVAL 1 HOUR * (hour - 1) AS interval_start,
  CAST(day AS TIMESTAMP) + INTERVAL 1 HOUR * hour AS interval_end, CAST(day AS TIMESTAMP) + INTERVAL 1 HOUR * (hour + 4) AS interval_start_utc FROM h""")
def hourly_prices(v: Views):
    """Lines of several files with preambles of two and of five lines; every second file orders its columns otherwise."""
    other = F.length("file") % 2 == 1
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), text("price"), F.lit('"'))
    line = lambda *leads: F.concat_ws(",", text("day"), text("hour"), quoted, *[text(c) for c in leads], F.lit("0"))
    start = F.when(other, 5).otherwise(2)
    number = start + 1 + F.datediff("day", F.lit("2000-01-01")) * 24 + F.col("hour")
    rows = hours(v).select("file", number.alias("line"), F.when(other, line("lead3", "lead1", "lead2")).otherwise(line("lead1", "lead2", "lead3")).alias("value"))
    names = lambda *ks: F.lit(",".join(["Date,Hour,HOEP", *[f"Hour {k} Predispatch" for k in ks], "OR 10 Min"]))
    head = F.when(other, names(3, 1, 2)).otherwise(names(1, 2, 3))
    note = F.transform(F.sequence(F.lit(0), start - 1), lambda i: F.struct(i.alias("line"), F.lit("2024-01-05,12,a note, not a price").alias("value")))
    tops = v.table("events").select(F.col("event_type").alias("file")).distinct()
    tops = tops.select("file", F.explode(F.concat(note, F.array(F.struct(start.alias("line"), head.alias("value")), F.struct((start + 9_000_000).alias("line"), F.lit("").alias("value"))))).alias("c"))
    return shown(parse_hourly(rows.unionByName(tops.select("file", "c.*"))))


@query("xml_prices", f"""
WITH h AS ({_HOURS})
SELECT file || '_' || CAST(day AS VARCHAR) || '.xml' AS file_name, CAST(hour AS INTEGER) AS "PricingHour", {r('CASE WHEN hour % 7 <> 0 AND hour % 11 <> 0 THEN price END', '"ZonalPrice"')},
  {r('lead1', '"LossPriceCapped"')}, CAST(NULL AS DOUBLE) AS "CongestionPriceCapped" FROM h""")
def xml_prices(v: Views):
    """One document per file and day, with blank, malformed and absent leaves."""
    price = F.when(F.col("hour") % 7 == 0, "").when(F.col("hour") % 11 == 0, "n/a").otherwise(F.col("price").cast("string"))
    loss = F.coalesce(F.concat(F.lit("<LossPriceCapped> "), F.col("lead1").cast("string"), F.lit("</LossPriceCapped>")), F.lit(""))
    node = F.concat(F.lit("<HourlyPriceComponents><PricingHour>"), F.col("hour").cast("string"), F.lit("</PricingHour><ZonalPrice>"), price, F.lit("</ZonalPrice>"), loss, F.lit("</HourlyPriceComponents>"))
    nodes = F.array_join(F.array_sort(F.collect_list(node)), "\n")
    docs = hours(v).groupBy("file", "day").agg(F.concat(
        F.lit('<?xml version="1.0"?><Document xmlns="http://example.org/s"><DocHeader><DocRevision>1</DocRevision></DocHeader><DocBody><DeliveryDate>x</DeliveryDate>'),
        nodes, F.lit("</DocBody></Document>"),
    ).alias("value"))
    named = docs.select(F.concat("file", F.lit("_"), F.col("day").cast("string"), F.lit(".xml")).alias("file_name"), "value")
    return shown(parse_xml_prices(named, "HourlyPriceComponents", HOURLY_NODE))


def written_once(v: Views, rows, fmt: str) -> tuple[str, bool]:
    """Write a table to the shared folder, and whether a second write was refused."""
    path = shared_folder(v.spark, fmt)
    write_table(rows, path, fmt)
    try:
        write_table(rows, path, fmt)
    except AnalysisException:
        return path, True
    return path, False


@query("csv_format", """
SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, format('{:.12g}', l_extendedprice / (7 + l_orderkey % 5)) AS price, format('{:.12g}', l_discount * 1e-7) AS small, true AS refused FROM lineitem""")
def csv_format(v: Views):
    """Numbers as the CSV sink writes them, read back as text; a second write is refused."""
    rows = v.table("lineitem").select(
        F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"),
        (F.col("l_extendedprice") / (7 + F.col("l_orderkey") % 5)).alias("price"), (F.col("l_discount") * 1e-7).alias("small"),
    )
    path, refused = written_once(v, rows, "csv")
    back = v.spark.read.schema("l_orderkey long, l_linenumber int, price string, small string").csv(path, header=True)
    return back.withColumn("refused", F.lit(refused))


@query("json_sink", f"""
SELECT event_id, ts, event_type, [user_id, user_id % 7] AS ids, {r('CASE WHEN event_id % 5 <> 0 THEN value END', 'value')}, true AS refused FROM events""")
def json_sink(v: Views):
    """Nested rows with nulls through the JSON sink and back; a second write is refused."""
    e = v.table("events")
    rows = e.select("event_id", "ts", F.struct("event_type", F.array("user_id", F.col("user_id") % 7).alias("ids")).alias("who"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"))
    path, refused = written_once(v, rows, "json")
    back = read_json(v.spark, path, rows.schema)
    return shown(back.select("event_id", "ts", "who.event_type", "who.ids", "value", F.lit(refused).alias("refused")))
