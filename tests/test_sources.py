"""Readers, sinks and reconciliation on small files."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from forelake.operators import quality as Q
from forelake.sources import reports as R
from forelake.sources import tables as T

REPORT = """C,NEMP.WORLD,PREDISPATCH,AEMO,PUBLIC,2024/01/01
I,PREDISPATCH,REGION_PRICES,1,PREDISPATCHSEQNO,RUNNO,REGIONID,INTERVENTION,RRP,LASTCHANGED,DATETIME
D,PREDISPATCH,REGION_PRICES,1,2024010101,1,NSW1,0,55.5,2024/01/01 04:02:00,2024/01/01 04:30:00
D,PREDISPATCH,REGION_PRICES,1,2024010101,1,NSW1,1,99.0,2024/01/01 04:02:00,2024/01/01 04:30:00
D,PREDISPATCH,REGION_PRICES,1,2024010101,x,QLD1,0,12.0,2024/01/01 04:02:00,2024/01/01 05:00:00
D,PREDISPATCH,REGION_PRICES,1,2024010101,1,SA1,0,bad,2024/01/01 04:02:00,2024/01/01 05:00:00
D,PREDISPATCH,REGION_PRICES,1,2024010101,1,VIC1,0,7.0,2024/01/01 06:02:00,2024/01/01 05:00:00
D,PREDISPATCH,OTHER,1,2024010101,1,NSW1,0,1.0,2024/01/01 04:02:00,2024/01/01 04:30:00
C,END OF REPORT,9
"""


def test_record_typed_report(spark, tmp_path):
    (tmp_path / "a.csv").write_text(REPORT)
    raw = R.read_report_csv(spark, str(tmp_path / "a.csv"), "PREDISPATCH", "REGION_PRICES", R.VINTAGE_COLUMNS)
    assert raw.count() == 5 and set(dict(raw.dtypes).values()) == {"string"}
    with pytest.raises(ValueError, match="missing columns"):
        R.read_report_csv(spark, str(tmp_path / "a.csv"), "PREDISPATCH", "REGION_PRICES", ["NOPE"])
    got = {r["region"]: r for r in R.read_vintages(raw).collect()}
    assert set(got) == {"NSW1", "QLD1"}
    assert got["NSW1"]["forecast"] == 55.5 and got["NSW1"]["nominal_issue"] == datetime(2024, 1, 1, 4)
    assert got["QLD1"]["run_no"] == -1.0


def test_report_files_with_their_own_column_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("C,x\nI,T,R,1,REGIONID,RRP,FLAG\nD,T,R,1,NSW1,55,0\n")
    (tmp_path / "b.csv").write_text('I,T,R,1,REGIONID,FLAG,RRP\nD,T,R,1,"a ""b"", c",1,99\nD,T,R,1,QLD1\n')
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    got = R.read_report_csv(spark, paths, "T", "R", ["RRP", "REGIONID", "FLAG"])
    assert sorted(map(tuple, got.collect())) == [("", "QLD1", ""), ("55", "NSW1", "0"), ("99", 'a "b", c', "1")]
    wide = ",".join(f"c{k}" for k in range(400))
    (tmp_path / "w.csv").write_text(f"I,T,R,1,{wide}\nD,T,R,1,{wide}\n")
    assert R.read_report_csv(spark, str(tmp_path / "w.csv"), "T", "R", ["c399"]).first()["c399"] == "c399"
    with pytest.raises(ValueError, match="missing columns .*b.csv"):
        (tmp_path / "b.csv").write_text("I,T,R,1,REGIONID,FLAG\n")
        R.read_report_csv(spark, paths, "T", "R", ["RRP"])
    (tmp_path / "c.csv").write_text("D,T,R,1,NSW1,0\n")
    with pytest.raises(Exception, match="no header record in"):
        R.read_report_csv(spark, [paths[0], str(tmp_path / "c.csv")], "T", "R", ["REGIONID"]).collect()


def test_month_files(spark):
    names = ["PUBLIC_DVD_PREDISPATCHPRICE_202401010000.zip", "PUBLIC_DVD_PREDISPATCHPRICE_D_202401010000.zip", "PUBLIC_DVD_TRADINGPRICE_202401010000.zip"]
    files = spark.createDataFrame([(n,) for n in names], "file_name string")
    got = R.resolve_month_files(files, "predispatchprice", ["202401", "202402"]).collect()
    assert [(r["month"], r["file_name"]) for r in got] == [("202401", names[0])]
    twice = files.union(spark.createDataFrame([("x_PREDISPATCHPRICE_202401010000_b.zip",)], "file_name string"))
    with pytest.raises(Exception, match="several archives"):
        R.resolve_month_files(twice, "PREDISPATCHPRICE", ["202401"]).collect()


def test_actual_regimes(spark):
    pre = spark.createDataFrame(
        [("2021/09/30 23:30:00", "NSW1", "10", "0", "FIRM"), ("2021/10/01 00:00:00", "NSW1", "11", "0", "FIRM"),
         ("2021/09/30 23:30:00", "QLD1", "12", "1", "FIRM"), ("2021/10/01 00:30:00", "NSW1", "13", "0", "FIRM")],
        "SETTLEMENTDATE string, REGIONID string, RRP string, INVALIDFLAG string, PRICE_STATUS string",
    )
    post = spark.createDataFrame([(datetime(2021, 10, 1, 0, 30), "NSW1", 20.0), (datetime(2021, 10, 1), "NSW1", 99.0)], "target timestamp_ntz, region string, actual double")
    got = [(r["actual"], r["source"]) for r in R.read_actuals(pre, post, "2021-10-01").orderBy("target").collect()]
    assert got == [(10.0, "report"), (11.0, "report"), (20.0, "curated")]
    with pytest.raises(Exception, match="duplicate target/region"):
        R.read_actuals(pre.union(pre), post, "2021-10-01").collect()


def test_hourly_prices(spark, tmp_path):
    body = 'Some notice\nCreated 2024-01-05\n\nDate,Hour,HOEP,Hour 1 Predispatch,Hour 2 Predispatch,Hour 3 Predispatch,OR\n2024-01-01,1,10.5,11,,13,0\n2024-01-01,24,"1,234.5",1,2,3,0\n'
    (tmp_path / "p.csv").write_text(body)
    got = R.read_hourly_prices(spark, str(tmp_path / "p.csv")).orderBy("hour").collect()
    assert [r["price"] for r in got] == [10.5, 1234.5] and got[0]["lead2"] is None
    assert got[0]["interval_start_utc"] == datetime(2024, 1, 1, 5) and got[1]["interval_end"] == datetime(2024, 1, 2)
    for bad, text in (("2024-01-01,25,1,1,1,1,0", "hour outside"), ("2024-01-01,2,x,1,1,1,0", "bad number")):
        (tmp_path / "bad.csv").write_text("Date,Hour,HOEP\n" + bad + "\n")
        with pytest.raises(Exception, match=text):
            R.read_hourly_prices(spark, str(tmp_path / "bad.csv")).collect()


def test_xml_prices(spark, tmp_path):
    ns = 'xmlns="http://example.org/schema"'
    (tmp_path / "h.xml").write_text(
        f'<Document {ns}><DocHeader><CreatedAt>2026-09-01T00:00</CreatedAt><DocRevision>1</DocRevision></DocHeader><DocBody>'
        "<HourlyPriceComponents><PricingHour>1</PricingHour><ZonalPrice>30.5</ZonalPrice></HourlyPriceComponents>"
        "<HourlyPriceComponents><PricingHour>2</PricingHour><ZonalPrice></ZonalPrice></HourlyPriceComponents></DocBody></Document>"
    )
    nodes = R.read_xml_prices(spark, str(tmp_path / "h.xml"), "HourlyPriceComponents", R.HOURLY_NODE)
    assert [(r["PricingHour"], r["ZonalPrice"]) for r in nodes.orderBy("PricingHour").collect()] == [(1, 30.5), (2, None)]
    counts = {r["leaf"]: (r["nodes"], r["nonempty"]) for r in R.xml_leaf_counts(nodes).collect()}
    assert counts["ZonalPrice"] == (2, 1) and counts["PricingHour"] == (2, 2)
    head = R.read_xml_prices(spark, str(tmp_path / "h.xml"), "DocHeader", R.HEADER_NODE, parents=()).first()
    assert head["DocRevision"] == "1"


def test_version_names(spark):
    names = ["PUB_Zonal_2026090105_v1.xml", "PUB_Zonal_2026090105_v4.xml", "PUB_Zonal_2026090105.xml", "PUB_Zonal_20260902_v2.xml", "other.xml"]
    files = spark.createDataFrame([(n,) for n in names], "file_name string")
    got = {(r["day"], r["hour"]): r for r in R.version_retention(files).collect()}
    unit = got[("20260901", 5)]
    assert unit["missing_versions"] == 2 and unit["alias_present"] and unit["numbered_versions"] == 2
    assert [tuple(r) for r in R.version_gaps(files).collect()] == [("Zonal", "20260901", 5, 2, 3)]
    assert not got[("20260902", None)]["alias_present"]


def test_sinks_refuse_to_overwrite_and_format_floats(spark, tmp_path):
    values = [0.1, 1 / 3, 1e-5, 123456789012.7, 1e15, -2.0, 0.0, 999999999999.9999, 1234.5]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k int, x double").coalesce(1)
    got = [r[0] for r in df.orderBy("k").select(T.general_format("x")).collect()]
    assert got == ["%.12g" % x for x in values]
    path = str(tmp_path / "out")
    T.write_table(df, path)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        T.write_table(df, path)
    for fmt in ("csv", "json"):
        T.write_table(df, str(tmp_path / fmt), fmt)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == len(values)


def test_curve_scan_pushes_filters_and_columns(spark, tmp_path):
    rows = [("A", "raw", 60, "evaluation", datetime(2024, 1, 1), 1.0, 2.0), ("A", "sparse_equal", 30, "validation", datetime(2024, 2, 1), 3.0, 4.0)]
    spark.createDataFrame(rows, "region string, policy string, cutoff_minutes int, phase string, target timestamp_ntz, p_01 double, p_02 double").write.parquet(str(tmp_path / "c"))
    df = T.load_curves(spark, str(tmp_path / "c"), ["raw"], 60, "evaluation", ("2024-01-01", "2024-01-15"), ["region", "target", "p_01"])
    assert df.count() == 1
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(cutoff_minutes,60)" in plan and "EqualTo(phase,evaluation)" in plan and "p_02" not in plan


def test_overlay_prefers_first_source(spark):
    a = spark.createDataFrame([("A", 1, 10.0)], "region string, k int, price double")
    b = spark.createDataFrame([("A", 1, 99.0), ("A", 2, 20.0)], "region string, k int, price double")
    assert {r["k"]: r["price"] for r in T.overlay_sources([a, b], ["region", "k"]).collect()} == {1: 10.0, 2: 20.0}


def test_manifest_states(spark):
    schema = "path string, bytes long, sha256 string"
    declared = spark.createDataFrame([("a.csv", 1, "x"), ("b.csv", 2, "y"), ("c.csv", 3, "z"), ("../d.csv", 1, "q"), ("E.csv", 1, "e"), ("e.csv", 1, "e")], schema)
    actual = spark.createDataFrame([("a.csv", 1, "x"), ("b.csv", 2, "CHANGED"), ("new.csv", 1, "n"), ("E.csv", 1, "e"), ("e.csv", 1, "e")], schema)
    got = {r["path"]: r["state"] for r in Q.reconcile_manifest(declared, actual).collect()}
    assert got == {"a.csv": "verified", "b.csv": "mismatch", "c.csv": "missing", "../d.csv": "unsafe_name", "new.csv": "unexpected",
                   "E.csv": "case_collision", "e.csv": "case_collision"}
    ok = spark.createDataFrame([("a.csv", 1, "x"), ("c.csv", 3, "z")], schema)
    part = Q.reconcile_manifest(ok, ok.filter("path = 'a.csv'"), spark.createDataFrame([("c.csv",)], "path string"))
    assert Q.manifest_status(part).first()["status"] == "INCOMPLETE_CHECKOUT"


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    same = df.orderBy(F.col("id").desc())
    other = df.withColumn("x", F.when(F.col("id") == 50, -1).otherwise(F.col("x")))
    a, b, c = (Q.fingerprint(d).first() for d in (df, same, other))
    assert a == b and a != c


def test_csv_fields_of_long_and_awkward_lines(spark):
    import csv

    lines = ['a,b', '', ',', '"a,b",c', '"x""y,z",,"",q', '"",""""', 'a"b,c', 'é,"\x01,\x02",\x01\x03', '"a"b,c"d"']
    got = spark.createDataFrame([(x,) for x in lines], "v string").select(R.csv_fields(F.col("v"))).collect()
    plain = [next(csv.reader([x])) if x else [""] for x in lines]
    for line, row, want in zip(lines, got, plain):
        if line not in ('a"b,c', '"a"b,c"d"'):
            assert row[0] == want, line
    # A stray quote shields the commas after it up to the next one; such fields keep their quotes.
    assert got[6][0] == ['a"b,c'] and got[8][0] == ['"a"b,c"d"'.split(",")[0], 'c"d"']

    def seconds(n):
        import time

        df = spark.createDataFrame([(",".join(f'"a{k},""b"' for k in range(n)),)], "v string").coalesce(1)
        started = time.perf_counter()
        fields = df.select(R.csv_fields(F.col("v"))).first()[0]
        assert len(fields) == n and fields[n - 1] == f'a{n - 1},"b'
        return time.perf_counter() - started

    seconds(100)
    assert seconds(100_000) < 40 * max(0.25, seconds(10_000))


def test_hourly_lines_of_files_with_their_own_preambles(spark):
    rows = [("a", 0, "2024-01-01,1,a note"), ("a", 1, "Date,Hour,HOEP,Hour 2 Predispatch"), ("a", 2, "2024-01-01,1,5,7"), ("a", 3, ""), ("b", 0, "Date,Hour,HOEP"), ("b", 1, '"2024-01-02",24,"1,000.5"')]
    lines = spark.createDataFrame(rows, "file string, line int, value string")
    got = {r["file"]: r for r in R.parse_hourly(lines).collect()}
    assert len(got) == 2 and got["a"]["lead2"] == 7.0 and got["a"]["lead1"] is None and got["b"]["price"] == 1000.5
    with pytest.raises(ValueError, match="no price header in c"):
        R.parse_hourly(lines.union(spark.createDataFrame([("c", 0, "x")], lines.schema)))
    with pytest.raises(Exception, match="bad date"):
        R.parse_hourly(lines.union(spark.createDataFrame([("a", 9, "01/02/2024,1,5,7")], lines.schema))).collect()


def test_xml_rules_for_bad_leaves_and_documents(spark):
    body = "<D xmlns='u'><DocBody>{}</DocBody></D>"
    node = "<HourlyPriceComponents><PricingHour>{}</PricingHour><ZonalPrice>{}</ZonalPrice></HourlyPriceComponents>"
    docs = [("a", body.format(node.format(1, "x1") + node.format("one", " 2.5 "))), ("b", body.format("")), ("c", "<D/>")]
    df = spark.createDataFrame(docs, "file_name string, value string")
    got = [(r["file_name"], r["PricingHour"], r["ZonalPrice"]) for r in R.parse_xml_prices(df, "HourlyPriceComponents", R.HOURLY_NODE).collect()]
    assert sorted(got, key=str) == [("a", 1, None), ("a", None, 2.5)]
    broken = spark.createDataFrame([("bad", "<D><DocBody>")], df.schema)
    with pytest.raises(Exception, match="not well-formed: bad"):
        R.parse_xml_prices(df.union(broken), "HourlyPriceComponents", R.HOURLY_NODE).collect()


def test_nan_in_a_source_reads_as_null(spark, tmp_path):
    rows = [("A", datetime(2024, 1, 1), float("nan"), "x"), ("A", datetime(2024, 1, 2), 2.0, "y")]
    spark.createDataFrame(rows, "region string, target timestamp_ntz, p_01 double, note string").write.parquet(str(tmp_path / "c"))
    df = T.load_curves(spark, str(tmp_path / "c"), span=("2024-01-01", "2024-02-01"))
    assert df.agg(F.avg("p_01"), F.max("p_01"), F.count("note")).first() == (2.0, 2.0, 2)
