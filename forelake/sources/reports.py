"""Readers for record-typed CSV, hourly CSV and XML price reports, and file inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from forelake.functions.joins import join_small
from forelake.functions.segments import segment_series
from forelake.operators.clean import coerce_drop, with_nominal_issue
from forelake.session import stage

# Market regions, report columns and time pattern.
REGIONS = ("NSW1", "QLD1", "SA1", "TAS1", "VIC1")
VINTAGE_COLUMNS = ("PREDISPATCHSEQNO", "RUNNO", "REGIONID", "INTERVENTION", "RRP", "LASTCHANGED", "DATETIME")
PRICE_COLUMNS = ("SETTLEMENTDATE", "REGIONID", "RRP", "INVALIDFLAG", "PRICE_STATUS")
STAMP = "yyyy/MM/dd HH:mm:ss"
HOURLY_HEADER = "Date,Hour,HOEP"
REPORT_KINDS = ("kind", "table", "report", "version")


def read_report_csv(spark: SparkSession, path: str | Sequence[str], table: str, report: str, columns: Sequence[str]) -> DataFrame:
    """Data rows of one table and report from text files, all strings; see ``parse_report``."""
    lines = spark.read.text([path] if isinstance(path, str) else list(path))
    return parse_report(lines.select(F.col("_metadata.file_path").alias("file"), "value"), table, report, columns)


def csv_fields(line: Column) -> Column:
    """The fields of a CSV line, however many; quotes around a field go and doubled ones inside become one.

    Linear in the line: the line is split at quotes, and only commas in the parts
    outside them become field ends. The mark for these is told from text by escaping its first character.
    """
    escaped = F.replace(line, F.lit("\x01"), F.lit("\x01\x02"))
    outside = F.transform(F.split(escaped, '"', -1), lambda part, i: F.when(i % 2 == 0, F.replace(part, F.lit(","), F.lit("\x01\x03"))).otherwise(part))
    parts = F.split(F.array_join(outside, '"'), "\x01\x03", -1)
    quoted = lambda x: (F.length(x) >= 2) & F.startswith(x, F.lit('"')) & F.endswith(x, F.lit('"'))
    inside = lambda x: F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    plain = F.transform(parts, lambda x: F.when(quoted(x), inside(x)).otherwise(x))
    return F.transform(plain, lambda x: F.replace(x, F.lit("\x01\x02"), F.lit("\x01")))


def parse_report(lines: DataFrame, table: str, report: str, columns: Sequence[str]) -> DataFrame:
    """Data rows of one table and report from lines (``file``, ``value``), all strings.

    Records start with a kind: C comment, I header, D data. A file's own header
    names its data columns, so files may order them differently; the first four
    fields are the record keys. A file whose header lacks a column, or which holds
    two different headers, fails before any data is read; data without a header in
    its file fail the job. Absent text is an empty string, not null.
    """
    fields = lines.select("file", csv_fields(F.col("value")).alias("_f")).filter(
        F.get("_f", F.lit(0)).isin("I", "D") & (F.get("_f", F.lit(1)) == table) & (F.get("_f", F.lit(2)) == report)
    )
    kind = F.get("_f", F.lit(0))
    own = F.slice("_f", 5, F.greatest(F.size("_f") - 4, F.lit(0)))
    names = F.concat(F.array(*[F.lit(k) for k in REPORT_KINDS]), own).alias("_names")
    # One row per file.
    heads = stage(fields.filter(kind == "I").select("file", names).groupBy("file").agg(F.min("_names").alias("_names"), F.max("_names").alias("_other")))
    if heads.isEmpty():
        raise ValueError(f"no header record for {table}/{report}")
    missing = F.array_except(F.array(*[F.lit(c) for c in columns]), "_names")
    fault = heads.select("file", missing.alias("missing"), (F.col("_names") != F.col("_other")).alias("two")).filter("two or size(missing) > 0").first()
    if fault:
        raise ValueError(f"different headers in {fault['file']}" if fault["two"] else f"missing columns {fault['missing']} in {fault['file']}")
    rows = join_small(fields.filter(kind == "D"), heads.select("file", "_names"), ["file"], "left")
    unnamed = F.raise_error(F.concat(F.lit("no header record in "), F.col("file"))).cast("array<string>")
    found = rows.withColumn("_names", F.coalesce("_names", unnamed))
    return found.select(*[F.coalesce(F.get("_f", F.array_position("_names", c).cast("int") - 1), F.lit("")).alias(c) for c in columns])


def resolve_month_files(files: DataFrame, table: str, months: Sequence[str]) -> DataFrame:
    """Archive file per month (YYYYMM) by name; daily (``_D_``) files are ignored.

    A month with several candidates fails; a month without one is absent.
    """
    name = F.upper(F.col("file_name"))
    month = F.regexp_extract(name, r"(\d{6})010000", 1)
    matching = files.filter(F.contains(name, F.lit(table.upper())) & ~F.contains(name, F.lit("_D_"))).withColumn("month", month)
    counted = matching.filter(F.col("month").isin(*months)).groupBy("month").agg(F.count(F.lit(1)).alias("_n"), F.min("file_name").alias("file_name"))
    one = F.when(F.col("_n") == 1, F.col("file_name")).otherwise(F.raise_error(F.concat(F.lit("several archives for "), F.col("month"))).cast("string"))
    return counted.select("month", one.alias("file_name"))


def read_vintages(raw: DataFrame, regions: Sequence[str] = REGIONS) -> DataFrame:
    """Typed forecast versions: normal runs of the market regions, published before their target."""
    normal = raw.filter(F.col("REGIONID").isin(*regions) & (F.col("INTERVENTION") == "0"))
    typed = coerce_drop(
        normal.select(
            F.col("REGIONID").alias("region"), F.col("DATETIME").alias("target"), F.col("LASTCHANGED").alias("as_of"),
            F.col("PREDISPATCHSEQNO").alias("seq"), F.col("RUNNO").alias("run"),
            F.coalesce(F.col("RUNNO").try_cast("double"), F.lit(-1.0)).alias("run_no"), F.col("RRP").alias("forecast"),
        ),
        {"target": STAMP, "as_of": STAMP}, ["forecast"],
    )
    return with_nominal_issue(typed, "seq").filter(F.col("target") > F.col("as_of"))


def read_actuals(pre: DataFrame, post: DataFrame, switch: str, regions: Sequence[str] = REGIONS) -> DataFrame:
    """Realized prices from the report before ``switch`` and the curated table after it.

    The label is the interval end, so a boundary label belongs to the earlier
    regime. A repeated (target, region) fails the job.
    """
    firm = pre.filter(F.col("REGIONID").isin(*regions) & (F.col("INVALIDFLAG") == "0") & (F.col("PRICE_STATUS") == "FIRM"))
    typed = coerce_drop(
        firm.select(F.col("REGIONID").alias("region"), F.col("SETTLEMENTDATE").alias("target"), F.col("RRP").alias("actual")),
        {"target": STAMP}, ["actual"],
    )
    edge = F.lit(switch).cast("timestamp_ntz")
    early = typed.filter(F.col("target") <= edge).select("target", "region", "actual", F.lit("report").alias("source"))
    late = post.filter(F.col("region").isin(*regions) & F.col("actual").isNotNull() & (F.col("target") > edge)).select(
        "target", "region", "actual", F.lit("curated").alias("source")
    )
    grouped = early.unionByName(late).groupBy("target", "region").agg(
        F.count(F.lit(1)).alias("_n"), F.min("actual").alias("actual"), F.min("source").alias("source")
    )
    unique = F.when(F.col("_n") == 1, F.col("actual")).otherwise(F.raise_error(F.lit("duplicate target/region price")).cast("double"))
    return grouped.select("target", "region", unique.alias("actual"), "source")


def read_hourly_prices(spark: SparkSession, paths: str | Sequence[str], utc_offset_hours: int = -5) -> DataFrame:
    """Hourly price CSV files with a free-text preamble; a file is read whole to number its lines. See ``parse_hourly``."""
    texts = spark.read.text([paths] if isinstance(paths, str) else list(paths), wholetext=True)
    lines = texts.select(F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n", -1).alias("_l")).select("file", F.posexplode("_l").alias("line", "value"))
    return parse_hourly(lines, utc_offset_hours)


def parse_hourly(lines: DataFrame, utc_offset_hours: int = -5) -> DataFrame:
    """Hourly prices from lines (``file``, ``line`` number, ``value``).

    A file's first line that starts with the header names its columns and ends its
    preamble, however long; the lines after it with a first field are data. A file without a
    header, bad dates and numbers and hours outside 1..24 fail the job; blank forecasts stay null.
    """
    from forelake.operators.clean import hour_ending_clock

    is_head = F.startswith("value", F.lit(HOURLY_HEADER))
    # One row per file.
    heads = stage(lines.groupBy("file").agg(F.min(F.when(is_head, F.struct("line", "value"))).alias("_h")))
    bare = heads.filter("_h is null").first()
    if bare:
        raise ValueError(f"no price header in {bare['file']}")
    named = heads.select("file", F.col("_h.line").alias("_start"), F.transform(csv_fields(F.col("_h.value")), F.trim).alias("_names"))
    data = join_small(lines, named, ["file"]).filter(F.col("line") > F.col("_start")).withColumn("_f", csv_fields(F.col("value"))).filter(F.trim(F.get("_f", F.lit(0))) != "")

    def field(name: str) -> Column:
        # A column that the header lacks reads as null.
        at = F.array_position("_names", name)
        return F.trim(F.when(at > 0, F.get("_f", at.cast("int") - 1)))

    def number(name: str, required: bool) -> Column:
        text = field(name)
        blank = text.isNull() | (text == "")
        value = F.replace(text, F.lit(","), F.lit("")).try_cast("double")
        bad = F.raise_error(F.concat(F.lit(f"bad number in {name}: "), F.coalesce(text, F.lit("null")))).cast("double")
        checked = F.when(value.isNotNull(), value).otherwise(bad)
        return checked if required else F.when(~blank, checked)

    hour = field("Hour").try_cast("int")
    hour = F.when(hour.between(1, 24), hour).otherwise(F.raise_error(F.lit("hour outside 1..24")).cast("int"))
    day = field("Date").try_cast("date")
    day = F.when(day.isNotNull(), day).otherwise(F.raise_error(F.concat(F.lit("bad date: "), field("Date"))).cast("date"))
    typed = data.select(
        "file", day.alias("day"), hour.alias("hour"), number("HOEP", True).alias("price"),
        *[number(f"Hour {k} Predispatch", False).alias(f"lead{k}") for k in (1, 2, 3)],
    )
    return hour_ending_clock(typed, utc_offset_hours=utc_offset_hours)


# Fields of the two XML price nodes.
HOURLY_NODE = "PricingHour INT, ZonalPrice DOUBLE, LossPriceCapped DOUBLE, CongestionPriceCapped DOUBLE"
INTERVAL_NODE = "Interval INT, LmpCap DOUBLE, LossPriceCap DOUBLE, CongestionPriceCap DOUBLE, Flag STRING"
HEADER_NODE = "CreatedAt STRING, DocRevision STRING"
XML_BODY = ("DocBody",)


def read_xml_prices(spark: SparkSession, path: str, row_tag: str, schema: str, parents: Sequence[str] = XML_BODY) -> DataFrame:
    """One row per ``row_tag`` node with its source file; every file is one document. See ``parse_xml_prices``."""
    texts = spark.read.text(path, wholetext=True)
    return parse_xml_prices(texts.select(F.col("_metadata.file_name").alias("file_name"), "value"), row_tag, schema, parents)


def parse_xml_prices(docs: DataFrame, row_tag: str, schema: str, parents: Sequence[str] = XML_BODY) -> DataFrame:
    """One row per ``row_tag`` node below ``parents`` of whole documents (``file_name``, ``value``).

    Leaves are read as text and then typed: blank or malformed numbers are null, so
    a bad leaf costs neither its node nor its document. Namespaces are ignored. A document
    that is not well-formed fails the job; one without such nodes gives no rows.
    """
    fields = StructType.fromDDL(schema).fields
    inner = f"{row_tag} ARRAY<STRUCT<{', '.join(f'{f.name}: STRING' for f in fields)}>>"
    for name in reversed(parents):
        inner = f"{name} STRUCT<{inner.replace(' ', ': ', 1)}>"
    options = {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    parsed = docs.select("file_name", F.from_xml("value", f"{inner}, _broken STRING", options).alias("_d"))
    broken = F.raise_error(F.concat(F.lit("not well-formed: "), F.col("file_name"))).cast("boolean")
    whole = parsed.filter(F.when(F.col("_d._broken").isNotNull(), broken).otherwise(F.lit(True)))
    nodes = whole.select("file_name", F.explode(".".join(["_d", *parents, row_tag])).alias("_n"))
    typed = [F.trim(f"_n.{f.name}").try_cast(f.dataType).alias(f.name) for f in fields]
    return nodes.select(*typed, "file_name")


def xml_leaf_counts(nodes: DataFrame) -> DataFrame:
    """Per file and field: nodes and non-empty values."""
    fields = [c for c in nodes.columns if c != "file_name"]
    cells = F.array(*[F.struct(F.lit(c).alias("leaf"), F.col(c).cast("string").alias("v")) for c in fields])
    long = nodes.select("file_name", F.explode(cells).alias("_c")).select("file_name", "_c.*")
    return long.groupBy("file_name", "leaf").agg(
        F.count(F.lit(1)).alias("nodes"), F.count(F.when(F.trim("v") != "", F.lit(1))).alias("nonempty")
    )


def parse_report_names(files: DataFrame) -> DataFrame:
    """Family, day, hour and version of ``PUB_<family>_<yyyymmdd>[hh][_v<n>].xml``; other names are dropped."""
    pattern = r"^PUB_(.+)_(\d{8})(\d{2})?(?:_v(\d+))?\.xml$"
    name = F.col("file_name")

    def part(k: int):
        text = F.regexp_extract(name, pattern, k)
        return F.when(text != "", text)

    return files.filter(name.rlike(pattern)).select(
        "file_name", part(1).alias("family"), part(2).alias("day"), part(3).cast("int").alias("hour"), part(4).cast("int").alias("version"),
    ).withColumn("is_alias", F.col("version").isNull())


UNIT = ("family", "day", "hour")


def version_retention(files: DataFrame) -> DataFrame:
    """Per report unit: numbered versions kept, their ends, how many are missing between, and whether the alias exists."""
    versions = parse_report_names(files).groupBy(*UNIT, "version").agg(F.count(F.lit(1)).alias("n"))
    units = versions.groupBy(*UNIT).agg(
        F.count("version").alias("numbered_versions"), F.min("version").alias("min_version"), F.max("version").alias("max_version"),
        F.max(F.col("version").isNull()).alias("alias_present"),
    )
    missing = F.col("max_version") - F.col("min_version") + 1 - F.col("numbered_versions")
    return units.withColumn("missing_versions", F.coalesce(missing, F.lit(0)))


def version_gaps(files: DataFrame, target_rows: int | None = None) -> DataFrame:
    """Runs of missing numbers between kept versions of a unit: first and last missing number."""
    numbered = parse_report_names(files).filter("version is not null").withColumn("hour", F.coalesce("hour", F.lit(-1)))
    kept = numbered.groupBy(*UNIT, "version").agg(F.count(F.lit(1)).alias("n"))
    seg = segment_series(kept, UNIT, ["version"], before=1, position=F.col("version"), target_rows=target_rows)
    found = seg.finish(seg.frame.withColumn("_prev", F.lag("version").over(seg.window)))
    return found.filter(F.col("version") - F.col("_prev") > 1).select(
        "family", "day", F.when(F.col("hour") >= 0, F.col("hour")).alias("hour"),
        (F.col("_prev") + 1).alias("first_missing"), (F.col("version") - 1).alias("last_missing"),
    )
