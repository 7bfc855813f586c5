"""Test tables seen as forecast histories, curves, panels and trajectories.

Each view exists twice: as a DataFrame built from the whole table and as SQL
text for the check engine.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forelake.functions.clock import floor_minutes, shift_minutes
from forelake.functions.curves import gather_curves
from forelake.operators.bootstrap import day_count
from forelake.operators.ledger import rebuild_inventory, with_cash
from forelake.session import stage

# The five regions and seven policies of the weekly panel.
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
EVENT_REGIONS = ["click", "error", "purchase", "signup", "view"]
CURRENT = [
    "raw",
    "current_shrink_a025",
    "current_shrink_a050",
    "current_smooth_a025",
    "current_smooth_a050",
]
HISTORY = ["sparse_equal", "inverse_lead"]
POLICIES = CURRENT + HISTORY
FIRST_WEEK = "1995-01-02"
VALIDATION_END = "1998-01-01"


def _policy(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in POLICIES]), index.cast("int"))


def _policy_sql(index: str) -> str:
    return "list_extract([" + ", ".join(f"'{p}'" for p in POLICIES) + f"], CAST({index} AS INTEGER))"


def interior_weeks(full: DataFrame) -> DataFrame:
    """Weeks between the first and the last of the table, numbered from zero."""
    ends = full.agg(F.struct(F.min("day_idx").alias("first"), F.max("day_idx").alias("last"))).scalar()
    day = F.col("day_idx")
    return full.filter((day > ends["first"]) & (day < ends["last"])).withColumn("day_idx", day - ends["first"] - 1)


class Views:
    """Lazily built views over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def vintages(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_type").alias("region"),
            shift_minutes(floor_minutes("ts", 240), (F.col("user_id") % 12 + 1) * 240).alias("target"),
            F.col("ts").alias("as_of"),
            floor_minutes("ts", 30).alias("nominal_issue"),
            F.col("event_id").alias("seq"),
            (F.col("event_id") % 7).cast("int").alias("run_no"),
            F.col("value").alias("forecast"),
        )

    @cached_property
    def vintages_raw(self) -> DataFrame:
        """Vintages with every tenth version restated by a later run of the same issue."""
        v = self.vintages
        restated = v.filter(F.col("seq") % 10 == 0).withColumns({
            "run_no": F.col("run_no") + 7, "forecast": F.col("forecast") + 1.0,
        })
        return v.unionByName(restated)

    @cached_property
    def actuals(self) -> DataFrame:
        return self.table("events").groupBy(
            F.col("event_type").alias("region"), shift_minutes(floor_minutes("ts", 240), 240).alias("target")
        ).agg(F.avg("value").alias("actual"))

    @cached_property
    def origins(self) -> DataFrame:
        return self.actuals.select("region", "target")

    @cached_property
    def issues(self) -> DataFrame:
        """Four-hourly issues, each publishing 13 targets under one stamp; some cells are left out, some have no sparse forecast."""
        bucket = floor_minutes("ts", 240)
        grouped = self.table("events").groupBy(F.col("event_type").alias("region"), bucket.alias("bucket")).agg(
            F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")
        )
        cells = grouped.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(12)))).filter((F.col("n") * 13 + F.col("k")) % 61 != 0)
        forecast = F.col("mean") * (1 + F.col("k") / 100)
        return cells.select(
            "region",
            shift_minutes("bucket", (F.col("k") + 1) * 240).alias("target"),
            shift_minutes("bucket", 60).alias("as_of"),
            shift_minutes("bucket", 30).alias("nominal_issue"),
            F.date_format("bucket", "yyyyMMddHH").alias("seq"),
            F.lit(1).alias("run_no"),
            forecast.alias("forecast"),
            F.when((F.col("n") * 7 + F.col("k")) % 67 != 0, forecast - 1).alias("sparse_equal"),
        )

    @cached_property
    def grid(self) -> DataFrame:
        """Two-hourly realized price with two forecasts of it."""
        return self.table("events").groupBy(
            F.col("event_type").alias("region"), shift_minutes(floor_minutes("ts", 120), 120).alias("target")
        ).agg(
            F.avg("value").alias("actual"),
            F.coalesce(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))), F.avg("value")).alias("raw"),
            F.coalesce(F.avg(F.when(F.col("user_id") % 2 == 0, F.col("value"))), F.avg("value")).alias("sparse_equal"),
        )

    @cached_property
    def curves_wide(self) -> DataFrame:
        """Complete 12-step curves per origin: realized, raw, sparse and their mean."""
        cells = self.grid.withColumn("inverse_lead", (F.col("raw") + F.col("sparse_equal")) / 2)
        return gather_curves(cells, ["actual", "raw", "sparse_equal", "inverse_lead"], steps=12, step_min=120)

    @cached_property
    def curves(self) -> DataFrame:
        """Long over policies: region, target, policy, curve, actual."""
        options = F.array(*[
            F.struct(F.lit(p).alias("policy"), F.col(p).alias("curve")) for p in ("raw", "sparse_equal", "inverse_lead")
        ])
        return self.curves_wide.select("region", "target", "actual", F.explode(options).alias("_p")).select(
            "region", "target", "_p.policy", "_p.curve", "actual"
        )

    @cached_property
    def curve_cells(self) -> DataFrame:
        """Long over policies and steps: region, origin, step, policy, price, actual."""
        return self.curves.select(
            "region", F.col("target").alias("origin"), "policy",
            F.posexplode(F.arrays_zip("curve", "actual")).alias("step", "_c"),
        ).select("region", "origin", "policy", "step", F.col("_c.curve").alias("price"), F.col("_c.actual").alias("actual"))

    @cached_property
    def lines(self) -> DataFrame:
        """Line items with their supplier region, week index and policy."""
        nation = self.table("nation").join(F.broadcast(self.table("region")), F.expr("n_regionkey = r_regionkey"))
        supplier = self.table("supplier").join(F.broadcast(nation), F.expr("s_nationkey = n_nationkey")).select("s_suppkey", "r_name")
        week = F.floor(F.datediff("l_shipdate", F.lit(FIRST_WEEK).cast("date")) / 7)
        return self.table("lineitem").join(supplier, F.expr("l_suppkey = s_suppkey")).select(
            F.col("r_name").alias("region"), week.alias("day_idx"), _policy(F.col("l_linenumber")).alias("policy"),
            "l_extendedprice", "l_discount", "l_tax",
        )

    @cached_property
    def _line_cells(self) -> DataFrame:
        return self.lines.groupBy("day_idx", "region", "policy").agg(
            F.sum(F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("x"),
            F.sum("l_extendedprice").alias("price_sum"),
            F.sum("l_discount").alias("discount_sum"),
            F.count(F.lit(1)).alias("n"),
        )

    @cached_property
    def _weeks(self) -> DataFrame:
        """One row per week, region and policy; absent cells are null.

        A week holds at most one partial row per region and policy, so the
        missing ones are filled inside the week instead of by joins.
        """
        cell = F.struct("x", "price_sum", "discount_sum", "n")
        weeks = self._line_cells.groupBy("day_idx").agg(
            F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "region", "policy").alias("k"), cell.alias("v")))).alias("_m"),
            *[F.sum(F.when(F.col("region") == region, F.col("price_sum"))).alias(f"_p{k}") for k, region in enumerate(REGIONS)],
            *[F.sum(F.when(F.col("region") == region, F.col("n"))).alias(f"_n{k}") for k, region in enumerate(REGIONS)],
        )
        regions = F.array(*[
            F.struct(F.lit(region).alias("region"), (F.col(f"_p{k}") / F.col(f"_n{k}") / 1000).alias("actual_price")) for k, region in enumerate(REGIONS)
        ])
        rows = weeks.select("day_idx", "_m", F.explode(regions).alias("_r")).withColumn(
            "policy", F.explode(F.array(*[F.lit(p) for p in POLICIES]))
        )
        found = F.try_element_at("_m", F.concat_ws("|", F.col("_r.region"), F.col("policy")))
        return rows.select("day_idx", "_r.region", "policy", "_r.actual_price", found.alias("_c")).select(
            "day_idx", "region", "policy", "actual_price", "_c.x", "_c.discount_sum", "_c.n"
        )

    @cached_property
    def panel_full(self) -> DataFrame:
        """Weekly net by region and policy; absent cells are zero."""
        return self._weeks.select("day_idx", "region", "policy", F.coalesce("x", F.lit(0.0)).alias("x"))

    @cached_property
    def panel(self) -> DataFrame:
        """All weeks but the first and the last, re-indexed from zero."""
        return interior_weeks(self.panel_full)

    @cached_property
    def staged_panel_full(self) -> DataFrame:
        """The weekly panel written once: statistics read it several times, the line items are read once."""
        return stage(self.panel_full)

    @cached_property
    def staged_panel(self) -> DataFrame:
        return interior_weeks(self.staged_panel_full)

    @cached_property
    def weeks(self) -> int:
        """Number of weeks of the panel."""
        return day_count(self.staged_panel)

    @cached_property
    def _week_ends(self) -> tuple[int, int]:
        """First and last week of the panel, both partly covered."""
        return tuple(self.staged_panel_full.agg(F.min("day_idx"), F.max("day_idx")).first())

    @cached_property
    def nominal_weeks(self) -> int:
        """Number of weeks with the first and the last."""
        first, last = self._week_ends
        return last - first + 1

    @cached_property
    def train_weeks(self) -> int:
        """Number of the panel's weeks that end by ``VALIDATION_END``; the later ones evaluate."""
        ended = (date.fromisoformat(VALIDATION_END) - date.fromisoformat(FIRST_WEEK)).days // 7
        return max(0, min(ended - self._week_ends[0] - 1, self.weeks))

    @cached_property
    def staged_trajectory(self) -> DataFrame:
        """The trajectory written once, for reports that read it several times."""
        return stage(self.trajectory)

    @cached_property
    def trajectory(self) -> DataFrame:
        """Weekly charge/discharge path per region and policy with stock and cash."""
        mw = F.coalesce(F.least(F.lit(1.0), 10 * F.col("discount_sum") / F.col("n")), F.lit(0.0))
        even = F.col("day_idx") % 2 == 0
        flows = self._weeks.select(
            "region", "policy", "day_idx",
            shift_minutes(F.lit(FIRST_WEEK).cast("timestamp_ntz"), (F.col("day_idx") + 1) * (7 * 1440)).alias("target"),
            F.coalesce("actual_price", F.lit(0.0)).alias("actual_price"),
            F.when(even, mw).otherwise(0.0).alias("charge"),
            F.when(even, 0.0).otherwise(mw).alias("discharge"),
        ).withColumn("phase", F.when(F.col("target") < F.lit(VALIDATION_END).cast("timestamp_ntz"), "validation").otherwise("evaluation"))
        # 357 weeks per series: the calendar bounds every (region, policy) group.
        return rebuild_inventory(with_cash(flows), hot=False)

    @cached_property
    def dispatch(self) -> DataFrame:
        """Signed half-hourly cash by region and policy, straight from the events."""
        return self.table("events").select(
            F.col("event_type").alias("region"),
            _policy(F.col("user_id") % 7 + 1).alias("policy"),
            shift_minutes(floor_minutes("ts", 30), 30).alias("target"),
            (F.col("value") * (1 - 2 * (F.col("event_id") % 2))).alias("net"),
        )

    @cached_property
    def branches(self) -> DataFrame:
        return self.branch_windows(self.trajectory)

    @staticmethod
    def branch_windows(path: DataFrame) -> DataFrame:
        """48-week windows (the last one as long as the data) of three policies read as probe branches with a common start."""
        names = F.when(F.col("policy") == "raw", "raw_rolling").when(
            F.col("policy") == "sparse_equal", "history_rolling"
        ).when(F.col("policy") == "inverse_lead", "one_history_then_raw")
        windows = (
            path.withColumn("branch", names)
            .filter("branch is not null")
            .select(
                "region", F.floor(F.col("day_idx") / 48).alias("event_id"), "branch",
                (F.col("day_idx") % 48).alias("step"), "target", "actual_price", "charge", "discharge", "net",
            )
        )
        return rebuild_inventory(windows, keys=("region", "event_id", "branch"), hot=False)

    @cached_property
    def states(self) -> DataFrame:
        """Common-state actions and action ranges derived from the curves."""
        r, s = F.col("raw"), F.col("sparse_equal")

        def action(curve: Column, stock: float) -> Column:
            mean = F.aggregate(curve, F.lit(0.0), lambda a, x: a + x) / 12
            return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (curve[0] - mean) / 50 + stock))

        def half_width(curve: Column) -> Column:
            return F.abs(curve[1] - curve[0]) / 400

        out = self.curves_wide.select(
            "region", "target",
            action(r, 0.0).alias("u_raw_at_raw"), action(s, 0.0).alias("u_history_at_raw"),
            action(r, 0.1).alias("u_raw_at_history"), action(s, 0.1).alias("u_history_at_history"),
            half_width(r).alias("_hr"), half_width(s).alias("_hs"),
        )
        return out.select(
            "region", "target", "u_raw_at_raw", "u_history_at_raw", "u_raw_at_history", "u_history_at_history",
            (F.col("u_raw_at_raw") - F.col("_hr")).alias("raw_lower"), (F.col("u_raw_at_raw") + F.col("_hr")).alias("raw_upper"),
            (F.col("u_history_at_raw") - F.col("_hs")).alias("history_lower"),
            (F.col("u_history_at_raw") + F.col("_hs")).alias("history_upper"),
        )

    @cached_property
    def manifest(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Declared files (some with unsafe or colliding names), present files and the paths a checkout may leave out."""
        documents = self.table("documents")
        number = F.col("doc_id")
        name = (
            F.when(number % 97 == 5, F.concat(F.lit("../"), number))
            .when(number % 40 == 11, F.concat(F.lit("x"), F.floor(number / 40)))
            .when(number % 40 == 12, F.concat(F.lit("X"), F.floor(number / 40)))
            .otherwise(number.cast("string"))
        )
        path = F.concat(F.lit("docs/"), name)
        declared = documents.select(path.alias("path"), F.col("n_chars").alias("bytes"), F.sha2("text", 256).alias("sha256"), "doc_id")
        changed = F.when(F.col("doc_id") % 7 == 0, F.sha2(F.concat("sha256", F.lit("x")), 256)).otherwise(F.col("sha256"))
        copies = F.filter(
            F.array(
                F.struct((F.col("doc_id") % 10 != 0).alias("there"), F.col("path").alias("p"), changed.alias("s")),
                F.struct((F.col("doc_id") % 50 == 3).alias("there"), F.concat("path", F.lit("/extra")).alias("p"), F.col("sha256").alias("s")),
            ),
            lambda c: c["there"],
        )
        actual = declared.select("bytes", F.explode(copies).alias("c")).select(F.col("c.p").alias("path"), "bytes", F.col("c.s").alias("sha256"))
        omitted = declared.filter(F.col("doc_id") % 20 == 0).select("path")
        return declared.drop("doc_id"), actual, omitted


_ETA, _KAPPA, _DT = 0.91, 5.0, 0.5
_BUCKET4 = "time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2000-01-01')"
_BUCKET2 = "time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '2000-01-01')"
BUCKET30 = "time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '2000-01-01')"


def _values(items: list[str], name: str) -> str:
    return "(VALUES " + ", ".join(f"('{i}')" for i in items) + f") {name}({name})"


def _stock_sql(keys: str) -> str:
    return f"""
    SELECT *, CAST(1.0 AS DOUBLE) + coalesce(sum(flow) OVER (PARTITION BY {keys} ORDER BY target ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS soc_start,
      CAST(1.0 AS DOUBLE) + sum(flow) OVER (PARTITION BY {keys} ORDER BY target ROWS UNBOUNDED PRECEDING) AS soc_end
    """


VIEW_SQL: dict[str, tuple[str, str]] = {
    # name: (views needed, text)
    "vintages": ("", f"""
    SELECT event_type AS region, {_BUCKET4} + INTERVAL 4 HOUR * (user_id % 12 + 1) AS target, ts AS as_of,
      {BUCKET30} AS nominal_issue, event_id AS seq, CAST(event_id % 7 AS INTEGER) AS run_no, value AS forecast
    FROM events"""),
    "vintages_raw": ("vintages", """
    SELECT * FROM vintages UNION ALL
    SELECT region, target, as_of, nominal_issue, seq, run_no + 7, forecast + 1.0 FROM vintages WHERE seq % 10 = 0"""),
    "actuals": ("", f"""
    SELECT event_type AS region, {_BUCKET4} + INTERVAL 4 HOUR AS target, avg(value) AS actual FROM events GROUP BY 1, 2"""),
    "origins": ("actuals", "SELECT region, target FROM actuals"),
    "issues": ("", f"""
    SELECT region, bucket + INTERVAL 4 HOUR * (k + 1) AS target, bucket + INTERVAL 60 MINUTE AS as_of, bucket + INTERVAL 30 MINUTE AS nominal_issue,
      strftime(bucket, '%Y%m%d%H') AS seq, 1 AS run_no, mean * (1 + k / 100) AS forecast, CASE WHEN (n * 7 + k) % 67 <> 0 THEN mean * (1 + k / 100) - 1 END AS sparse_equal
    FROM (SELECT event_type AS region, {_BUCKET4} AS bucket, avg(value) AS mean, count(*) AS n FROM events GROUP BY 1, 2), range(13) t(k) WHERE (n * 13 + k) % 61 <> 0"""),
    "grid": ("", f"""
    SELECT event_type AS region, {_BUCKET2} + INTERVAL 2 HOUR AS target, avg(value) AS actual,
      coalesce(avg(value) FILTER (WHERE event_id % 2 = 0), avg(value)) AS raw,
      coalesce(avg(value) FILTER (WHERE user_id % 2 = 0), avg(value)) AS sparse_equal
    FROM events GROUP BY 1, 2"""),
    "wide_cells": ("grid", """
    SELECT region, target - INTERVAL 2 HOUR * s AS origin, s AS step, actual, raw, sparse_equal, (raw + sparse_equal) / 2 AS inverse_lead
    FROM grid, range(12) t(s)"""),
    "complete": ("wide_cells", """
    SELECT w.* FROM wide_cells w JOIN (SELECT region, origin FROM wide_cells GROUP BY 1, 2 HAVING count(*) = 12) USING (region, origin)"""),
    "curve_cells": ("complete", """
    SELECT region, origin, policy, step, price, actual FROM (
      SELECT region, origin, step, actual, 'raw' AS policy, raw AS price FROM complete UNION ALL
      SELECT region, origin, step, actual, 'sparse_equal', sparse_equal FROM complete UNION ALL
      SELECT region, origin, step, actual, 'inverse_lead', inverse_lead FROM complete)"""),
    "curves_wide": ("complete", """
    SELECT region, origin AS target, list(actual ORDER BY step) AS actual, list(raw ORDER BY step) AS raw,
      list(sparse_equal ORDER BY step) AS sparse_equal, list(inverse_lead ORDER BY step) AS inverse_lead
    FROM complete GROUP BY 1, 2"""),
    "lines": ("", f"""
    SELECT r_name AS region, date_diff('day', DATE '{FIRST_WEEK}', CAST(l_shipdate AS DATE)) // 7 AS day_idx,
      {_policy_sql('l_linenumber')} AS policy, l_extendedprice, l_discount, l_tax
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "line_cells": ("lines", """
    SELECT day_idx, region, policy, sum(l_extendedprice * (l_discount - l_tax)) AS x, sum(l_extendedprice) AS price_sum,
      sum(l_discount) AS discount_sum, count(*) AS n FROM lines GROUP BY 1, 2, 3"""),
    "skeleton": ("line_cells", f"""
    SELECT day_idx, region, policy FROM (SELECT DISTINCT day_idx FROM line_cells), {_values(REGIONS, 'region')}, {_values(POLICIES, 'policy')}"""),
    "panel_full": ("skeleton", """
    SELECT s.day_idx, s.region, s.policy, coalesce(x, 0) AS x FROM skeleton s LEFT JOIN line_cells USING (day_idx, region, policy)"""),
    "panel": ("panel_full", """
    SELECT day_idx - first - 1 AS day_idx, region, policy, x FROM panel_full, (SELECT min(day_idx) AS first, max(day_idx) AS last FROM panel_full)
    WHERE day_idx > first AND day_idx < last"""),
    "flows": ("skeleton", f"""
    SELECT *, CASE WHEN day_idx % 2 = 0 THEN mw ELSE 0 END AS charge, CASE WHEN day_idx % 2 = 0 THEN 0 ELSE mw END AS discharge FROM (
      SELECT s.region, s.policy, s.day_idx, TIMESTAMP '{FIRST_WEEK}' + INTERVAL 7 DAY * CAST(s.day_idx + 1 AS INTEGER) AS target,
        coalesce(p.actual_price, 0) AS actual_price, coalesce(least(1.0, 10 * discount_sum / n), 0) AS mw
      FROM skeleton s LEFT JOIN line_cells c USING (day_idx, region, policy)
      LEFT JOIN (SELECT day_idx, region, sum(price_sum) / sum(n) / 1000 AS actual_price FROM line_cells GROUP BY 1, 2) p USING (day_idx, region))"""),
    "trajectory": ("flows", f"""
    {_stock_sql('region, policy')} FROM (SELECT *, cashflow - wear AS net, {_ETA} * charge * {_DT} - discharge * {_DT} / {_ETA} AS flow,
      CASE WHEN target < TIMESTAMP '{VALIDATION_END}' THEN 'validation' ELSE 'evaluation' END AS phase FROM (
        SELECT *, actual_price * (discharge - charge) * {_DT} AS cashflow, {_KAPPA} * (charge + discharge) * {_DT} AS wear FROM flows))"""),
    "dispatch": ("", f"""
    SELECT event_type AS region, {_policy_sql('user_id % 7 + 1')} AS policy, {BUCKET30} + INTERVAL 30 MINUTE AS target,
      value * (1 - 2 * (event_id % 2)) AS net FROM events"""),
    "branches": ("trajectory", f"""
    {_stock_sql('region, event_id, branch')} FROM (
      SELECT region, day_idx // 48 AS event_id, CASE policy WHEN 'raw' THEN 'raw_rolling' WHEN 'sparse_equal' THEN 'history_rolling' ELSE 'one_history_then_raw' END AS branch,
        day_idx % 48 AS step, target, actual_price, charge, discharge, net, flow
      FROM trajectory WHERE policy IN ('raw', 'sparse_equal', 'inverse_lead'))"""),
    "states": ("curves_wide", """
    SELECT region, target, ur AS u_raw_at_raw, us AS u_history_at_raw, ur2 AS u_raw_at_history, us2 AS u_history_at_history,
      ur - hr AS raw_lower, ur + hr AS raw_upper, us - hs AS history_lower, us + hs AS history_upper FROM (
      SELECT region, target, greatest(-1, least(1, (raw[1] - list_sum(raw) / 12) / 50)) AS ur,
        greatest(-1, least(1, (sparse_equal[1] - list_sum(sparse_equal) / 12) / 50)) AS us,
        greatest(-1, least(1, (raw[1] - list_sum(raw) / 12) / 50 + 0.1)) AS ur2,
        greatest(-1, least(1, (sparse_equal[1] - list_sum(sparse_equal) / 12) / 50 + 0.1)) AS us2,
        abs(raw[2] - raw[1]) / 400 AS hr, abs(sparse_equal[2] - sparse_equal[1]) / 400 AS hs FROM curves_wide)"""),
    "declared": ("", """
    SELECT 'docs/' || CASE WHEN doc_id % 97 = 5 THEN '../' || doc_id WHEN doc_id % 40 = 11 THEN 'x' || (doc_id // 40) WHEN doc_id % 40 = 12 THEN 'X' || (doc_id // 40)
      ELSE CAST(doc_id AS VARCHAR) END AS path, n_chars AS bytes, sha256(text) AS sha256, doc_id FROM documents"""),
    "present": ("declared", """
    SELECT path, bytes, CASE WHEN doc_id % 7 = 0 THEN sha256(sha256 || 'x') ELSE sha256 END AS sha256 FROM declared WHERE doc_id % 10 <> 0
    UNION ALL SELECT path || '/extra', bytes, sha256 FROM declared WHERE doc_id % 50 = 3"""),
}


def with_views(names: list[str], body: str) -> str:
    """``WITH`` clause holding the named views and what they need, then ``body``."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        needs, _ = VIEW_SQL[name]
        for other in needs.split():
            visit(other)
        ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS ({VIEW_SQL[n][1].strip()})" for n in ordered]
    body = body.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
