"""Online forms of the history summaries as Structured Streaming jobs.

Event time must be ``TIMESTAMP``; watermarks reject ``TIMESTAMP_NTZ``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SERIES = ("region", "target")


def usable(v: DataFrame, cutoff_min: int = 60, delay_min: int = 0) -> DataFrame:
    """Flag versions that arrive (with ``delay_min``) no later than ``target - cutoff``."""
    arrival = F.col("as_of") + F.expr(f"INTERVAL {int(delay_min)} MINUTES")
    return v.withColumn("usable", arrival <= F.col("target") - F.expr(f"INTERVAL {int(cutoff_min)} MINUTES"))


def online_moments(v: DataFrame, watermark: str = "12 hours", cutoff_min: int = 60, delay_min: int = 0) -> DataFrame:
    """Running inverse-lead mean per delivery target: two moments of state per target.

    A replayed version is dropped by its key before it is added. The watermark runs
    on ``target``: once a target lies more than ``watermark`` behind the latest one
    seen, its state is released and further versions of it are ignored. Choose it
    longer than the span of targets that one issue covers. Versions after the
    cutoff are counted, not used.
    """
    lead = (F.unix_micros("target") - F.unix_micros("nominal_issue")) / F.lit(60_000_000.0)
    weight = F.when(F.col("usable"), F.try_divide(F.lit(1.0), lead))
    once = usable(v, cutoff_min, delay_min).withWatermark("target", watermark).dropDuplicatesWithinWatermark(["region", "target", "as_of"])
    return once.groupBy("region", "target").agg(
        F.sum(weight).alias("weight"),
        F.sum(weight * F.col("forecast")).alias("weighted"),
        F.count(F.when(F.col("usable"), F.lit(1))).alias("n_versions"),
        F.count(F.when(~F.col("usable"), F.lit(1))).alias("late_versions"),
    ).withColumn("inverse_lead", F.try_divide(F.col("weighted"), F.col("weight")))


MOMENT_ROWS = "region string, target timestamp, weight double, weighted double, n_versions long, late_versions long, inverse_lead double"
MOMENT_STATE = "weight double, weighted double, n long, late long"


def expiring_moments(v: DataFrame, watermark: str = "10 minutes", cutoff_min: int = 60, delay_min: int = 0) -> DataFrame:
    """The same moments with per-target state that ends when the target passes.

    One row per target is emitted on expiry. Needs a state store with timers
    (``RocksDBStateStoreProvider``). Replays inside the watermark are dropped
    upstream, older ones are late rows; the state of a target stays four numbers.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Moments(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("moments", MOMENT_STATE)

        def handleInputRows(self, key, rows, timerValues):
            known = self.state.exists()
            weight, weighted, n, late = self.state.get() if known else (0.0, 0.0, 0, 0)
            for batch in rows:
                used = batch[batch["usable"]]
                weight += float(used["w"].sum())
                weighted += float((used["w"] * used["forecast"]).sum())
                n += len(used)
                late += len(batch) - len(used)
            if not known:
                self.handle.registerTimer(int(pd.Timestamp(key[1]).value // 1_000_000))
            self.state.update((weight, weighted, n, late))
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            weight, weighted, n, late = self.state.get()
            self.state.clear()
            yield pd.DataFrame({
                "region": [key[0]], "target": [pd.Timestamp(key[1])], "weight": [weight], "weighted": [weighted], "n_versions": [n],
                "late_versions": [late], "inverse_lead": [weighted / weight if weight else None],
            })

        def close(self) -> None:
            pass

    lead = (F.unix_micros("target") - F.unix_micros("nominal_issue")) / F.lit(60_000_000.0)
    once = (
        usable(v, cutoff_min, delay_min).withColumn("w", F.try_divide(F.lit(1.0), lead))
        .withWatermark("as_of", watermark).dropDuplicatesWithinWatermark(["region", "target", "as_of"])
    )
    return once.groupBy("region", "target").transformWithStateInPandas(
        statefulProcessor=Moments(), outputStructType=MOMENT_ROWS, outputMode="Append", timeMode="EventTime"
    )


def window_price(prices: DataFrame, minutes: int = 30, values: int = 6, keys: Sequence[str] = ("region",), watermark: str | None = None) -> DataFrame:
    """Interval price from finer prices, labelled by interval end, only with the exact number of values."""
    source = prices.withWatermark("ts", watermark) if watermark else prices
    return source.groupBy(*keys, F.window("ts", f"{minutes} minutes").alias("_w")).agg(
        F.avg("price").alias("price"), F.count("price").alias("n")
    ).filter(F.col("n") == values).select(*keys, F.col("_w.end").alias("target"), "price", "n")


def session_events(triggers: DataFrame, gap: str = "4 hours", keys: Sequence[str] = ("region",), watermark: str | None = None) -> DataFrame:
    """Trigger sessions; a trigger exactly one gap later still joins."""
    source = triggers.withWatermark("ts", watermark) if watermark else triggers
    return source.groupBy(*keys, F.session_window("ts", gap).alias("_s")).agg(
        F.min("ts").alias("first_target"), F.max("ts").alias("last_target"), F.count(F.lit(1)).alias("triggers")
    ).select(*keys, "first_target", "last_target", F.col("_s.end").alias("event_end"), "triggers")


REVISION_ROWS = "region string, target timestamp, as_of timestamp, seq long, abs_revision double, revision_sd double"
#: Versions of a target whose windows are laid out together.
REVISIONS_AT_ONCE = 65_536


def rolling_revisions(v: DataFrame, width: int = 6, watermark: str = "10 minutes") -> DataFrame:
    """``vintages.rolling_revision`` as a stream: each version with the last ``width`` revisions of its target.

    Versions (region, target, as_of, seq, forecast) wait until the watermark passes their stamp, so that
    none can come before them any more; then they leave in order, and the target
    keeps its last revisions and its last price. Versions wait in blocks of many rows, one
    state call each. A replay inside the watermark is dropped by
    its key, an older one is a late row. The state of a target ends when the target
    passes. Needs a state store with timers (``RocksDBStateStoreProvider``).
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    version = np.dtype([("us", np.int64), ("seq", np.int64), ("forecast", np.float64)])

    def rolled(revisions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the absolute values, and sample deviation, of every window of revisions; NaN stands for none."""
        window = np.lib.stride_tricks.sliding_window_view(revisions, width)
        there = ~np.isnan(window)
        n, value = there.sum(axis=1), np.where(there, window, 0.0)
        mean = value.sum(axis=1) / np.maximum(n, 1)
        square = np.where(there, window - mean[:, None], 0.0) ** 2
        total = np.where(n > 0, np.abs(value).sum(axis=1), np.nan)
        return total, np.where(n > 1, np.sqrt(square.sum(axis=1) / np.maximum(n - 1, 1)), np.nan)

    class Revisions(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "versions binary")
            self.first = handle.getValueState("first", "us long")
            self.last = handle.getValueState("last", "revisions binary, forecast double")

        def handleInputRows(self, key, rows, timerValues):
            first = self.first.get()[0] if self.first.exists() else None
            for batch in rows:
                block = np.empty(len(batch), version)
                for name in version.names:
                    block[name] = batch[name]
                if len(block):
                    self.waiting.appendValue((block.tobytes(),))
                    first = int(block["us"].min() if first is None else min(first, block["us"].min()))
            self._wait(key, timerValues, first)
            return iter([])

        def _wait(self, key, timerValues, first: int | None) -> None:
            """A timer at the first version that waits, or at the target if none does."""
            now = timerValues.getCurrentWatermarkInMs()
            end = pd.Timestamp(key[1]).value // 1_000_000
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            if first is None:
                self.first.clear()
                if now >= end:
                    self.last.clear()
                    return
            else:
                self.first.update((first,))
            self.handle.registerTimer(int(max(now + 1, end if first is None else -(-first // 1000))))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            limit = timerValues.getCurrentWatermarkInMs() * 1000
            blocks = [np.frombuffer(w[0], version) for w in self.waiting.get()] if self.first.exists() else []
            rows = np.concatenate([np.empty(0, version), *blocks])
            rows = rows[np.lexsort((rows["seq"], rows["us"]))]
            cut = int(np.searchsorted(rows["us"], limit, "right"))
            final, held = rows[:cut], rows[cut:]
            if cut:
                self.waiting.clear()
                if len(held):
                    self.waiting.appendValue((held.tobytes(),))
                ring, price = self.last.get() if self.last.exists() else (b"", np.nan)
                # The first version has no revision; it takes a place in the window all the same.
                revisions = np.concatenate((np.full(width, np.nan), np.frombuffer(ring), np.diff(final["forecast"], prepend=np.nan if price is None else price)))
                self.last.update((revisions[-width:].tobytes(), float(final["forecast"][-1])))
            self._wait(key, timerValues, int(held["us"][0]) if len(held) else None)
            for at in range(0, cut, REVISIONS_AT_ONCE):
                some = final[at : at + REVISIONS_AT_ONCE]
                until = len(revisions) - cut + at + len(some)
                total, sd = rolled(revisions[until - len(some) - width + 1 : until])
                yield pd.DataFrame({"region": key[0], "target": pd.Timestamp(key[1]), "as_of": pd.to_datetime(some["us"], unit="us"), "seq": some["seq"], "abs_revision": total, "revision_sd": sd})

        def close(self) -> None:
            pass

    once = v.withColumn("us", F.unix_micros("as_of")).withWatermark("as_of", watermark).dropDuplicatesWithinWatermark(["region", "target", "as_of", "seq"])
    return once.groupBy("region", "target").transformWithStateInPandas(
        statefulProcessor=Revisions(), outputStructType=REVISION_ROWS, outputMode="Append", timeMode="EventTime"
    )


def sliding_revisions(revised: DataFrame, span: str = "3 hours", slide: str = "30 minutes", keys: Sequence[str] = SERIES, watermark: str = "3 hours") -> DataFrame:
    """Count and mean absolute revision over recent time.

    The batch form counts the last six issues; streams have no row frames, so
    this one counts the issues of the last three hours.
    """
    return revised.withWatermark("as_of", watermark).groupBy(*keys, F.window("as_of", span, slide).alias("_w")).agg(
        F.count("revision").alias("revisions"), F.avg(F.abs("revision")).alias("mean_abs_revision")
    ).select(*keys, F.col("_w.end").alias("as_of"), "revisions", "mean_abs_revision")
