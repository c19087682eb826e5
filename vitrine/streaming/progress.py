"""Progress events: series, speed and remaining time, as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUT = "series_key string, ts timestamp, total long, current long, series long, sec_per_item double, eta_sec long"


def _paces(total: Column, current: Column, ts: Column, base_current: Column, base_ts: Column) -> tuple[Column, Column]:
    """(seconds an item, seconds left), null while measuring: nothing done, or half a second at most."""
    done = current - base_current
    elapsed = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(base_ts.cast("timestamp"))
    pace = F.when((done > 0) & (elapsed > 500_000), elapsed / 1e6 / done)
    return pace, F.floor(pace * F.greatest(F.lit(0), total - current + 1) + 0.5).cast("long")


def with_series(events: DataFrame, key: str = "series_key", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """events with series (from 1): a new one at the first event, another total, or a smaller current."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag("current").over(w)
    new = before.isNull() | (F.lag("total").over(w) != F.col("total")) | (F.col("current") < before)
    marked = events.withColumn("__new", new.cast("long"))
    return marked.withColumn("series", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def with_eta(events: DataFrame, key: str = "series_key", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Adds series, sec_per_item and eta_sec, measured from each series' first event."""
    rows = with_series(events, key, order)
    w = Window.partitionBy(key, "series").orderBy(*order)
    pace, eta = _paces(F.col("total"), F.col("current"), F.col("ts"), F.first("current").over(w), F.first("ts").over(w))
    return rows.withColumn("sec_per_item", pace).withColumn("eta_sec", eta)


def is_finished(status: str = "status", paused: str = "is_paused") -> Column:
    return (F.col(status) == "Completed") | (F.col(status).contains("Stopped") & ~F.coalesce(F.col(paused), F.lit(False)))


def stream_eta(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """with_eta over a stream of events (series_key, ts, total, current), one state for each key.

    Events of a micro-batch are taken in the order of ts. With idle_ms, a key that is silent so long is
    forgotten; such a stream keeps running batches, so it does not end by itself with availableNow.
    """
    shape = "total long, current long, base_current long, base_us long, series long"

    def follow(key, frames: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        total, current, base, base_us, series = state.get if state.exists else (None, None, None, None, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "current"], kind="stable")
        out = []
        for r in rows.itertuples(index=False):
            us = r.ts.value // 1000
            if total is None or r.total != total or r.current < current:
                base, base_us, series = r.current, us, series + 1
            total, current = int(r.total), int(r.current)
            done, elapsed = current - base, us - base_us
            pace = elapsed / 1e6 / done if done > 0 and elapsed > 500_000 else None
            eta = None if pace is None else int(pace * max(0, total - current + 1) + 0.5)
            out.append((key[0], r.ts, total, current, series, pace, eta))
        state.update((total, current, int(base), int(base_us), int(series)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        frame = pd.DataFrame(out, columns=["series_key", "ts", "total", "current", "series", "sec_per_item", "eta_sec"])
        yield frame.astype({"eta_sec": "Int64", "sec_per_item": "Float64"})

    from pyspark.sql.streaming.state import GroupStateTimeout

    wait = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    slim = events.select("series_key", "ts", "total", "current")
    return slim.groupBy("series_key").applyInPandasWithState(follow, OUT, shape, "append", wait)


def every_nth(events: DataFrame, n: int = 5) -> DataFrame:
    """What registration shows: every nth event and the last."""
    return events.where((F.col("current") % n == 0) | (F.col("current") == F.col("total")))


def refreshed(events: DataFrame, refresh, checkpoint: str):
    """Calls refresh(batch, id) for each micro-batch of events; stop() of the query cancels it."""
    return events.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).start()
