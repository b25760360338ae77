"""Incremental behaviour on Structured Streaming: throttled samples, ETA, running sums, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def throttle(df: DataFrame, keys: list[str], interval: float, schema: str, tie: str | None = None) -> DataFrame:
    """Rows at least ``interval`` seconds (0.5 at least) after the last *emitted* one of their key, in order of ``ts`` and
    then ``tie``. The only state is the last emitted time, so a source must deliver batches in order of time, as events come;
    a row that comes after a later one was emitted is late and goes."""

    def emit(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["ts", tie] if tie else ["ts"], kind="stable")  # one batch of one key
        keep = []
        for t in rows["ts"].astype("datetime64[us]").astype("int64"):
            hit = last is None or t - last >= max(0.5, interval) * 1e6
            keep.append(hit)
            last = int(t) if hit else last
        if last is not None:
            state.update((last,))
        yield rows[keep]

    return df.groupBy(*keys).applyInPandasWithState(emit, schema, "last long", "append", "NoTimeout")


def _in_order(frames: Iterator[pd.DataFrame], tie: str | None) -> pd.DataFrame:
    """A key's rows of one micro-batch, in order of time; a source bounds a batch by its files."""
    rows = pd.concat(list(frames)).sort_values(["ts", tie] if tie else ["ts"], kind="stable")
    return rows.assign(us=rows["ts"].astype("datetime64[us]").astype("int64"))


def smoothed(df: DataFrame, keys: list[str], schema: str, *, alpha: float = 0.3, shift: float | None = None, value: str = "value", tie: str | None = None) -> DataFrame:
    """``df``'s rows with ``smoothed``: an exponential mean over all of the key's rows so far, that starts again at a value
    farther than ``shift`` times itself. The mean is the state, so batches of any size give the same; a null value leaves it
    as it is. Sources must deliver in order of ``ts``, then ``tie``, from batch to batch."""

    def fold(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        mean = state.get[0] if state.exists else None
        rows, out = _in_order(frames, tie), []
        for x in rows[value].to_list():
            if x is not None and x == x:
                mean = x if mean is None or shift is not None and abs(x - mean) > shift * abs(mean) else (1 - alpha) * mean + alpha * x
            out.append(mean)
        if mean is not None:
            state.update((mean,))
        yield rows.drop(columns="us").assign(smoothed=out)

    return df.groupBy(*keys).applyInPandasWithState(fold, f"{schema}, smoothed double", "mean double", "append", "NoTimeout")


def clock(seconds: float | None) -> str:
    if seconds is None:
        return "--:--:--"
    s = max(0, round(seconds))
    return f"{s // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}"


PROGRESS = "ts timestamp, done long, total long, eta double, text string"


def progress(df: DataFrame, keys: list[str], schema: str, *, interval: float = 0.3, alpha: float = 0.25, tie: str | None = None) -> DataFrame:
    """Reports (keys, tie, ts, done, total, eta, text) of runs whose rows (keys, tie, ts, units, total) tell units done: at most
    one each ``interval`` seconds, and one when the total is reached, after which a run says no more. The remaining seconds
    follow from the rate since the run's first row, smoothed from report to report; none before anything is done in any time.
    ``schema`` is that of the keys and the tie. State: start, units, rate, last report."""

    def report(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, done, rate, last, over = state.get if state.exists else (None, 0, None, None, False)
        rows, keep, out = _in_order(frames, tie), [], []
        for at, units, total in zip(rows["us"], rows["units"], rows["total"], strict=True):
            start = int(at) if start is None else start
            done = min(int(total), done + max(0, int(units)))
            due = not over and (done >= total or last is None or at - last >= interval * 1e6)
            keep.append(due)
            if not due:
                continue
            elapsed, eta, last, over = (at - start) / 1e6, None, int(at), bool(done >= total)
            if done > 0 and elapsed > 0:
                rate = done / elapsed if rate is None else (1 - alpha) * rate + alpha * done / elapsed
                eta = float((total - done) / rate)
            eta = 0.0 if over else eta
            out.append((int(done), int(total), eta, clock(eta)))
        state.update((start, done, rate, last, over))
        told = pd.DataFrame(out, columns=["done", "total", "eta", "text"]).astype({"eta": "float64"})
        yield pd.concat([rows[keep].drop(columns=["us", "units", "total"]).reset_index(drop=True), told], axis=1)

    return df.groupBy(*keys).applyInPandasWithState(report, f"{schema}, {PROGRESS}", "start long, done long, rate double, last long, over boolean", "append", "NoTimeout")


def eta(done: Column, total: Column, elapsed: Column) -> Column:
    """Remaining seconds at the rate so far; NULL before anything is done."""
    return F.when(done > 0, F.greatest(total - done, F.lit(0)) * elapsed / done)


def windows(df: DataFrame, kind: str, *, late: str = "1 hour", length: str = "1 day", slide: str = "6 hours", gap: str = "30 minutes", key: str = "event_type") -> DataFrame:
    """Tumbling, sliding or session windows over ``ts`` with a watermark: additions, the desktop tool has none."""
    w = {"tumbling": F.window("ts", length), "sliding": F.window("ts", length, slide), "session": F.session_window("ts", gap)}[kind]
    g = df.withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "mean")


def running_combine(df: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Mergeable sums: what a weighted mean needs, in update mode."""
    v, w = F.col(value), F.col(weight)
    return df.groupBy(key).agg(F.sum(v * w).alias("weighted"), F.sum(w).alias("weight"), F.count(v).alias("n"))
