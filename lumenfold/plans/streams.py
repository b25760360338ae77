"""Queries of incremental behaviour. The bounded ones are held against SQL; the streams are drained with AvailableNow."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.plans.base import registry, rounded
from lumenfold.session import new_path, ship, table
from lumenfold.streaming import operators as S

QUERIES, SQL, query = registry()


def events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream(spark, d):
    """The events as a stream of files. A table that is one file is a folder's only file to the source."""
    source = events(spark, d)
    path = new_path(spark, "events-stream")
    source.repartition(8, "user_id").write.parquet(path)
    return spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 4).parquet(path)


def stream_in_time(spark, d, parts: int = 4, rows: int = 1_000_000):
    """The events as a stream that delivers them in order of time: one file after another, of about ``rows`` rows at most."""
    source = events(spark, d)
    parts = max(parts, -(-source.count() // rows))
    path = new_path(spark, "events-in-time")
    cuts = source.selectExpr(f"percentile_approx(unix_micros(ts), array({', '.join(str(k / parts) for k in range(1, parts))})) AS c").first()["c"] or []
    at = F.unix_micros("ts")
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = source.where((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(spark, df, mode: str, keys: list[str] | None = None):
    """All that a stream puts out, from a sink in the shared folder; in update mode, the last row of each key, in complete mode the last batch."""
    name = uuid.uuid4().hex
    path = new_path(spark, "sink")

    def put(batch, number):
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(path)

    df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", new_path(spark, "stream")).queryName(f"q{name}").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(path)
    if mode == "complete":
        return out.join(F.broadcast(out.agg(F.max("_batch").alias("_batch"))), "_batch").drop("_batch")
    if keys:
        last = F.max_by(F.struct(*[c for c in out.columns if c not in (*keys, "_batch")]), "_batch").alias("r")
        return out.groupBy(*keys).agg(last).select(*keys, "r.*")
    return out.drop("_batch")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    w = drained(spark, S.windows(stream_in_time(spark, d), "tumbling"), "update", ["start", "event_type"])
    return rounded(w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean"))


@query("SELECT b - k * INTERVAL 6 HOUR AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS b FROM events), (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL")
def events_sliding(spark, d):
    w = drained(spark, S.windows(stream_in_time(spark, d), "sliding"), "update", ["start", "event_type"])
    return rounded(w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean"))


@query(
    "WITH o AS (SELECT event_type, ts, value, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)"
    " SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", event_type, count(*) AS n, round(avg(value), 6) AS mean FROM s GROUP BY event_type, k"
)
def events_session(spark, d):
    w = S.windows(events(spark, d), "session")
    return rounded(w.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", "mean"))


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) <= 3 AS allowed FROM events")
def rate_guard(spark, d):
    """Whether a change comes within the permitted number in the sliding window before it."""
    w = Window.partitionBy("event_type").orderBy("s").rangeBetween(-3600, 0)
    e = events(spark, d).withColumn("s", F.round(F.unix_micros("ts") / 1e6).cast("long"))
    return e.select("event_id", (F.count(F.lit(1)).over(w) <= 3).alias("allowed"))


@query("SELECT event_type, sum(value * (user_id % 7 + 1)) IS NOT NULL AS any, round(sum(value * (user_id % 7 + 1)) / sum(user_id % 7 + 1), 6) AS mean, count(value) AS n FROM events GROUP BY event_type")
def running_combine_stream(spark, d):
    s = stream(spark, d).withColumn("w", F.col("user_id") % 7 + 1)
    out = drained(spark, S.running_combine(s, "event_type", "value", "w"), "update", ["event_type"])
    return rounded(out.select("event_type", F.col("weighted").isNotNull().alias("any"), (F.col("weighted") / F.col("weight")).alias("mean"), "n"))


@query("SELECT CASE event_type WHEN 'click' THEN 'progress' WHEN 'purchase' THEN 'phase' WHEN 'error' THEN 'log' ELSE 'stats' END AS route, count(*) AS n, round(max(least(greatest(value, 0), 100)), 6) AS percent FROM events GROUP BY 1")
def event_routing(spark, d):
    t = F.col("event_type")
    route = F.when(t == "click", "progress").when(t == "purchase", "phase").when(t == "error", "log").otherwise("stats")
    return rounded(events(spark, d).groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"), F.max(F.least(F.greatest("value", F.lit(0.0)), F.lit(100.0))).alias("percent")))


@query("SELECT event_id, round(CASE WHEN done > 0 THEN greatest(1000 - done, 0) * value / done END, 6) AS eta FROM (SELECT event_id, value, event_id % 1200 AS done FROM events)")
def eta_seconds(spark, d):
    done = F.col("event_id") % 1200
    return rounded(events(spark, d).select("event_id", S.eta(done, F.lit(1000), F.col("value")).alias("eta")))


@query(
    "WITH RECURSIVE r AS (SELECT event_type, min(ts) AS ts FROM events GROUP BY event_type UNION ALL SELECT r.event_type, min(e.ts) FROM r JOIN events e ON e.event_type = r.event_type AND e.ts >= r.ts + INTERVAL 1 HOUR GROUP BY r.event_type)"
    " SELECT event_type, min(event_id) AS event_id, ts, arg_min(value, event_id) AS value FROM r JOIN events USING (event_type, ts) GROUP BY event_type, ts"
)
def throttle_sample(spark, d):
    """Events of a type at least an hour after the last one put out."""
    ship(spark)
    s = stream_in_time(spark, d).select("event_type", "event_id", "ts", "value")
    out = drained(spark, S.throttle(s, ["event_type"], 3600.0, "event_type string, event_id long, ts timestamp, value double", tie="event_id"), "append")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "SELECT event_type, event_id, round(list_reduce(list(value) OVER (PARTITION BY event_type ORDER BY ts, event_id), lambda s, x: CASE WHEN abs(x - s) > 4 * abs(s) THEN x ELSE 0.7 * s + 0.3 * x END), 6) AS smoothed FROM events"
)
def eta_smoothing(spark, d):
    """Exponential smoothing as a fold over a stream, begun anew at a value far from it."""
    ship(spark)
    s = stream_in_time(spark, d).select("event_type", "event_id", "ts", "value")
    out = drained(spark, S.smoothed(s, ["event_type"], "event_type string, event_id long, ts timestamp, value double", shift=4.0, tie="event_id"), "append")
    return rounded(out.select("event_type", "event_id", "smoothed"))


RUNS_SQL = "e AS (SELECT event_type, event_id, ts, 1 + user_id % 3 AS units, length(event_type) * 600 AS total FROM events)"


@query(
    f"WITH RECURSIVE {RUNS_SQL}, c AS (SELECT *, least(total, sum(units) OVER w)::BIGINT AS done, epoch_us(ts) AS us, min(epoch_us(ts)) OVER (PARTITION BY event_type) AS start, row_number() OVER w AS place FROM e WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),"
    " f AS (SELECT event_type, min(place) AS last FROM c WHERE done >= total GROUP BY event_type), k AS (SELECT c.*, coalesce(f.last, 1000000000000000) AS last FROM c LEFT JOIN f USING (event_type) WHERE place <= coalesce(f.last, 1000000000000000)),"
    " r AS (SELECT event_type, place, us, NULL::DOUBLE AS rate FROM k WHERE place = 1 UNION ALL"
    " SELECT k.event_type, k.place, k.us, CASE WHEN n.rate IS NULL THEN k.done / ((k.us - k.start) / 1e6) ELSE 0.75 * n.rate + 0.25 * k.done / ((k.us - k.start) / 1e6) END FROM (SELECT r.event_type, r.rate, min(k.place) AS place FROM r JOIN k ON k.event_type = r.event_type AND k.place > r.place AND (k.us - r.us >= 7200000000 OR k.place = k.last) GROUP BY r.event_type, r.rate) n JOIN k USING (event_type, place))"
    " SELECT event_type, event_id, ts, done, total::BIGINT AS total, round(CASE WHEN place = last THEN 0 WHEN rate IS NOT NULL THEN (total - done) / rate END, 4) AS eta, place = last AS finished FROM r JOIN k USING (event_type, place)"
)
def progress_reports(spark, d):
    """Reports of runs, two hours apart at least, with the time that is left by the smoothed rate; some runs end."""
    ship(spark)
    units, total = (F.lit(1) + F.col("user_id") % 3).cast("long"), (F.length("event_type") * 600).cast("long")
    s = stream_in_time(spark, d).select("event_type", "event_id", "ts", units.alias("units"), total.alias("total"))
    out = drained(spark, S.progress(s, ["event_type"], "event_type string, event_id long", interval=7200.0, tie="event_id"), "append")
    return out.select("event_type", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "done", "total", F.round("eta", 4).alias("eta"), (F.col("done") >= F.col("total")).alias("finished"))
