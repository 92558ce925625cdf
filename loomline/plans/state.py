"""Queries of keyed state, sources and sinks over the events and conversations tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.plans.registry import query
from loomline.session import scratch
from loomline.session import table as t
from loomline.sources import sinks, text
from loomline.streaming import keyed, stateful
from loomline.streaming.tail import LogTail


@query("""SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return keyed.latest_wins(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""WITH l AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY 1) SELECT user_id FROM l WHERE seen >= (SELECT max(seen) FROM l) - INTERVAL 6 HOUR""")
def lease_expiry(spark: SparkSession, sf: str) -> DataFrame:
    last = t(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("seen"))
    now = last.agg(F.max("seen").alias("now"))
    return keyed.leased(last.crossJoin(F.broadcast(now)), "seen", F.col("now"), 6 * 3600).select("user_id")


@query("""SELECT event_id, greatest(0, coalesce(s - lag(s) OVER w - 1, 0)) AS missed, coalesce(s < lag(s) OVER w, false) AS reset
FROM (SELECT *, event_id % 1000 AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def sequence_gaps(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "events").select("event_id", "user_id", (F.col("event_id") % 1000).alias("s"), F.col("event_id").alias("at"))
    return keyed.gaps(rows, ["user_id"], "s").select("event_id", "missed", "reset")


@query("""SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 32""")
def ring_of_records(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.ring(t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], 32).select("user_id", "event_id")


@query("""SELECT event_type AS key, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def windowed_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A stream over the table's files into a table of windows, run until all that is there is taken in."""
    base, name = t(spark, sf, "events"), scratch(spark, "stream")
    rows = spark.readStream.schema(base.schema).parquet(f"{sf}/events.parquet*").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    out = keyed.stream_windows(rows, "ts", "event_type", "value", "1 day", "1 hour")

    def land(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{name}/out")

    q = out.writeStream.outputMode("complete").foreachBatch(land).option("checkpointLocation", f"{name}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{name}/out")
    return got.select(F.col("event_type").alias("key"), F.col("window.start").cast("timestamp_ntz").alias("day"), "n", F.round("total", 2).alias("total"))


@query("""SELECT c_name AS key, c_mktsegment AS value FROM customer""")
def key_value_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "kv")
    sinks.key_value_lines(t(spark, sf, "customer"), "c_name", "c_mktsegment").write.text(path)
    return text.key_value_pairs(spark.read.text(path), "value")


@query("""SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer""")
def fact_maps(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.concat(F.lit("name="), "c_name", F.lit("\nnoise\nsegment="), "c_mktsegment", F.lit("\nname=again"))
    rows = t(spark, sf, "customer").select("c_custkey", text.facts(lines).alias("m"))
    return rows.select("c_custkey", F.col("m")["name"].alias("name"), F.col("m")["segment"].alias("segment"))


@query("""SELECT role, count(*) AS n, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM conversations GROUP BY role""")
def line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.size(F.split("text", "\n"))).alias("lines"))


def _run(spark: SparkSession, source: DataFrame, make, mode: str, label: str) -> DataFrame:
    """Rows of a stream over a table that is written first, with the batch that gave them; it runs until all is read."""
    folder, out = scratch(spark, label), scratch(spark, f"{label}-out")
    source.write.parquet(folder)
    with stateful.rocksdb(spark):
        stream = make(spark.readStream.schema(source.schema).parquet(folder))
        keep = lambda df, batch: df.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").parquet(out)
        q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", scratch(spark, f"{label}-state")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(out)


@query("""WITH l AS (SELECT user_id // 10 AS node, user_id, max(ts) AS seen FROM events GROUP BY ALL) SELECT node, list_sort(list(user_id)) AS producers
FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY seen DESC, user_id DESC) AS k FROM l) WHERE k <= 4 GROUP BY node""")
def recent_users(spark: SparkSession, sf: str) -> DataFrame:
    """The four users of each ten that were active last, from a stream with bounded state."""
    rows = t(spark, sf, "events").select(F.expr("user_id div 10").alias("node"), "user_id", "ts")
    out = _run(spark, rows, lambda s: stateful.recent_producers(s, "node", "user_id", "ts", 4), "update", "recent")
    return out.groupBy("node").agg(F.max_by("producers", "batch").alias("producers"))


@query("""WITH v AS (SELECT user_id % 20 AS ballot, (epoch_us(ts) // 86400000000 + 1) * 86400000 AS end_ms, user_id, event_type, ts FROM events), l AS (SELECT ballot, end_ms, user_id, arg_max(event_type, (ts, event_type)) AS choice FROM v GROUP BY ALL),
c AS (SELECT ballot, end_ms, choice, count(*) AS votes, sum(count(*)) OVER (PARTITION BY ballot, end_ms) AS voters, row_number() OVER (PARTITION BY ballot, end_ms ORDER BY count(*) DESC, choice) AS k FROM l GROUP BY ballot, end_ms, choice)
SELECT ballot, end_ms, voters::BIGINT AS voters, choice, votes FROM c WHERE k = 1 AND end_ms <= (SELECT max(epoch_ms(ts)) FROM events) - 3600000""")
def daily_ballots(spark: SparkSession, sf: str) -> DataFrame:
    """What most users of a ballot did last each day, from a stream that closes days by event time."""
    rows = t(spark, sf, "events").select((F.col("user_id") % 20).alias("ballot"), "user_id", "event_type", "ts")
    return _run(spark, rows, lambda s: stateful.ballots(s, "ballot", "user_id", "event_type", "ts", 86_400, "1 hour"), "append", "ballots").drop("batch")


@query("""SELECT event_type, count(*) AS lines, sum(length(event_type) + length(event_id::VARCHAR) + 1)::BIGINT AS chars FROM events GROUP BY 1""")
def tailed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as lines of log files, read by a stream that keeps byte offsets: half of them there at first, the others added before it starts again."""
    spark.dataSource.register(LogTail)
    folder, out, state = (scratch(spark, x) for x in ("log", "log-lines", "log-state"))
    line = t(spark, sf, "events").select(F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("value"), "event_id")
    for part in (0, 1):
        line.where(F.col("event_id") % 2 == part).select("value").write.mode("append").text(folder)
        stream = spark.readStream.format("log_tail").option("path", folder).option("glob", "part-*").load()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
    lines = spark.read.schema("line string").parquet(out)
    return lines.groupBy(F.split("line", " ")[0].alias("event_type")).agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))
