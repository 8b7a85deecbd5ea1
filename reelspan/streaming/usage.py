"""Usage events: typed rows from JSON lines, sessions, and their streaming counterparts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Spelling of times in JSON lines, to the microsecond.
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
SCHEMA = "timestamp string, client_ip string, channel string, user string, action string, details map<string,string>"


def typed(raw: DataFrame) -> DataFrame:
    """Raw events with defaults: the first hop as address, channel unknown, the address as user, action activity."""
    ip = F.trim(F.get(F.split("client_ip", ","), F.lit(0)))
    return raw.select(F.to_timestamp("timestamp").alias("ts"), ip.alias("client_ip"), F.coalesce("channel", F.lit("unknown")).alias("channel"), F.coalesce("user", ip).alias("user"), F.coalesce("action", F.lit("activity")).alias("action"), "details")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return typed(spark.read.schema(SCHEMA).json(path))


def stream_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return typed(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path))


def write_events(events: DataFrame, path: str) -> None:
    """Append JSON lines, one folder per channel."""
    events.write.mode("append").option("timestampFormat", STAMP).partitionBy("channel").json(path)


def append_events(events: DataFrame, path: str, state: str):
    """Write a stream of events as JSON lines, one folder per channel, until what has arrived is written; gives the running query. state: the folder in
    which the stream keeps what it has done, so that after a stop or a crash, whenever it came, it goes on there and every event is in
    path once. Read path with read_appended, which leaves files of unfinished batches out."""
    sink = events.writeStream.format("json").partitionBy("channel").option("path", path).option("checkpointLocation", state).option("timestampFormat", STAMP)
    return sink.outputMode("append").trigger(availableNow=True).start()


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ts timestamp, client_ip string, user string, action string, details map<string,string>, channel string").option("timestampFormat", STAMP).json(path)


def activity_counts(events: DataFrame, window: str = "1 hour", watermark: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Events per window, channel and action; on a stream, rows later than the watermark are dropped."""
    source = events.withWatermark("ts", watermark) if events.isStreaming else events
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return source.groupBy(w.alias("w"), "channel", "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "channel", "action", "n")


def user_sessions(events: DataFrame, gap: str = "45 minutes", watermark: str = "2 hours") -> DataFrame:
    """Sessions of each user; one ends after more than `gap` without an event. end is the last event plus the gap."""
    source = events.withWatermark("ts", watermark) if events.isStreaming else events
    return source.groupBy(F.session_window("ts", gap).alias("w"), "user").agg(F.count("*").alias("n")).select("user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions_by_lag(events: DataFrame, minutes: int = 45) -> DataFrame:
    """The same sessions by the distance to the event before and a running count."""
    v = W.partitionBy("user").orderBy("ts")
    apart = (F.unix_micros(F.col("ts")) - F.unix_micros(F.lag("ts").over(v))) > minutes * 60_000_000
    named = events.withColumn("_s", F.sum(F.coalesce(apart.cast("int"), F.lit(0))).over(v))
    return named.groupBy("user", "_s").agg(F.min("ts").alias("start"), F.count("*").alias("n")).drop("_s")
