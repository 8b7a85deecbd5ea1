"""Queries over usage events, with their SQL."""

import uuid

from pyspark.sql import functions as F

from reelspan.functions.shared import shared_folder
from reelspan.plans.fixtures import ctes, table
from reelspan.plans.registry import query
from reelspan.streaming import usage as us

c = F.col
RAW = {"timestamp": "cast(ts as string)", "client_ip": "CASE WHEN event_id % 3 = 0 THEN concat(' 10.0.0.', user_id % 256, ', 1.1.1.1') ELSE concat('10.0.0.', user_id % 256) END", "channel": "CASE WHEN event_id % 5 > 0 THEN concat('channel', user_id % 7) END", "user": "CASE WHEN event_id % 4 > 0 THEN cast(user_id as string) END", "action": "CASE WHEN event_id % 6 > 0 THEN event_type END"}
raw = lambda s, d: table(s, d, "events").selectExpr("event_id", *[f"{v} AS {k}" for k, v in RAW.items()], "map('k', props) AS details")
query("src12_read_adoption_events", lambda s, d: us.typed(raw(s, d)).select(F.unix_micros(c("ts").cast("timestamp")).alias("us"), "client_ip", "channel", "user", "action"),
      """SELECT epoch_us(ts) AS us, '10.0.0.' || (user_id % 256) AS client_ip, CASE WHEN event_id % 5 > 0 THEN 'channel' || (user_id % 7) ELSE 'unknown' END AS channel, CASE WHEN event_id % 4 > 0 THEN CAST(user_id AS VARCHAR) ELSE '10.0.0.' || (user_id % 256) END AS user, CASE WHEN event_id % 6 > 0 THEN event_type ELSE 'activity' END AS action FROM events""")
events = lambda s, d: table(s, d, "events").select(c("ts").cast("timestamp").alias("ts"), F.concat(F.lit("channel"), (c("user_id") % 7).cast("string")).alias("channel"), c("user_id").cast("string").alias("user"), c("event_type").alias("action"))
query("win18_user_sessions", lambda s, d: us.user_sessions(events(s, d)).select("user", F.unix_micros("start").alias("start_us"), "n"),
      "WITH q AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 2700000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM q) SELECT CAST(user_id AS VARCHAR) AS user, epoch_us(min(ts)) AS start_us, count(*) AS n FROM r GROUP BY user_id, s")
query("win18_user_sessions_by_lag", lambda s, d: us.sessions_by_lag(events(s, d)).select("user", F.unix_micros("start").alias("start_us"), "n"),
      "WITH q AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 2700000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM q) SELECT CAST(user_id AS VARCHAR) AS user, epoch_us(min(ts)) AS start_us, count(*) AS n FROM r GROUP BY user_id, s")
HOURS = "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, 'channel' || (user_id % 7) AS channel, event_type AS action, count(*) AS n FROM events GROUP BY ALL"
query("str2_activity_counts", lambda s, d: us.activity_counts(events(s, d)).select(F.unix_micros("start").alias("start_us"), "channel", "action", "n"), HOURS)


def _streamed(spark, d, build, schema):
    """The driver's events as a file stream, run to its end once: what append mode has closed by then."""
    where = f"{shared_folder(spark)}/usage-{uuid.uuid4().hex}"
    made = {"timestamp": "date_format(cast(ts as timestamp), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\")", "channel": "concat('channel', user_id % 7)", "user": "cast(user_id as string)", "action": "event_type"}
    table(spark, d, "events").select(*[F.expr(v).alias(k) for k, v in made.items()]).write.json(f"{where}/in")
    stream = build(us.stream_events(spark, f"{where}/in", 1_000_000)).writeStream.format("parquet").option("path", f"{where}/out")
    stream.option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{where}/out")


query("str1_2_stream_activity_counts", lambda s, d: _streamed(s, d, lambda e: us.activity_counts(e, watermark="1 hour"), "start timestamp, end timestamp, channel string, action string, n long").select(F.unix_micros("start").alias("start_us"), "channel", "action", "n"),
      f"WITH q AS ({HOURS}) SELECT * FROM q WHERE start_us + 3600000000 <= (SELECT epoch_us(max(ts)) - 3600000000 FROM events)")
query("str3_stream_user_sessions", lambda s, d: _streamed(s, d, lambda e: us.user_sessions(e, watermark="1 hour"), "user string, start timestamp, end timestamp, n long").select("user", F.unix_micros("start").alias("start_us"), "n"),
      """WITH q AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 2700000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM q)
      SELECT CAST(user_id AS VARCHAR) AS user, epoch_us(min(ts)) AS start_us, count(*) AS n FROM r GROUP BY user_id, s HAVING epoch_us(max(ts)) + 2700000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 3600000000 FROM events)""")


def _appended(spark, d):
    """The events in four files, appended by a stream that is stopped after the first two have come and started again for the others."""
    where = f"{shared_folder(spark)}/usage-{uuid.uuid4().hex}"
    made = {"timestamp": "date_format(cast(ts as timestamp), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\")", "channel": "concat('channel', user_id % 7)", "user": "cast(user_id as string)", "action": "event_type"}
    rows = table(spark, d, "events").select("event_id", *[F.expr(v).alias(k) for k, v in made.items()])
    for part in (0, 1):
        rows.where(c("event_id") % 2 == part).drop("event_id").repartition(2).write.mode("append").json(f"{where}/in")
        us.append_events(us.stream_events(spark, f"{where}/in", 1), f"{where}/out", f"{where}/state").awaitTermination()
    return us.read_appended(spark, f"{where}/out")


query("src13_append_events", lambda s, d: _appended(s, d).select(F.unix_micros("ts").alias("us"), "channel", "user", "action"),
      "SELECT epoch_us(ts) AS us, 'channel' || (user_id % 7) AS channel, CAST(user_id AS VARCHAR) AS user, event_type AS action FROM events")
