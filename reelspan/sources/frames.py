"""Frame catalogues, sampling plans and artifact retention."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_frame_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the frame files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*_[0-9]*.*").option("recursiveFileLookup", "true").load(folder).select("path", "length")


def frame_catalog(files: DataFrame, interval: Column) -> DataFrame:
    """(video_id, path) -> seq from the name, variant, position in order and ts_s = position * interval."""
    name = F.regexp_extract("path", r"(frame|full)_(\d+)\.[^./]+$", 1)
    out = files.select("video_id", "path", name.alias("variant"), F.regexp_extract("path", r"(frame|full)_(\d+)\.[^./]+$", 2).try_cast("int").alias("seq")).where("seq is not null")
    place = F.row_number().over(W.partitionBy("video_id", "variant").orderBy("seq", "path")) - 1
    return out.withColumn("position", place).withColumn("ts_s", F.col("position") * interval)


def pair_full_sibling(frames: DataFrame) -> DataFrame:
    """Cropped frames with their uncropped sibling, or themselves where there is none."""
    cropped = frames.where("variant = 'frame'")
    full = frames.where("variant = 'full'").select("video_id", "seq", F.col("path").alias("full"))
    return cropped.join(full, ["video_id", "seq"], "left").withColumn("full", F.coalesce("full", "path"))


def adaptive_interval(duration: Column) -> Column:
    """A two-hundredth of the duration within [0.3, 1.0] seconds; 1.0 where it is unknown."""
    return F.when(duration.isNull() | (duration <= 0), 1.0).otherwise(F.greatest(F.lit(0.3), F.least(duration / 200.0, F.lit(1.0))))


def capture_interval(duration: Column, count: int) -> Column:
    """A third of a slot within [0.3, 15.0] seconds; 1.0 where the duration is unknown."""
    return F.when(duration.isNull() | (duration <= 0), 1.0).otherwise(F.greatest(F.lit(0.3), F.least(duration / (3.0 * count), F.lit(15.0))))


def sample_times(videos: DataFrame, interval: Column) -> DataFrame:
    """One row per sample of each video of known duration: position and ts_s."""
    out = videos.withColumn("interval_s", interval).where("duration_s > 0")
    return out.withColumn("position", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("duration_s") / F.col("interval_s")).cast("int") - 1)))).withColumn("ts_s", F.col("position") * F.col("interval_s"))


def dense_window(centers: DataFrame, radius: float, step: float) -> DataFrame:
    """Timestamps from max(0, c - radius) to c + radius, `step` apart, for each centre ts_s."""
    start = F.greatest(F.lit(0.0), F.col("ts_s") - radius)
    steps = F.floor((F.col("ts_s") + radius - start) / step + 1e-9).cast("int")
    return centers.withColumn("_start", start).withColumn("k", F.explode(F.sequence(F.lit(0), steps))).withColumn("at_s", F.col("_start") + F.col("k") * step).drop("_start")


def resample_needed(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """requests (video_id, interval_s null: any) plus needed: no catalogue, or one with another interval (by over 1e-6)."""
    known = catalog.select("video_id", F.col("interval_s").alias("known_s"))
    same = F.col("interval_s").isNull() | (F.abs(F.col("interval_s") - F.col("known_s")) <= 1e-6)
    return requests.join(known, "video_id", "left").withColumn("needed", F.col("known_s").isNull() | ~same)


#: Hosts of shared links, and where their ids stand.
YOUTUBE_HOST, DROPBOX_HOST = r"youtube\.com|youtu\.be", r"dropbox\.com"
YOUTUBE_ID = r"(?:youtube\.com/watch\?(?:.*&)?v=|youtube\.com/shorts/|youtu\.be/)([A-Za-z0-9_-]+)"
DRIVE_IDS = (r"/file/d/([a-zA-Z0-9_-]+)", r"id=([a-zA-Z0-9_-]+)", r"^([a-zA-Z0-9_-]{20,})$")
DROPBOX_ID = r"/(?:s|scl/fi)/([a-zA-Z0-9]+)"


def classify_link(url: Column) -> tuple[Column, Column]:
    """Kind of source and stem of its file; ids that aren't in a shared link come from a hash of the link."""
    first = lambda regex, group=1: F.nullif(F.regexp_extract(url, regex, group), F.lit(""))
    youtube, drive = first(YOUTUBE_ID), F.coalesce(*map(first, DRIVE_IDS))
    kind = F.when(url.rlike(YOUTUBE_HOST), "youtube").when(url.rlike(DROPBOX_HOST), "dropbox")
    kind = kind.when(drive.isNotNull(), "drive").otherwise("unknown")
    path = F.regexp_extract(url, r"^(?:[^:/?#]+://[^/?#]*)?([^?#]*)", 1)
    box = F.regexp_extract(path, DROPBOX_ID, 1)
    stem = F.when(kind == "youtube", youtube).when(kind == "dropbox", F.concat(F.lit("dropbox_"), F.when(box != "", box).otherwise(F.substring(F.sha2(url, 256), 1, 16)))).otherwise(drive)
    return kind, stem


def direct_link(url: Column) -> Column:
    """The link with dl=1 in its query."""
    base, mark = F.regexp_extract(url, r"^([^#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    forced = F.when(base.rlike(r"[?&]dl="), F.regexp_replace(base, r"([?&]dl=)[^&]*", "$11")).when(F.contains(base, F.lit("?")), F.concat(base, F.lit("&dl=1"))).otherwise(F.concat(base, F.lit("?dl=1")))
    return F.concat(forced, mark)


#: File types that may be uploaded.
UPLOADS = ("mp4", "mov", "mkv", "webm", "avi")


def content_address(files: DataFrame) -> DataFrame:
    """(path, content) -> id of each distinct, non-empty content of an allowed type; copies collapse to the first path."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    sound = files.withColumn("kind", kind).where(F.col("kind").isin(*UPLOADS) & (F.octet_length("content") > 0))
    digest = F.concat(F.lit("upload_"), F.substring(F.sha2("content", 256), 1, 16), F.lit("."), F.col("kind"))
    return sound.groupBy(digest.alias("upload_id")).agg(F.min("path").alias("path"), F.count("*").alias("copies"))


def valid_upload_id(value: Column) -> Column:
    return F.coalesce(value.rlike(rf"^upload_[0-9a-f]{{16}}\.({'|'.join(UPLOADS)})$"), F.lit(False))


def retention_plan(artifacts: DataFrame, kept: DataFrame) -> DataFrame:
    """Artifacts (name, size) that belong to no kept stem (stem): five shapes of name belong to one. A name's possible stems meet the kept ones by
    equality."""
    stems = F.array(F.regexp_replace("name", r"\.[^.]*$", ""), F.regexp_extract("name", r"^frames_(.+)$", 1), F.regexp_extract("name", r"^(?:vary|eyes|clean)_(.+)_[^_]*$", 1))
    named = artifacts.select("name", F.explode(F.array_distinct(stems)).alias("_stem")).where("_stem is not null")
    owned = named.join(kept.select(F.col("stem").alias("_stem")), "_stem", "left_semi").select("name").distinct()
    return artifacts.join(owned, "name", "left_anti").select(*artifacts.columns)


def frame_grid(selected: DataFrame) -> DataFrame:
    """Result rows: frame_id in time order, score and time rounded, timecode; captions default to empty."""
    from reelspan.functions.text import timecode

    place = F.row_number().over(W.partitionBy("video_id").orderBy("ts_s", "path")) - 1
    return selected.select("video_id", place.alias("frame_id"), "path", F.round(F.col("score") + 1e-9, 4).alias("score"), F.round("ts_s", 3).alias("timestamp"), timecode(F.col("ts_s")).alias("timecode"), F.coalesce("caption", F.lit("")).alias("caption"))


def write_frame_grid(grid: DataFrame, path: str) -> None:
    grid.write.mode("overwrite").partitionBy("video_id").parquet(path)
