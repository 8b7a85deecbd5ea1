"""Joins: instants with sentences, slots with candidates, boxes with bands, overlays with frames, tiers of variations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds in a bucket of the range joins: instants and intervals meet on (video, bucket), not on the video alone.
BUCKET = 10.0


def buckets(start: Column, end: Column, size: float = BUCKET) -> Column:
    """Numbers of the buckets that an interval touches."""
    return F.sequence(F.floor(start / size), F.floor(F.greatest(start, end) / size))


def near_in_time(rows: DataFrame, centres: DataFrame, at: str, reach: float) -> DataFrame:
    """Rows (video_id, ts_s) with the centres (video_id, `at`) within reach seconds of them, and away. A bucket is as long as the reach, so that a
    centre stands in three of them, however far it reaches."""
    size = max(BUCKET, reach)
    spans = centres.withColumn("_b", F.explode(buckets(F.col(at) - reach, F.col(at) + reach, size)))
    return rows.withColumn("_b", F.floor(F.col("ts_s") / size)).join(spans, ["video_id", "_b"]).withColumn("away", F.abs(F.col("ts_s") - F.col(at))).where(F.col("away") <= reach)


def match_instant(moments: DataFrame, sentences: DataFrame, max_gap: float = 2.5, key: tuple = ("video_id", "slot")) -> DataFrame:
    """moments (video_id, slot, ts_s) with the sentence that contains the instant, the first of several; else the nearest by its
    edges within max_gap seconds; else null. Intervals are closed; gaps that agree to a microsecond are ties."""
    spans = sentences.select("video_id", "sent_id", "text", "start_s", "end_s", F.explode(buckets(F.col("start_s") - max_gap, F.col("end_s") + max_gap)).alias("_b"))
    at = moments.withColumn("_b", F.floor(F.col("ts_s") / BUCKET))
    near = at.join(spans, ["video_id", "_b"]).where((F.col("start_s") - max_gap <= F.col("ts_s")) & (F.col("ts_s") <= F.col("end_s") + max_gap))
    distance = F.round(F.greatest(F.col("start_s") - F.col("ts_s"), F.col("ts_s") - F.col("end_s"), F.lit(0.0)), 6)
    best = near.groupBy(*key).agg(F.min_by(F.struct("sent_id", "text", distance.alias("gap_s")), F.struct(distance, "sent_id")).alias("m"))
    return moments.join(best.select(*key, "m.*"), list(key), "left")


def nearest_same_scene(slots: DataFrame, candidates: DataFrame, similarity, radius: float = 3.0, tries: int = 8, same: float = 0.90) -> DataFrame:
    """For each slot (video_id, slot, ts_s, signature, path) the first open-eyed of its `tries` nearest candidates (video_id, path,
    ts_s, signature, open) of its scene within `radius` seconds that no slot shows; slots without one are absent."""
    free = candidates.join(slots.select("video_id", "path"), ["video_id", "path"], "left_anti")
    near = near_in_time(free, slots.select("video_id", "slot", F.col("ts_s").alias("slot_s"), F.col("signature").alias("own")), "slot_s", radius)
    near = near.where(similarity(F.col("signature"), F.col("own")) >= same)
    first = near.withColumn("r", F.row_number().over(W.partitionBy("video_id", "slot").orderBy("away", "path"))).where(F.col("r") <= tries).where("open")
    return first.groupBy("video_id", "slot").agg(F.min_by(F.struct("path", "away"), "r").alias("m")).select("video_id", "slot", "m.*")


def next_different_scene(slots: DataFrame, candidates: DataFrame, similarity, same: float = 0.90) -> DataFrame:
    """One step of scene repair, for slots of the same scene as the slot before: the first candidate between a slot and the next that
    shows neither neighbour's scene. Slots are numbered in time order.

    Slots and candidates pass once in the order of time; each candidate is told the last slot before it, and that slot when the next one is.
    """
    order = W.partitionBy("video_id").orderBy("slot")
    around = slots.select("video_id", "slot", "ts_s", "signature", F.lag("signature").over(order).alias("before"), F.lead("signature").over(order).alias("after"), F.lead("ts_s").over(order).alias("limit_s"))
    stuck = F.coalesce(similarity(F.col("before"), F.col("signature")) >= same, F.lit(False))
    told = around.select("video_id", F.col("ts_s").alias("_t"), F.struct("slot", "limit_s", stuck.alias("stuck"), F.when(stuck, F.col("before")).alias("before"), F.when(stuck, F.col("after")).alias("after")).alias("_slot"))
    free = candidates.join(slots.select("video_id", "path"), ["video_id", "path"], "left_anti").select("video_id", F.col("ts_s").alias("_t"), F.struct("path", "signature").alias("_free"))
    passing = W.partitionBy("video_id").orderBy("_t", F.col("_slot").isNotNull(), "_slot.slot").rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = told.unionByName(free, allowMissingColumns=True).withColumn("_last", F.last("_slot", True).over(passing)).where("_free is not null and _last.stuck and (_last.limit_s is null or _t < _last.limit_s)")
    other = (similarity(F.col("_free.signature"), F.col("_last.before")) < same) & (F.col("_last.after").isNull() | (similarity(F.col("_free.signature"), F.col("_last.after")) < same))
    return carried.where(other).groupBy("video_id", F.col("_last.slot").alias("slot")).agg(F.min_by("_free.path", F.struct("_t", "_free.path")).alias("path"))


def flag_used(candidates: DataFrame, used: DataFrame, recent: DataFrame, key: tuple = ("video_id", "path")) -> DataFrame:
    """candidates plus used and recent: whether another slot shows them, and whether this slot's history does."""
    mark = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    out = candidates.join(mark(used, "used"), list(key), "left").join(mark(recent, "recent"), list(key), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("used", "recent")})


def variation_tiers(candidates: DataFrame) -> DataFrame:
    """Best candidate (video_id, path, score, on_shot, used, recent) of the first tier that has one: on the shot, unused and not
    recent; unused and not recent; unused; anything."""
    tier = F.when(F.col("on_shot") & ~F.col("used") & ~F.col("recent"), 1).when(~F.col("used") & ~F.col("recent"), 2).when(~F.col("used"), 3).otherwise(4)
    best = candidates.withColumn("tier", tier).groupBy("video_id").agg(F.min(F.struct("tier", (-F.col("score")).alias("s"), "path")).alias("b"))
    return best.select("video_id", "b.path", "b.tier", (-F.col("b.s")).alias("score"))


def capture_variation_tiers(candidates: DataFrame, sharp: float = 0.75, moved: float = 0.5) -> DataFrame:
    """Of a slot's same-scene candidates (video_id, slot, path, focus, origin_focus, moved, open, used): sharp enough, moved at least half
    as much as the one that moved most; unused and open-eyed before unused before any; larger move wins, then path."""
    kept = candidates.where(F.col("focus") >= sharp * F.col("origin_focus"))
    kept = kept.withColumn("_most", F.max("moved").over(W.partitionBy("video_id", "slot"))).where(F.col("moved") >= moved * F.col("_most"))
    tier = F.when(~F.col("used") & F.col("open"), 1).when(~F.col("used"), 2).otherwise(3)
    best = kept.groupBy("video_id", "slot").agg(F.min(F.struct(tier.alias("tier"), (-F.col("moved")).alias("m"), "path")).alias("b"))
    return best.select("video_id", "slot", "b.path", "b.tier")


def text_in_bands(boxes: DataFrame, bands: DataFrame) -> DataFrame:
    """Boxes whose vertical middle is inside a band (video_id, top, bottom as fractions) of their video; at most three bands a video."""
    middle = (F.col("y") + F.col("h") / 2.0) / F.col("frame_h")
    b = bands.select(F.col("video_id").alias("_v"), "top", "bottom")
    return boxes.join(b, (F.col("video_id") == F.col("_v")) & (middle >= F.col("top")) & (middle <= F.col("bottom")), "left_semi")


def overlays_present(frames: DataFrame, overlays: DataFrame, least: float = 0.60) -> DataFrame:
    """Overlays (video_id, overlay_id, reference pixels by x, y) whose pixels correlate with a frame's (video_id, seq, x, y, gray); overlays that
    reach out of the frame are skipped."""
    joined = frames.join(overlays, ["video_id", "y", "x"])
    size = overlays.groupBy("video_id", "overlay_id").agg(F.count("*").alias("size"))
    found = joined.groupBy("video_id", "overlay_id", "seq").agg(F.corr("gray", "reference").alias("r"), F.count("*").alias("n"), F.stddev_pop("gray").alias("a"), F.stddev_pop("reference").alias("b"))
    found = found.join(size, ["video_id", "overlay_id"]).where("n = size")
    return found.select("video_id", "overlay_id", "seq", F.when((F.col("n") < 16) | (F.col("a") < 1e-6) | (F.col("b") < 1e-6), 0.0).otherwise(F.col("r")).alias("r")).where(F.col("r") >= least)


def missing_pins(required: DataFrame, installed: DataFrame) -> DataFrame:
    """Pins (pin name==version) per machine that no installed package (machine, name, version) satisfies: the same normalised name, and
    the version itself or one with a local suffix."""
    from reelspan.functions.text import normalise_package

    parts = F.split("pin", "==", 2)
    pins = required.select("machine", "pin", normalise_package(parts[0]).alias("_name"), F.coalesce(F.get(parts, 1), F.lit("")).alias("_want"))
    have = installed.select(F.col("machine").alias("_m"), normalise_package(F.col("name")).alias("_n"), "version")
    fits = (F.col("machine") == F.col("_m")) & (F.col("_name") == F.col("_n")) & ((F.col("version") == F.col("_want")) | F.col("version").startswith(F.concat(F.col("_want"), F.lit("+"))))
    return pins.join(have, fits, "left_anti").select("machine", "pin")


def missing_assets(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Referenced paths (pack, path) that are absent or empty among files (path, size), with the reason."""
    out = refs.join(files, "path", "left").withColumn("reason", F.when(F.col("size").isNull(), "missing").when(F.col("size") == 0, "empty"))
    return out.where("reason is not null").select("pack", "path", "reason")


def resolve_faces(packs: DataFrame, faces: DataFrame, fallback: str) -> tuple[DataFrame, DataFrame]:
    """Packs (id, face name or null, inline face or null) with the face's document, and problem rows for unknown names."""
    named = packs.join(faces.select(F.col("name").alias("face"), F.col("doc").alias("_doc")), "face", "left")
    unknown = F.col("inline").isNull() & F.col("face").isNotNull() & F.col("_doc").isNull()
    out = named.withColumn("doc", F.coalesce("inline", "_doc", F.lit(fallback)))
    return out.select("id", "face", "doc"), named.where(unknown).select("id", F.concat(F.lit("unknown face "), "face").alias("problem"))


def checksum_mismatches(files: DataFrame, feed: DataFrame) -> DataFrame:
    """Files (file, sha256) whose digest differs from the feed's (case aside); entries without a digest are accepted."""
    want = feed.select("file", F.lower(F.trim("sha256")).alias("want"))
    return files.join(want, "file").where((F.coalesce("want", F.lit("")) != "") & (F.lower("sha256") != F.col("want"))).select("file", "sha256", "want")
