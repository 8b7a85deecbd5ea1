"""Queries over frames, faces and grabs, with their SQL."""

from pyspark.sql import functions as F

from reelspan.operators import matching, scoring, selection
from reelspan.plans.fixtures import ctes, table
from reelspan.plans.registry import query
from reelspan.sources import frames

c = F.col


def near(value, digits):
    """Rounded for comparison; the shift keeps halves from falling either way."""
    return F.round(value + 1e-8, digits)


def scored_grabs(spark, d):
    return table(spark, d, "grabs").withColumn("score", scoring.grab_score(c("focus"), c("motion"), c("contrast")))


SCORED = "0.6 * least(focus / 400.0, 1) + 0.25 * motion + 0.15 * least(contrast / 60.0, 1)"
FLOORED = f"""s AS (SELECT *, {SCORED} AS score, median(focus) OVER (PARTITION BY video_id) AS med FROM grabs),
f AS (SELECT *, focus >= greatest(60, 0.45 * med) AND motion >= 0.2 AND contrast >= 12 AS sharp FROM s
  WHERE focus >= greatest(25, 0.22 * med) AND motion >= 0.08 AND contrast >= 6)"""
SLICED = """w AS (SELECT *, CASE WHEN max(ts_s) OVER (PARTITION BY video_id) > 0 THEN max(ts_s) OVER (PARTITION BY video_id) / 12 ELSE 1.0 END AS width FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY video_id, slice ORDER BY score DESC, ts_s, path) AS r FROM (SELECT *, CAST(least(11, floor(ts_s / width)) AS INT) AS slice FROM w) WHERE sharp)"""
MATCH = """(SELECT m.video_id, m.slot, arg_min(s.sent_id, (round(greatest(start_s - ts_s, ts_s - end_s, 0), 6), sent_id)) AS sent_id, arg_min(s.text, (round(greatest(start_s - ts_s, ts_s - end_s, 0), 6), sent_id)) AS text
  FROM {m} m JOIN sentences s ON m.video_id = s.video_id AND ts_s BETWEEN start_s - 2.5 AND end_s + 2.5 GROUP BY m.video_id, m.slot)"""
TIMECODE = "printf('%02dm%02ds%02d', CAST(floor(floor(ts_s) / 60) AS INT), CAST(floor(ts_s) AS INT) % 60, CAST(round_even((ts_s - floor(ts_s)) * 100, 0) AS INT) % 100)"


def _capture(spark, d):
    best = selection.best_per_slice(selection.quality_floors(scored_grabs(spark, d)), 12)
    captioned = matching.match_instant(best, table(spark, d, "sentences"), key=("video_id", "path"))
    return frames.frame_grid(captioned.withColumnRenamed("text", "caption"))


query("capture_selection", _capture, ctes("grabs", "sentences") + f", {FLOORED}, {SLICED}, g AS (SELECT video_id, path AS slot, ts_s, score, path FROM b WHERE r = 1), m AS " + MATCH.replace("{m}", "g") + f"""
SELECT g.video_id, row_number() OVER (PARTITION BY g.video_id ORDER BY ts_s, path) - 1 AS frame_id, path, round(score + 1e-9, 4) AS score, round(ts_s, 3) AS timestamp,
  {TIMECODE} AS timecode, coalesce(m.text, '') AS caption FROM g LEFT JOIN m ON g.video_id = m.video_id AND g.slot = m.slot""")
query("agg1_quality_floors", lambda s, d: selection.quality_floors(scored_grabs(s, d)).select("video_id", "event_id", F.round("score", 6).alias("score"), F.round("median_focus", 6).alias("median_focus"), "sharp"),
      ctes("grabs") + f", {FLOORED} SELECT video_id, event_id, round(score, 6) AS score, round(med, 6) AS median_focus, sharp FROM f")
query("agg2_best_per_slice", lambda s, d: selection.best_per_slice(selection.quality_floors(scored_grabs(s, d)), 12).select("video_id", "slice", "path"),
      ctes("grabs") + f", {FLOORED}, {SLICED} SELECT video_id, slice, path FROM b WHERE r = 1")
query("agg15_run_summary", lambda s, d: selection.quality_floors(scored_grabs(s, d)).groupBy("video_id").agg(F.count("*").alias("usable"), F.count_if("sharp").alias("sharp"), F.round(F.percentile("focus", F.lit(0.5)), 6).alias("median_focus")),
      ctes("grabs") + f", {FLOORED} SELECT video_id, count(*) AS usable, count(*) FILTER (sharp) AS sharp, round(median(focus), 6) AS median_focus FROM f GROUP BY video_id")


def _run_counts(spark, d):
    usable = selection.quality_floors(scored_grabs(spark, d))
    best = selection.best_per_slice(usable, 12)
    shown = matching.match_instant(best, table(spark, d, "sentences"), key=("video_id", "path")).select("video_id", c("slice").alias("slot"), "path", c("text").alias("caption"))
    repaired = best.select("video_id", c("slice").alias("slot"), F.when(c("event_id") % 4 == 0, F.concat("path", F.lit("x"))).otherwise(c("path")).alias("path"))
    return selection.run_summary(usable, shown, repaired, table(spark, d, "candidates")).withColumn("median_focus", F.round("median_focus", 6))


query("agg15_run_counts", _run_counts, ctes("grabs", "sentences", "candidates") + f", {FLOORED}, {SLICED}, g AS (SELECT video_id, path AS slot, ts_s, event_id, slice FROM b WHERE r = 1), m AS " + MATCH.replace("{m}", "g") + """,
u AS (SELECT video_id, count(*) AS usable, count(*) FILTER (sharp) AS sharp, round(median(focus), 6) AS median_focus FROM f GROUP BY 1),
cp AS (SELECT g.video_id, count(*) FILTER (trim(coalesce(m.text, '')) <> '') AS captioned, count(*) FILTER (event_id % 4 = 0) AS swapped FROM g LEFT JOIN m ON m.video_id = g.video_id AND m.slot = g.slot GROUP BY 1),
pe AS (SELECT video_id, count(DISTINCT character_id) AS characters FROM candidates WHERE character_id >= 0 GROUP BY 1)
SELECT u.video_id, usable, sharp, median_focus, coalesce(captioned, 0) AS captioned, coalesce(swapped, 0) AS swapped, coalesce(characters, 0) AS characters FROM u LEFT JOIN cp USING (video_id) LEFT JOIN pe USING (video_id)""")
query("join1_match_instant", lambda s, d: matching.match_instant(table(s, d, "moments"), table(s, d, "sentences")).select("video_id", "slot", "sent_id", F.round("gap_s", 6).alias("gap_s")),
      ctes("moments", "sentences") + f", m AS {MATCH.replace('{m}', 'moments')} SELECT o.video_id, o.slot, m.sent_id, CASE WHEN s.sent_id IS NOT NULL THEN round(greatest(s.start_s - o.ts_s, o.ts_s - s.end_s, 0), 6) END AS gap_s FROM moments o LEFT JOIN m USING (video_id, slot) LEFT JOIN sentences s ON s.video_id = o.video_id AND s.sent_id = m.sent_id")
query("exp21_grab_score", lambda s, d: scored_grabs(s, d).select("event_id", F.round("score", 6).alias("score")), ctes("grabs") + f" SELECT event_id, round({SCORED}, 6) AS score FROM grabs")

# faces
SCALE = "CASE WHEN face_count = 1 AND w * h > 0 THEN greatest(sqrt(1280.0 * 720 / 6 / (w * h)), greatest(1280.0 / frame_w, 720.0 / frame_h)) ELSE greatest(1280.0 / frame_w, 720.0 / frame_h) END"
FRAMED = f"""z AS (SELECT *, {SCALE} AS s FROM faces),
y AS (SELECT *, (x + w / 2.0) * s AS cx, (y + h / 2.0) * s AS cy FROM z),
k AS (SELECT *, cx - 1280 * 0.667 AS ix, cy - 720 * 0.333 AS iy FROM y),
fr AS (SELECT *, greatest(0, least(ix, frame_w * s - 1280)) AS crop_x, greatest(0, least(iy, frame_h * s - 720)) AS crop_y FROM k),
g AS (SELECT *, (cx - crop_x - w * s / 2.0) / 1280 AS space FROM fr)"""
PARTS = """p AS (SELECT *, least(w * h / (frame_w * frame_h * 1.0) / 0.25, 1) AS face_size, least(sharpness / 300.0, 1) AS sharp_part,
  CASE WHEN var_x + var_y < 1e-6 THEN 0 ELSE least(var_x, var_y) / greatest(var_x, var_y) END AS motion_blur,
  CASE WHEN mean_luma BETWEEN 80 AND 190 THEN 1 WHEN mean_luma < 80 THEN greatest(0, mean_luma / 80.0) ELSE greatest(0, (255 - mean_luma) / 65.0) END AS exposure,
  CASE WHEN space < 0.12 THEN 0 ELSE greatest(0, 1 - edge_density * 5) END AS left_space,
  greatest(0, 1 - 3 * (abs(crop_x - ix) / 1280 + abs(crop_y - iy) / 720) / 2) AS reframability,
  CASE WHEN w * s * h * s / (1280 * 720) * 6 <= 1.5 THEN 1 ELSE greatest(0, 1 - (w * s * h * s / (1280 * 720) * 6 - 1.5) / 1.5) END AS penalty FROM g)"""
faces = lambda s, d: table(s, d, "faces")
ID = ["video_id", "seq", "face_id"]
query("exp16_framing", lambda s, d: scoring.add_framing(faces(s, d)).select(*ID, *[near(c(f"framing.{k}"), 5).alias(k) for k in ("scale", "crop_x", "crop_y", "text_space")], "framing.valid"),
      ctes("faces") + f", {FRAMED} SELECT video_id, seq, face_id, round(s + 1e-8, 5) AS scale, round(crop_x + 1e-8, 5) AS crop_x, round(crop_y + 1e-8, 5) AS crop_y, round(space + 1e-8, 5) AS text_space, space >= 0.12 AS valid FROM g")
query("exp17_geometry", lambda s, d: scoring.add_framing(faces(s, d)).select(*ID, *scoring.geometry()),
      ctes("faces") + f", {FRAMED} SELECT video_id, seq, face_id, CAST(trunc(frame_w * s) AS INT) AS scaled_w, CAST(trunc(frame_h * s) AS INT) AS scaled_h, CAST(greatest(0, least(round_even(crop_x, 0), trunc(frame_w * s) - 1280)) AS INT) AS crop_x, CAST(greatest(0, least(round_even(crop_y, 0), trunc(frame_h * s) - 720)) AS INT) AS crop_y FROM g")
BREAKDOWN = ["face_size", "motion_blur", "exposure", "left_space", "reframability", "penalty"]
query("exp4_to_11_composite_score", lambda s, d: scoring.add_score(faces(s, d)).select(*ID, near(c("score"), 6).alias("score"), near(c("sharpness_part"), 3).alias("sharpness"), *[near(c(k), 3).alias(k) for k in BREAKDOWN]),
      ctes("faces") + f", {FRAMED}, {PARTS} SELECT video_id, seq, face_id, round((face_size * 0.10 + sharp_part * 0.28 + motion_blur * 0.12 + exposure * 0.15 + left_space * 0.22 + reframability * 0.13) * penalty + 1e-8, 6) AS score, round(sharp_part + 1e-8, 3) AS sharpness, {', '.join(f'round({k} + 1e-8, 3) AS {k}' for k in BREAKDOWN)} FROM p")
query("exp12_13_sharp_partition", lambda s, d: faces(s, d).withColumn("label", scoring.sharp_label(c("sharpness"))).where("label is not null").select(*ID, "label"),
      ctes("faces") + " SELECT video_id, seq, face_id, CASE WHEN sharpness >= 20 THEN 'strict' ELSE 'relaxed' END AS label FROM faces WHERE sharpness >= 8")
EYES = lambda: F.expr("array(named_struct('x', x % 40, 'y', y % 12, 'w', 20 + face_id, 'h', 15), named_struct('x', 30 + y % 50, 'y', x % 14, 'w', 18 + face_id * 2, 'h', 14), named_struct('x', 5, 'y', 5, 'w', 4, 'h', 4))")
EYE_SQL = """CASE WHEN w / (h * 1.0) < 0.6 THEN false ELSE abs((x % 40 + (20 + face_id) / 2.0) - (30 + y % 50 + (18 + face_id * 2) / 2.0)) / w >= 0.25
  AND abs((y % 12 + 7.5) - (x % 14 + 7.0)) / floor(h * 0.55) <= 0.2 END"""
open_eyes = lambda: scoring.eyes_plausible(c("w"), c("h"), EYES(), F.floor(c("h") * 0.55))
query("exp12_usable_faces", lambda s, d: scoring.usable_faces(faces(s, d), EYES()).select(*ID), ctes("faces") + f" SELECT video_id, seq, face_id FROM faces WHERE sharpness >= 20 AND {EYE_SQL}")
query("exp14_eyes_plausible", lambda s, d: faces(s, d).select(*ID, open_eyes().alias("plausible")), ctes("faces") + f" SELECT video_id, seq, face_id, {EYE_SQL} AS plausible FROM faces")
query("exp15_eye_state", lambda s, d: selection.top_faces(faces(s, d), 1).select("video_id", "seq", scoring.eye_state(F.lit(True), open_eyes()).alias("state")),
      ctes("faces") + f" SELECT video_id, seq, CASE WHEN {EYE_SQL} THEN 'open' ELSE 'shut' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY video_id, seq ORDER BY w * h DESC, face_id, x, y) AS r FROM faces) WHERE r = 1")
query("exp18_box_expand", lambda s, d: faces(s, d).select(*ID, *scoring.box_expand(1.5, 100)),
      ctes("faces") + "".join([" SELECT video_id, seq, face_id, "] + [f"CAST(greatest(0, round_even({a} + {b} / 2.0 - greatest({b} * 1.5, 100) / 2, 0)) AS INT) AS {a}1, CAST(least({f}, round_even({a} + {b} / 2.0 + greatest({b} * 1.5, 100) / 2, 0)) AS INT) AS {a}2{e} " for a, b, f, e in (("x", "w", "frame_w", ","), ("y", "h", "frame_h", ""))]) + "FROM faces")
query("exp18_box_scale", lambda s, d: faces(s, d).select(*ID, *scoring.box_scale(0.37)), ctes("faces") + " SELECT video_id, seq, face_id, " + ", ".join(f"CAST(round_even({k} * 0.37::DOUBLE, 0) AS INT) AS {k}" for k in "xywh") + " FROM faces")
query("exp18_face_region", lambda s, d: faces(s, d).select(*ID, *scoring.face_region()),
      ctes("faces") + ", q AS (SELECT *, CAST(trunc(greatest(w, h) / 3.0) AS INT) AS pad FROM faces) SELECT video_id, seq, face_id, greatest(0, x - pad) AS x1, greatest(0, y - pad) AS y1, least(frame_w, x + w + pad) AS x2, least(frame_h, y + h + pad) AS y2 FROM q")
query("exp19_full_to_cropped", lambda s, d: scoring.full_to_cropped(faces(s, d)).select(*ID, "cropped_y", "cropped_h"),
      ctes("faces") + " SELECT video_id, seq, face_id, greatest(0, y - 86) AS cropped_y, least(734, y + h - 86) - greatest(0, y - 86) AS cropped_h FROM faces WHERE least(734, y + h - 86) > greatest(0, y - 86)")
query("exp20_band_rows", lambda s, d: faces(s, d).select(*ID, *scoring.band_rows(c("y") / 1080, (c("y") + c("h")) / 1080, F.lit(734), c("face_id") % 2 == 0)),
      ctes("faces") + " SELECT video_id, seq, face_id, CASE WHEN face_id % 2 = 0 THEN CAST(trunc(y / 1080.0::DOUBLE * 734) AS INT) ELSE greatest(0, CAST(trunc((y / 1080.0::DOUBLE - 0.08) / (1 - 0.08::DOUBLE - 0.24) * 734) AS INT)) END AS row_top, CASE WHEN face_id % 2 = 0 THEN CAST(trunc((y + h) / 1080.0::DOUBLE * 734) AS INT) ELSE least(734, CAST(trunc(((y + h) / 1080.0::DOUBLE - 0.08) / (1 - 0.08::DOUBLE - 0.24) * 734) AS INT)) END AS row_bottom FROM faces")
query("exp23_face_damage", lambda s, d: scored_grabs(s, d).select("event_id", F.round(scoring.face_damage(c("motion") / 10), 6).alias("damage")), ctes("grabs") + " SELECT event_id, round(greatest(0, least(1, (0.060 - motion / 10) / 0.040)), 6) AS damage FROM grabs")
query("exp24_centred_subject", lambda s, d: faces(s, d).select(*ID, scoring.centred_subject(c("w") + 300, c("h") + 200).alias("b")).select(*ID, "b.*"),
      ctes("faces") + ", q AS (SELECT *, w + 300 AS fw, h + 200 AS fh, greatest(1280::DOUBLE / (w + 300), 720::DOUBLE / (h + 200)) AS s FROM faces) SELECT video_id, seq, face_id, CAST(trunc(((fw * s - 1280) / 2 + 1280 * 0.667::DOUBLE) / s) AS INT) AS x, CAST(trunc(((fh * s - 720) / 2 + 720 * 0.333::DOUBLE) / s) AS INT) AS y, 1 AS w, 1 AS h FROM q")
query("exp26_unletterbox", lambda s, d: scoring.unletterbox(faces(s, d).withColumns({"scale": F.lit(0.5), "pad_x": F.lit(100), "pad_y": F.lit(60)})).select(*ID, "x", "y", "w", "h"),
      ctes("faces") + ", q AS (SELECT *, CAST(greatest(0, trunc((x - 100) / 0.5)) AS INT) AS x1, CAST(greatest(0, trunc((y - 60) / 0.5)) AS INT) AS y1, CAST(least(1920, round_even((x + w - 100) / 0.5, 0)) AS INT) AS x2, CAST(least(1080, round_even((y + h - 60) / 0.5, 0)) AS INT) AS y2 FROM faces) SELECT video_id, seq, face_id, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h FROM q WHERE x2 > x1 AND y2 > y1")
query("sel1_top_faces", lambda s, d: selection.top_faces(faces(s, d), 4).select(*ID, "place", "n"),
      ctes("faces") + ", q AS (SELECT *, row_number() OVER (PARTITION BY video_id, seq ORDER BY w * h DESC, face_id) AS place, count(*) OVER (PARTITION BY video_id, seq) AS c FROM faces) SELECT video_id, seq, face_id, place, CASE WHEN place = 1 THEN c ELSE 1 END AS n FROM q WHERE place <= 4")
SPEC = """concat('{"anchor_x": ', CASE WHEN o_orderkey % 5 = 0 THEN '"x"' ELSE CAST(o_orderkey % 30 / 10.0 AS VARCHAR(20)) END, ', "canvas_w": ', CAST(o_orderkey % 5000 + 0.5 AS VARCHAR(20)), ', "face_fill": ', CASE WHEN o_orderkey % 3 = 0 THEN 'false' ELSE '0' END, ', "weights": {"sharpness": ', CAST(o_orderkey % 7 - 1 AS VARCHAR(20)), ', "motion_blur": ', CAST(o_orderkey % 4 AS VARCHAR(20)), ', "other": 3, "left_space": "many"}}')"""
specs = lambda s, d: table(s, d, "orders").select(c("o_orderkey").alias("id"), F.expr(SPEC).alias("spec"))
query("exp1_2_resolve_profile", lambda s, d: scoring.resolve_profile(specs(s, d)).select("id", F.round("anchor_x", 6).alias("anchor_x"), F.round("anchor_y", 6).alias("anchor_y"), "canvas_w", "canvas_h", "face_fill", c("weights")["sharpness"].alias("w_sharpness")),
      "WITH q AS (SELECT o_orderkey AS id FROM orders) SELECT id, CASE WHEN id % 5 = 0 THEN 0.667 ELSE round(least(1.0, id % 30 / 10.0), 6) END AS anchor_x, 0.333 AS anchor_y, CAST(round_even(least(4096, greatest(160, id % 5000 + 0.5)), 0) AS INT) AS canvas_w, 720 AS canvas_h, id % 3 <> 0 AS face_fill, CAST(greatest(0, id % 7 - 1) AS DOUBLE) AS w_sharpness FROM q")
query("exp3_resolve_weights", lambda s, d: scoring.resolve_profile(specs(s, d)).select("id", scoring.resolve_weights(c("weights")).alias("m")).select("id", *[F.round(c("m")[k], 6).alias(k) for k in scoring.WEIGHTS]),
      f"WITH q AS (SELECT o_orderkey AS id, greatest(0, o_orderkey % 7 - 1) AS s, o_orderkey % 4 AS m FROM orders) SELECT id, round(s / (s + m + 0.6), 6) AS sharpness, round(m / (s + m + 0.6), 6) AS motion_blur, " + ", ".join(f"round({scoring.WEIGHTS[k]} / (s + m + 0.6), 6) AS {k}" for k in ("left_space", "exposure", "reframability", "face_size")) + " FROM q")

# sampling plans
videos = lambda s, d: table(s, d, "videos")
query("src3_sample_plan_adaptive", lambda s, d: frames.sample_times(videos(s, d), frames.adaptive_interval(c("duration_s"))).groupBy("video_id").agg(F.count("*").alias("n"), near(F.max("ts_s"), 4).alias("last_s"), near(F.first("interval_s"), 6).alias("interval_s")),
      ctes("videos") + ", q AS (SELECT video_id, duration_s, greatest(0.3, least(duration_s / 200.0, 1.0)) AS i FROM videos WHERE duration_s > 0) SELECT video_id, CAST(greatest(1, ceil(duration_s / i)) AS BIGINT) AS n, round((greatest(1, ceil(duration_s / i)) - 1) * i + 1e-8, 4) AS last_s, round(i + 1e-8, 6) AS interval_s FROM q")
query("src4_sample_plan_capture", lambda s, d: videos(s, d).select("video_id", F.round(frames.capture_interval(c("duration_s"), 20), 6).alias("interval_s")),
      ctes("videos") + " SELECT video_id, round(CASE WHEN duration_s > 0 THEN greatest(0.3, least(duration_s / 60.0, 15.0)) ELSE 1.0 END, 6) AS interval_s FROM videos")
query("src5_dense_window", lambda s, d: frames.dense_window(table(s, d, "moments"), 2.0, 0.15).select("video_id", "slot", "k", F.round("at_s", 5).alias("at_s")),
      ctes("moments") + ", q AS (SELECT *, greatest(0.0, ts_s - 2.0) AS a FROM moments) SELECT video_id, slot, CAST(k AS INT) AS k, round(a + k * 0.15, 5) AS at_s FROM (SELECT *, unnest(range(CAST(floor((ts_s + 2.0 - a) / 0.15 + 1e-9) AS INT) + 1)) AS k FROM q)")
query("src6_resample_needed", lambda s, d: frames.resample_needed(videos(s, d).select("video_id", F.when(c("video_id") % 3 == 0, None).otherwise((c("video_id") % 4) / 4.0).alias("interval_s")), videos(s, d).where("video_id % 5 <> 0").select("video_id", ((c("video_id") % 8) / 8.0).alias("interval_s"))).select("video_id", "needed"),
      ctes("videos") + " SELECT video_id, CASE WHEN video_id % 5 = 0 THEN true WHEN video_id % 3 = 0 THEN false ELSE abs((video_id % 4) / 4.0 - (video_id % 8) / 8.0) > 1e-6 END AS needed FROM videos")
FILES = "SELECT l_orderkey % 50 AS video_id, concat('/x/', CASE WHEN l_linenumber % 2 = 0 THEN 'full' ELSE 'frame' END, '_', lpad(CAST(l_orderkey AS VARCHAR(20)), 4, '0'), '.jpg') AS path FROM (SELECT DISTINCT l_orderkey, l_linenumber % 2 AS l_linenumber FROM lineitem WHERE l_linenumber <= 3)"
files = lambda s, d: s.sql(FILES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(s, d, "lineitem"))
CATALOG = f"""WITH f AS ({FILES}), q AS (SELECT video_id, path, regexp_extract(path, '(frame|full)_', 1) AS variant, CAST(regexp_extract(path, '_([0-9]+)\\.', 1) AS INT) AS seq FROM f)"""
query("src1_frame_catalog", lambda s, d: frames.frame_catalog(files(s, d), F.lit(0.5)).select("video_id", "path", "variant", "seq", "position", "ts_s"),
      CATALOG + " SELECT *, row_number() OVER (PARTITION BY video_id, variant ORDER BY seq, path) - 1 AS position, (row_number() OVER (PARTITION BY video_id, variant ORDER BY seq, path) - 1) * 0.5 AS ts_s FROM q")
query("src2_pair_full_sibling", lambda s, d: frames.pair_full_sibling(frames.frame_catalog(files(s, d), F.lit(0.5))).select("video_id", "seq", "path", "full"),
      CATALOG + " SELECT a.video_id, a.seq, a.path, coalesce(b.path, a.path) AS full FROM q a LEFT JOIN q b ON a.video_id = b.video_id AND a.seq = b.seq AND b.variant = 'full' WHERE a.variant = 'frame'")
query("sel11_even_sample", lambda s, d: selection.even_sample(table(s, d, "grabs"), 30).select("video_id", "event_id"),
      ctes("grabs") + ", q AS (SELECT video_id, event_id, row_number() OVER (PARTITION BY video_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM grabs) SELECT video_id, event_id FROM q WHERE i % greatest(1, n // 30) = 0 AND i // greatest(1, n // 30) < 30")
query("sel11_even_sample_spread", lambda s, d: selection.even_sample(table(s, d, "grabs"), 24, "spread").select("video_id", "event_id"),
      ctes("grabs") + ", q AS (SELECT video_id, event_id, row_number() OVER (PARTITION BY video_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY video_id) AS n FROM grabs) SELECT DISTINCT q.video_id, event_id FROM q JOIN (SELECT DISTINCT video_id, n, unnest(range(24)) AS k FROM q) t ON q.video_id = t.video_id AND (q.i = k * q.n // 24 OR q.n <= 24)")
query("sel12_fixed_segments", lambda s, d: selection.fixed_segments(table(s, d, "grabs"), 6).select("video_id", "event_id", "segment"),
      ctes("grabs") + ", q AS (SELECT video_id, event_id, CAST((row_number() OVER (PARTITION BY video_id ORDER BY seq) - 1) // 6 AS INT) AS segment FROM grabs) SELECT video_id, event_id, segment FROM (SELECT *, count(*) OVER (PARTITION BY video_id, segment) AS n FROM q) WHERE n >= 3")
URLS = """SELECT page_id, CASE page_id % 7 WHEN 0 THEN concat('https://www.youtube.com/watch?a=1&v=id', CAST(page_id AS VARCHAR(20)), '&t=3') WHEN 1 THEN concat('https://youtu.be/x_', CAST(page_id AS VARCHAR(20)))
  WHEN 2 THEN concat('https://www.dropbox.com/scl/fi/ab', CAST(page_id AS VARCHAR(20)), '/f.mp4?rlkey=1&dl=0') WHEN 3 THEN concat('https://www.dropbox.com/sh/', CAST(page_id AS VARCHAR(20))) WHEN 4 THEN concat('https://drive.google.com/file/d/D', CAST(page_id AS VARCHAR(20)), '/view') ELSE url END AS link FROM pages"""
links = lambda s, d: s.sql(URLS.replace("FROM pages", "FROM {pages}"), pages=table(s, d, "pages"))
query("src7_classify_link", lambda s, d: links(s, d).select("page_id", frames.classify_link(c("link"))[0].alias("kind"), frames.classify_link(c("link"))[1].alias("stem")),
      f"""WITH q AS ({URLS}), k AS (SELECT *, nullif(regexp_extract(link, '/file/d/([a-zA-Z0-9_-]+)', 1), '') AS a, nullif(regexp_extract(link, 'id=([a-zA-Z0-9_-]+)', 1), '') AS b, nullif(regexp_extract(link, '^([a-zA-Z0-9_-]{{20,}})$', 1), '') AS e FROM q)
      SELECT page_id, CASE WHEN page_id % 7 < 2 THEN 'youtube' WHEN page_id % 7 < 4 THEN 'dropbox' WHEN coalesce(a, b, e) IS NOT NULL THEN 'drive' ELSE 'unknown' END AS kind,
      CASE page_id % 7 WHEN 0 THEN concat('id', page_id) WHEN 1 THEN concat('x_', page_id) WHEN 2 THEN concat('dropbox_ab', page_id) WHEN 3 THEN concat('dropbox_', substr(sha256(link), 1, 16)) ELSE coalesce(a, b, e) END AS stem FROM k""")
query("src8_direct_link", lambda s, d: links(s, d).select("page_id", frames.direct_link(c("link")).alias("direct")),
      f"""WITH q AS ({URLS}), k AS (SELECT page_id, regexp_extract(link, '^([^#]*)', 1) AS b, regexp_extract(link, '(#.*)$', 1) AS f FROM q)
      SELECT page_id, CASE WHEN regexp_matches(b, '[?&]dl=') THEN regexp_replace(b, '([?&]dl=)[^&]*', '\\1' || '1') WHEN contains(b, '?') THEN b || '&dl=1' ELSE b || '?dl=1' END || f AS direct FROM k""")
BLOBS = "SELECT concat('f', CAST(page_id AS VARCHAR(20)), CASE page_id % 4 WHEN 0 THEN '.MP4' WHEN 1 THEN '.mov' WHEN 2 THEN '.txt' ELSE '.webm' END) AS path, CASE WHEN page_id % 9 = 0 THEN '' ELSE concat('c', CAST(page_id % 40 AS VARCHAR(20))) END AS body FROM pages"
query("src9_content_address", lambda s, d: frames.content_address(s.sql(BLOBS.replace("FROM pages", "FROM {pages}"), pages=table(s, d, "pages")).select("path", c("body").cast("binary").alias("content"))),
      f"WITH q AS ({BLOBS}) SELECT concat('upload_', substr(sha256(body), 1, 16), '.', lower(regexp_extract(path, '\\.([^./]+)$', 1))) AS upload_id, min(path) AS path, count(*) AS copies FROM q WHERE body <> '' AND lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('mp4', 'mov', 'webm', 'mkv', 'avi') GROUP BY 1")
query("src10_valid_upload_id", lambda s, d: table(s, d, "pages").select("page_id", frames.valid_upload_id(F.expr("concat('upload_', substr(md5(url), 1, 14 + page_id % 4), if(page_id % 3 = 0, '.mp4', '.exe'))")).alias("valid")),
      "SELECT page_id, page_id % 4 = 2 AND page_id % 3 = 0 AND url IS NOT NULL AS valid FROM pages")
ARTIFACTS = "SELECT p_partkey AS size, concat(CASE p_partkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'frames_' WHEN 2 THEN 'vary_' WHEN 3 THEN 'eyes_' WHEN 4 THEN 'clean_' ELSE 'other_' END, 'v', CAST(p_partkey % 10 AS VARCHAR(20)), CASE WHEN p_partkey % 6 = 0 THEN '.mp4' WHEN p_partkey % 6 BETWEEN 2 AND 4 THEN '_12' ELSE '' END) AS name FROM part"
query("src15_retention_plan", lambda s, d: frames.retention_plan(s.sql(ARTIFACTS.replace("FROM part", "FROM {part}"), part=table(s, d, "part")), s.range(0, 4).selectExpr("concat('v', id) as stem")).select("name", "size"),
      f"WITH q AS ({ARTIFACTS}) SELECT name, size FROM q WHERE NOT EXISTS (SELECT 1 FROM range(4) r(i) WHERE split_part(name, '.', 1) = 'v' || i OR name = 'frames_v' || i OR starts_with(name, 'vary_v' || i || '_') OR starts_with(name, 'eyes_v' || i || '_') OR starts_with(name, 'clean_v' || i || '_'))")
