"""Queries over pixels, text boxes and overlays, with their SQL."""

from pyspark.sql import functions as F

from reelspan.operators import grading, matching, pixels as px, selection
from reelspan.plans.fixtures import ctes, table
from reelspan.plans.registry import query

c = F.col
pixel = lambda s, d: table(s, d, "pixel")
near = lambda v, n: F.round(v + 1e-8, n)
AROUND = """n AS (SELECT *, lag(gray) OVER r AS l, lead(gray) OVER r AS rt, lag(gray) OVER k AS u, lead(gray) OVER k AS dn FROM pixel
  WINDOW r AS (PARTITION BY video_id, seq, y ORDER BY x), k AS (PARTITION BY video_id, seq, x ORDER BY y)),
i AS (SELECT *, l IS NOT NULL AND rt IS NOT NULL AND u IS NOT NULL AND dn IS NOT NULL AS inside FROM n)"""
query("pix1_measure", lambda s, d: px.measure(pixel(s, d)).select("video_id", "seq", near(c("focus"), 3).alias("focus"), near(c("motion"), 5).alias("motion"), near(c("contrast"), 4).alias("contrast")),
      ctes("pixel") + f""", {AROUND}, m AS (SELECT video_id, seq, var_pop(l + rt + u + dn - 4 * gray) FILTER (inside) AS f, var_pop(rt - l) FILTER (inside) AS x, var_pop(dn - u) FILTER (inside) AS y, stddev_pop(gray) AS k FROM i GROUP BY 1, 2)
      SELECT video_id, seq, round(f + 1e-8, 3) AS focus, round(CASE WHEN x + y < 1e-6 THEN 0 ELSE least(x, y) / greatest(x, y) END + 1e-8, 5) AS motion, round(k + 1e-8, 4) AS contrast FROM m""")
query("pix5_edge_density", lambda s, d: px.edge_density(pixel(s, d), 30).select("video_id", "seq", near(c("density"), 6).alias("density"), near(c("luma"), 4).alias("luma")),
      ctes("pixel") + f", {AROUND} SELECT video_id, seq, round(avg(CASE WHEN sqrt((rt - l) ** 2 + (dn - u) ** 2) >= 30 THEN 1.0 ELSE 0.0 END) FILTER (inside) + 1e-8, 6) AS density, round(avg(gray) + 1e-8, 4) AS luma FROM i GROUP BY 1, 2")
query("pix8_noise_sigma", lambda s, d: px.noise_sigma(pixel(s, d)).select("video_id", "seq", near(c("sigma"), 5).alias("sigma"), near(c("severity"), 5).alias("severity")),
      ctes("pixel") + """, v AS (SELECT *, lag(gray) OVER k - 2 * gray + lead(gray) OVER k AS vv FROM pixel WINDOW k AS (PARTITION BY video_id, seq, x ORDER BY y)), h AS (SELECT *, abs(lag(vv) OVER r - 2 * vv + lead(vv) OVER r) AS a FROM v WINDOW r AS (PARTITION BY video_id, seq, y ORDER BY x)),
      g AS (SELECT video_id, seq, avg(a) * sqrt(pi() / 2) / 6 AS s FROM h GROUP BY 1, 2) SELECT video_id, seq, round(s + 1e-8, 5) AS sigma, round(greatest(0, least(1, s / 6)) + 1e-8, 5) AS severity FROM g""")
query("pix7_tone_stats", lambda s, d: px.tone_stats(pixel(s, d), 2, c("x") + 1.0).select("video_id", "seq", *[near(c(k), 4).alias(k) for k in ("p1", "p99", "mean", "deviation", "weighted")]),
      ctes("pixel") + " SELECT video_id, seq, round(quantile_cont(gray, 0.01) + 1e-8, 4) AS p1, round(quantile_cont(gray, 0.99) + 1e-8, 4) AS p99, round(avg(gray) + 1e-8, 4) AS mean, round(stddev_pop(gray) + 1e-8, 4) AS deviation, round(sum(gray * (x + 1.0)) / sum(x + 1.0) + 1e-8, 4) AS weighted FROM pixel WHERE x % 2 = 0 AND y % 2 = 0 GROUP BY 1, 2")
query("pix2_histogram", lambda s, d: px.gray_histogram(pixel(s, d)).select("video_id", "seq", "bin", near(c("share"), 6).alias("share")),
      ctes("pixel") + ", b AS (SELECT video_id, seq, CAST(floor(greatest(0, least(255, gray)) / 32) AS INT) AS bin, count(*) AS n FROM pixel GROUP BY 1, 2, 3) SELECT video_id, seq, bin, round(n / sqrt(sum(n * n) OVER (PARTITION BY video_id, seq)) + 1e-8, 6) AS share FROM b")
query("pix9_patch_correlation", lambda s, d: px.patch_correlation(pixel(s, d).where("seq % 2 = 0"), pixel(s, d).where("seq % 2 = 1").withColumn("seq", c("seq") - 1).select("seq", "y", "x", "gray"), ("seq",)).select("seq", near(c("r"), 5).alias("r")),
      ctes("pixel") + ", j AS (SELECT a.seq, a.gray AS g, b.gray AS o FROM pixel a JOIN pixel b ON a.seq % 2 = 0 AND b.seq = a.seq + 1 AND a.x = b.x AND a.y = b.y) SELECT seq, round(CASE WHEN count(*) < 16 OR stddev_pop(g) < 1e-6 OR stddev_pop(o) < 1e-6 THEN 0 ELSE corr(g, o) END + 1e-8, 5) AS r FROM j GROUP BY seq")
query("pix10_skin_share", lambda s, d: px.skin_share(pixel(s, d).withColumns({"cr": c("gray") + 10, "cb": 230 - c("gray")})).select("video_id", "seq", near(c("share"), 6).alias("share")),
      ctes("pixel") + " SELECT video_id, seq, round(avg(CASE WHEN gray + 10 BETWEEN 133 AND 173 AND 230 - gray BETWEEN 77 AND 127 THEN 1.0 ELSE 0.0 END) + 1e-8, 6) AS share FROM pixel GROUP BY 1, 2")
query("pix3_hist_similarity", lambda s, d: table(s, d, "embeddings").alias("a").join(table(s, d, "embeddings").alias("b"), c("b.vec_id") == c("a.vec_id") + 1).select(c("a.vec_id").alias("vec_id"), near(selection.pearson(c("a.embedding"), c("b.embedding")), 5).alias("r")),
      "WITH p AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(corr(x, y) + 1e-8, 5) AS r FROM p GROUP BY vec_id")
query("pix6_pose_diff", lambda s, d: table(s, d, "embeddings").alias("a").join(table(s, d, "embeddings").alias("b"), c("b.vec_id") == c("a.vec_id") + 1).select(c("a.vec_id").alias("vec_id"), near(px.mean_difference(c("a.embedding"), c("b.embedding")), 6).alias("diff")),
      "WITH p AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(avg(abs(x - y)) + 1e-8, 6) AS diff FROM p GROUP BY vec_id")
color = lambda s, d: table(s, d, "color")
STATS = """lm AS (SELECT *, 0.114::DOUBLE * b + 0.587::DOUBLE * g + 0.299::DOUBLE * r AS gray FROM color), an AS (SELECT *, lag(gray) OVER r AS lf, lead(gray) OVER r AS rt, lag(gray) OVER k AS up, lead(gray) OVER k AS dn FROM lm WINDOW r AS (PARTITION BY video_id, seq, y ORDER BY x), k AS (PARTITION BY video_id, seq, x ORDER BY y)),
cs AS (SELECT video_id, seq, quantile_cont(gray, 0.01) FILTER (x % 2 = 0 AND y % 2 = 0) AS p1, quantile_cont(gray, 0.99) FILTER (x % 2 = 0 AND y % 2 = 0) AS p99, stddev_pop(gray) FILTER (x % 2 = 0 AND y % 2 = 0) AS deviation,
  avg(CASE WHEN greatest(b, g, r) > 0 THEN (greatest(b, g, r) - least(b, g, r)) / greatest(b, g, r) ELSE 0 END) FILTER (x % 2 = 0 AND y % 2 = 0) AS saturation, sum(gray * (x + y)) / sum(x + y) AS subject,
  var_pop(coalesce(lf, rt) + coalesce(rt, lf) + coalesce(up, dn) + coalesce(dn, up) - 4 * gray) AS lap_var FROM an GROUP BY 1, 2)"""
query("pix7_color_stats", lambda s, d: px.color_stats(color(s, d), c("x") + c("y"), budget=16).select("video_id", "seq", *[near(c(k), 4).alias(k) for k in ("p1", "p99", "deviation", "saturation", "subject", "lap_var")]),
      ctes("color") + f", {STATS} SELECT video_id, seq, " + ", ".join(f"round({k} + 1e-8, 4) AS {k}" for k in ("p1", "p99", "deviation", "saturation", "subject", "lap_var")) + " FROM cs")
#: Eight pixels a side on a grid of five by three: no cell begins and ends with a pixel but the outermost.
query("pix6_pose_signature", lambda s, d: px.pose_signature(color(s, d), (5, 3)).select("video_id", "seq", F.posexplode("signature").alias("cell", "v")).select("video_id", "seq", "cell", near(c("v"), 4).alias("v")),
      ctes("color") + """, ov AS (SELECT p, k, n, greatest(0, least((p + 1) * n, (k + 1) * 8) - greatest(p * n, k * 8)) AS part FROM range(8) a(p), range(5) b(k), (VALUES (5), (3)) c(n) WHERE k < n),
      ce AS (SELECT video_id, seq, h.k AS cx, v.k AS cy, CAST(round_even(sum(b * h.part * v.part) / 64.0, 0) AS INT) AS b, CAST(round_even(sum(g * h.part * v.part) / 64.0, 0) AS INT) AS g, CAST(round_even(sum(r * h.part * v.part) / 64.0, 0) AS INT) AS r
        FROM color JOIN ov h ON h.p = x AND h.n = 5 AND h.part > 0 JOIN ov v ON v.p = y AND v.n = 3 AND v.part > 0 GROUP BY 1, 2, 3, 4), gr AS (SELECT *, (1868 * b + 9617 * g + 4899 * r + 8192) >> 14 AS v FROM ce)
      SELECT video_id, seq, CAST(cy * 5 + cx AS INT) AS cell, round((v - avg(v) OVER f) / (stddev_pop(v) OVER f + 1e-6) + 1e-8, 4) AS v FROM gr WINDOW f AS (PARTITION BY video_id, seq)""")
chests = lambda s, d: table(s, d, "chests")
query("pix6_outfit_signature", lambda s, d: px.outfit_signature(color(s, d), chests(s, d)).select("video_id", "seq", "face_id", F.posexplode_outer(F.filter(F.transform("outfit", lambda v, k: F.struct(k.alias("bin"), v.alias("v"))), lambda e: e["v"] > 0)).alias("k", "e")).select("video_id", "seq", "face_id", c("e.bin").alias("bin"), near(c("e.v"), 6).alias("share")),
      ctes("color", "chests") + """, bx AS (SELECT *, x + w // 2 - CAST(floor(1.1 * w) AS INT) AS x1, x + w // 2 + CAST(floor(1.1 * w) AS INT) AS x2, y + CAST(floor(1.15 * h) AS INT) AS y1, y + CAST(floor(2.2 * h) AS INT) AS y2 FROM chests),
      hi AS (SELECT c.video_id, c.seq, face_id, b // 32 * 64 + g // 32 * 8 + r // 32 AS bin, count(*) AS n FROM color c JOIN bx ON bx.video_id = c.video_id AND bx.seq = c.seq AND c.x >= x1 AND c.x < x2 AND c.y >= y1 AND c.y < y2 GROUP BY ALL),
      nm AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY video_id, seq, face_id)) AS share FROM hi)
      SELECT f.video_id, f.seq, f.face_id, CAST(bin AS INT) AS bin, round(share + 1e-8, 6) AS share FROM chests f LEFT JOIN nm USING (video_id, seq, face_id)""")


def looks(s, d):
    """Frames by nines, the first of which is the origin of the others, with pose and outfit from their pixels."""
    seen = px.pose_signature(color(s, d)).join(px.outfit_signature(color(s, d), chests(s, d)), ["video_id", "seq"])
    return seen.select(F.floor(c("seq") / 9).alias("origin"), c("seq").alias("path"), (c("seq") % 9).cast("int").alias("place"), "signature", "outfit")


query("sel10_by_pixels", lambda s, d: selection.by_distinctness(looks(s, d).where("place > 0"), looks(s, d).where("place = 0").drop("path", "place")))
BYTE = "lpad(hex(CAST(greatest(0, least(255, floor(128 + 127 * CAST(embedding[(p + {k}) % size(embedding)] AS DOUBLE)))) AS INT)), 2, '0')"
DATA = f"unhex(concat_ws('', transform(sequence(0, size(embedding) - 1), p -> concat({', '.join(BYTE.replace('{k}', str(k)) for k in (0, 1, 5))}))))"
images = lambda s, d: table(s, d, "embeddings").select(c("label").cast("long").alias("video_id"), c("vec_id").alias("seq"), F.expr("CAST(size(embedding) / 8 AS INT)").alias("height"), F.lit(8).alias("width"), F.expr(DATA).alias("data"))
query("pix4_color_histogram", lambda s, d: px.color_histograms(images(s, d), described=False).select("video_id", "seq", F.posexplode("hist").alias("bin", "share")).where("share > 0").select("video_id", "seq", "bin", F.round(c("share").cast("double"), 5).alias("share")),
      ctes("color") + ", hi AS (SELECT video_id, seq, b // 32 * 64 + g // 32 * 8 + r // 32 AS bin, count(*) AS n FROM color GROUP BY ALL) SELECT video_id, seq, CAST(bin AS INT) AS bin, round(CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY video_id, seq)) AS FLOAT) AS DOUBLE), 5) AS share FROM hi")
query("pix4_face_descriptor", lambda s, d: px.color_histograms(images(s, d)))

# overlays: the segments of a video are its frames in sixes
samples = lambda s, d: pixel(s, d).withColumn("segment", (c("seq") % 3).cast("int"))
STATIC = """s0 AS (SELECT *, CAST(seq % 3 AS INT) AS segment FROM pixel), md AS (SELECT video_id, segment, y, x, median(gray) AS med FROM s0 GROUP BY ALL),
st AS (SELECT video_id, segment, y, x, med, median(abs(gray - med)) AS dev FROM s0 JOIN md USING (video_id, segment, y, x) GROUP BY ALL)"""
query("agg3_static_pixels", lambda s, d: px.static_pixels(samples(s, d), 10).select("video_id", "segment", "y", "x", near(c("median"), 4).alias("median"), near(c("deviation"), 4).alias("deviation"), "static"),
      ctes("pixel") + f", {STATIC} SELECT video_id, segment, y, x, round(med + 1e-8, 4) AS median, round(dev + 1e-8, 4) AS deviation, dev < 10 AS static FROM st")
query("agg4_segment_staticness", lambda s, d: px.segment_staticness(px.static_pixels(samples(s, d), 10)).select("video_id", "segment", near(c("share"), 6).alias("share"), "fallback"),
      ctes("pixel") + f", {STATIC}, sh AS (SELECT video_id, segment, avg(CASE WHEN dev < 10 THEN 1.0 ELSE 0.0 END) AS share FROM st GROUP BY 1, 2) SELECT video_id, segment, round(share + 1e-8, 6) AS share, share > 0.2 AND max(CASE WHEN share <= 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id) = 0 AS fallback FROM sh")
query("agg5_content_bounds", lambda s, d: px.content_bounds(pixel(s, d).groupBy("video_id", "x").agg(F.avg(F.abs(c("gray") - 128) * (c("x") % 5)).alias("energy"))),
      ctes("pixel") + """, e AS (SELECT video_id, x, avg(abs(gray - 128) * (x % 5)) AS energy FROM pixel GROUP BY 1, 2), q AS (SELECT *, quantile_cont(energy, 0.9) OVER (PARTITION BY video_id) * 0.35 AS lim, max(x) OVER (PARTITION BY video_id) + 1 AS w FROM e),
      b AS (SELECT video_id, min(x) FILTER (energy >= lim) AS a, max(x) FILTER (energy >= lim) AS b, max(w) AS w FROM q GROUP BY 1) SELECT video_id, CASE WHEN (b - a + 1) / w BETWEEN 0.25 AND 0.97 THEN a ELSE 0 END AS first, CASE WHEN (b - a + 1) / w BETWEEN 0.25 AND 0.97 THEN b ELSE w - 1 END AS last FROM b""")
boxes = lambda s, d: table(s, d, "text_boxes")
query("agg7_text_row_presence", lambda s, d: px.text_rows(boxes(s, d)),
      ctes("text_boxes") + ", r AS (SELECT DISTINCT video_id, seq, unnest(range(greatest(0, y), least(719, y + h - 1) + 1)) AS row FROM text_boxes), f AS (SELECT video_id, count(DISTINCT seq) AS frames FROM text_boxes GROUP BY 1) SELECT r.video_id, CAST(r.row AS INT) AS row, count(*) AS hits, any_value(frames) AS frames FROM r JOIN f USING (video_id) GROUP BY 1, 2")
query("agg8_detect_bands", lambda s, d: px.detect_bands(px.text_spans(boxes(s, d))))
FIRST = """r AS (SELECT DISTINCT video_id, seq, unnest(range(greatest(0, y), least(719, y + h - 1) + 1)) AS row FROM text_boxes), f AS (SELECT video_id, count(DISTINCT seq) AS frames FROM text_boxes GROUP BY 1),
t AS (SELECT r.video_id, r.row, count(*) AS hits, any_value(frames) AS frames FROM r JOIN f USING (video_id) GROUP BY 1, 2),
p AS (SELECT *, max(hits) OVER (PARTITION BY video_id) AS top FROM t), k AS (SELECT *, min(CASE WHEN hits = top THEN row END) OVER (PARTITION BY video_id) AS peak FROM p),
o AS (SELECT *, row - row_number() OVER (PARTITION BY video_id ORDER BY row) AS i FROM k WHERE top >= 0.3 * frames AND hits >= greatest(0.25 * frames, 0.7 * top)),
g AS (SELECT video_id, i, min(row) AS first, max(row) AS last, any_value(peak) AS peak, any_value(top) AS hits FROM o GROUP BY 1, 2),
band AS (SELECT video_id, first, last, hits FROM g WHERE peak BETWEEN first AND last)"""
query("agg8_first_band", lambda s, d: px.first_band_rows(px.text_spans(boxes(s, d))), ctes("text_boxes") + f", {FIRST} SELECT video_id, CAST(first AS INT) AS first, CAST(last AS INT) AS last, hits FROM band")
bands = lambda s, d: px.first_band_rows(px.text_spans(boxes(s, d))).select("video_id", (c("first") / 720).alias("top"), ((c("last") + 1) / 720).alias("bottom"))
query("join5_text_in_bands", lambda s, d: matching.text_in_bands(boxes(s, d), bands(s, d)), ctes("text_boxes") + f", {FIRST} SELECT * FROM text_boxes b WHERE EXISTS (SELECT 1 FROM band k WHERE k.video_id = b.video_id AND (y + h / 2.0) / 720 BETWEEN first / 720.0::DOUBLE AND (last + 1) / 720.0::DOUBLE)")
query("agg9_merge_boxes", lambda s, d: px.merge_boxes(boxes(s, d)))
blobs = lambda s, d: boxes(s, d).select("video_id", c("seq").cast("int").alias("segment"), (c("x") / 1000).alias("x"), (c("y") / 720).alias("y"), (c("w") / 1500).alias("w"), (c("h") / 720).alias("h"), (c("w") / 1500 * c("h") / 720).alias("area"), ((c("x") % 100) / 100).alias("fill"), (c("y") % 90).cast("double").alias("energy"))
BLOBS = "bl AS (SELECT video_id, CAST(seq AS INT) AS segment, x / 1000.0::DOUBLE AS x, y / 720.0::DOUBLE AS y, w / 1500.0::DOUBLE AS w, h / 720.0::DOUBLE AS h, w / 1500.0::DOUBLE * h / 720.0::DOUBLE AS area, (x % 100) / 100.0::DOUBLE AS fill, CAST(y % 90 AS DOUBLE) AS energy FROM text_boxes)"
query("agg10_cluster_blobs", lambda s, d: px.cluster_blobs(blobs(s, d), 3.0))
query("agg11_overlay_candidates", lambda s, d: px.overlay_candidates(blobs(s, d)).select("video_id", "segment", near(c("x"), 6).alias("x"), near(c("y"), 6).alias("y"), near(c("area"), 8).alias("area")),
      ctes("text_boxes") + f", {BLOBS}, k AS (SELECT *, row_number() OVER (PARTITION BY video_id, segment ORDER BY area DESC, y, x, w, h) AS r FROM bl WHERE area >= 0.002 AND (x < 0.10 OR x + w > 0.90) AND fill >= 0.25 AND energy >= 20) SELECT video_id, segment, round(x + 1e-8, 6) AS x, round(y + 1e-8, 6) AS y, round(area + 1e-8, 8) AS area FROM k WHERE r = 1")
faces = lambda s, d: table(s, d, "faces")
query("agg6_face_territory", lambda s, d: px.face_territory(faces(s, d).select("video_id", "seq", "x", "y", "w", "h"), faces(s, d).where("face_id = 1").groupBy("video_id").agg(F.min("x").alias("x"), F.min("y").alias("y")).select("video_id", F.lit(1).alias("overlay_id"), "x", "y", F.lit(300).alias("w"), F.lit(200).alias("h")), 40, 0.2).select("video_id", "overlay_id", near(c("territory"), 6).alias("territory"), "reject"),
      ctes("faces") + """, fc AS (SELECT DISTINCT video_id, seq, cx, unnest(range(y // 40, (y + h - 1) // 40 + 1)) AS cy FROM (SELECT *, unnest(range(x // 40, (x + w - 1) // 40 + 1)) AS cx FROM faces)), fr AS (SELECT video_id, count(DISTINCT seq) AS n FROM faces GROUP BY 1),
      ofn AS (SELECT video_id, cx, cy FROM fc JOIN fr USING (video_id) GROUP BY video_id, cx, cy, n HAVING count(DISTINCT seq) >= 0.2 * n), ca AS (SELECT video_id, min(x) AS x, min(y) AS y FROM faces WHERE face_id = 1 GROUP BY 1),
      cc AS (SELECT video_id, cx, unnest(range(y // 40, (y + 199) // 40 + 1)) AS cy FROM (SELECT *, unnest(range(x // 40, (x + 299) // 40 + 1)) AS cx FROM ca)),
      t AS (SELECT cc.video_id, avg(CASE WHEN ofn.cx IS NULL THEN 0.0 ELSE 1.0 END) AS t FROM cc LEFT JOIN ofn ON cc.video_id = ofn.video_id AND cc.cx = ofn.cx AND cc.cy = ofn.cy GROUP BY 1) SELECT video_id, 1 AS overlay_id, round(t + 1e-8, 6) AS territory, t > 0.03 AS reject FROM t""")
pairs = lambda s, d: faces(s, d).select("video_id", "seq", "face_id", F.struct("x", "y", "w", "h").alias("a"), F.struct((c("x") + 20).alias("x"), (c("y") + 10).alias("y"), "w", "h").alias("b"))
query("agg12_iou", lambda s, d: pairs(s, d).select("video_id", "seq", "face_id", near(px.iou("a", "b"), 6).alias("iou")),
      ctes("faces") + " SELECT video_id, seq, face_id, round(greatest(0, w - 20) * greatest(0, h - 10) / (2.0 * w * h - greatest(0, w - 20) * greatest(0, h - 10)) + 1e-8, 6) AS iou FROM faces")
#: Forty vectors are the segments of a video, each a band of eight rows.
detections = lambda s, d: table(s, d, "embeddings").select(F.floor(c("vec_id") / 40).alias("video_id"), (c("vec_id") % 40).cast("int").alias("segment"), (c("label") % 3).cast("int").alias("x"), (c("label") % 2).cast("int").alias("y"), F.lit(5).alias("w"), F.lit(6).alias("h"), c("embedding").alias("median"), F.transform("embedding", lambda v: F.abs(v) < 0.2).alias("static"), F.floor(F.size("embedding") / 8).cast("int").alias("band_w"))
query("agg12_group_overlays", lambda s, d: px.group_overlays(detections(s, d)))
query("join6_overlays_present", lambda s, d: matching.overlays_present(pixel(s, d), px.static_pixels(pixel(s, d).withColumn("segment", F.lit(0))).select("video_id", F.lit(1).alias("overlay_id"), "y", "x", c("median").alias("reference")), 0.4).select("video_id", "seq", near(c("r"), 5).alias("r")),
      ctes("pixel") + ", o AS (SELECT video_id, y, x, median(gray) AS ref FROM pixel GROUP BY ALL), j AS (SELECT p.video_id, p.seq, corr(gray, ref) AS r, stddev_pop(gray) AS a, stddev_pop(ref) AS b FROM pixel p JOIN o USING (video_id, y, x) GROUP BY 1, 2) SELECT video_id, seq, round(r + 1e-8, 5) AS r FROM j WHERE a >= 1e-6 AND b >= 1e-6 AND r >= 0.4")
GRADED = ["black_push", "white_point", "shadow_lift", "flatten", "contrast", "brightness", "saturation_factor", "clarity", "sharpen"]
query("exp22_grade_parameters", lambda s, d: grading.at_intensity(grading.grade_parameters(px.color_stats(color(s, d), c("x") + c("y"), budget=16).withColumn("detail", F.round("detail", 6))), 1.5).select("video_id", "seq", *[near(c(k), 4).alias(k) for k in GRADED if k != "clarity"]),
      ctes("color") + f", {STATS}" + """, t AS (SELECT video_id, seq, p1, p99, deviation AS dev, subject AS sub, saturation AS sat, lap_var AS lap FROM cs),
      g AS (SELECT *, least(4, p1 * 0.8) AS b, greatest(0, 14 - 15 * (sub - 128) / 128) AS w, 22 * greatest(0, least(1, (40 - p1) / 36)) AS l, 30 * greatest(0, least(1, (p99 - 150) / 80)) AS f,
        CASE WHEN dev < 1e-3 THEN 1.6 ELSE greatest(1, least(1.6, 1 + 0.15 * 47.2 / dev)) END AS k, CASE WHEN sub < 1e-3 THEN 0 ELSE greatest(-76.5, least(0, -7.65 * sub / 83.4)) END AS br, CASE WHEN sat < 1e-3 THEN 2.0 ELSE greatest(1, least(2, 1 + 0.1 * 0.332 / sat)) END AS sf FROM t)
      SELECT video_id, seq, round(CASE WHEN b >= 0 THEN least(b * 1.5, 45) ELSE greatest(b * 1.5, -45) END + 1e-8, 4) AS black_push, round(least(w * 1.5, 60) + 1e-8, 4) AS white_point, round(least(l * 1.5, 60) + 1e-8, 4) AS shadow_lift, round(least(f * 1.5, 60) + 1e-8, 4) AS flatten,
        round(least(1 + (k - 1) * 1.5, 1.6) + 1e-8, 4) AS contrast, round(greatest(br * 1.5, -76.5) + 1e-8, 4) AS brightness, round(least(1 + (sf - 1) * 1.5, 2) + 1e-8, 4) AS saturation_factor,
        round(CASE WHEN lap < 1e-3 THEN 0.55 ELSE greatest(0.1, least(0.55, 0.275 * 10.8 / lap)) END + 1e-8, 4) AS sharpen FROM g""")
