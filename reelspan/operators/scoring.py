"""Score expressions: columns in, columns out; every one stays in generated code."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the six criteria, canvas and framing defaults with their ranges.
WEIGHTS = {"sharpness": 0.28, "left_space": 0.22, "exposure": 0.15, "reframability": 0.13, "motion_blur": 0.12, "face_size": 0.10}
DEFAULTS = {"face_area_ratio": 1 / 6, "anchor_x": 0.667, "anchor_y": 0.333, "min_text_space": 0.12, "canvas_w": 1280, "canvas_h": 720}
RANGES = {"face_area_ratio": (1 / 400, 1 / 2), "anchor_x": (0.0, 1.0), "anchor_y": (0.0, 1.0), "min_text_space": (0.0, 0.45), "canvas_w": (160, 4096), "canvas_h": (160, 4096)}
SHARP, RELAXED = 20.0, 8.0


def clamp(value: Column, low: float, high: float, fallback: float) -> Column:
    """value within [low, high]; fallback where it isn't a number or is NaN."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(float(fallback))).otherwise(F.greatest(F.lit(float(low)), F.least(number, F.lit(float(high)))))


def clamp_int(value: Column, low: float, high: float, fallback: float) -> Column:
    return F.bround(clamp(value, low, high, fallback), 0).cast("int")


def resolve_profile(packs: DataFrame, spec: str = "spec") -> DataFrame:
    """(…, spec JSON) -> one clamped column per setting, face_fill and the non-negative weights that are numbers."""
    part = lambda k: F.get_json_object(spec, f"$.{k}")
    number = [clamp(part(k), *RANGES[k], DEFAULTS[k]).alias(k) for k in ("face_area_ratio", "anchor_x", "anchor_y", "min_text_space")]
    pixels = [clamp_int(part(k), *RANGES[k], DEFAULTS[k]).alias(k) for k in ("canvas_w", "canvas_h")]
    weights = F.expr(f"transform_values(map_filter(from_json(get_json_object({spec}, '$.weights'), 'map<string,string>'), (k, v) -> try_cast(v as double) is not null), (k, v) -> greatest(0D, cast(v as double)))")
    return packs.select("*", *number, *pixels, (~F.coalesce(part("face_fill") == "false", F.lit(False))).alias("face_fill"), weights.alias("weights"))


def resolve_weights(overrides: Column) -> Column:
    """Known criteria overridden and scaled to sum 1; all zero, or nothing, leaves the defaults."""
    base = F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    merged = F.map_zip_with(base, F.coalesce(overrides, F.create_map().cast("map<string,double>")), lambda k, a, b: F.when(a.isNotNull(), F.coalesce(b, a)))
    merged = F.map_filter(merged, lambda k, v: v.isNotNull())
    total = F.aggregate(F.map_values(merged), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform_values(merged, lambda k, v: v / total)).otherwise(base)


def sharpness_score(s: Column) -> Column:
    return F.least(s / 300.0, F.lit(1.0))


def face_size_score(w: Column, h: Column, frame_w: Column, frame_h: Column) -> Column:
    return F.least((w * h) / (frame_w * frame_h) / 0.25, F.lit(1.0))


def exposure_score(mean: Column) -> Column:
    return F.when(mean.isNull(), 0.5).when(mean.between(80, 190), 1.0).when(mean < 80, F.greatest(F.lit(0.0), mean / 80.0)).otherwise(F.greatest(F.lit(0.0), (255.0 - mean) / 65.0))


def left_space_score(density: Column, valid: Column) -> Column:
    """0 where the framing is invalid, 0.5 where the text area is empty (null density)."""
    return F.when(~valid, 0.0).when(density.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1.0 - density * 5.0))


def motion_ratio(var_x: Column, var_y: Column) -> Column:
    return F.when(var_x + var_y < 1e-6, 0.0).otherwise(F.least(var_x, var_y) / F.greatest(var_x, var_y))


def compute_scale(w: Column, h: Column, frame_w: Column, frame_h: Column, face_count: Column, p: dict = DEFAULTS) -> Column:
    cover = F.greatest(F.lit(float(p["canvas_w"])) / frame_w, F.lit(float(p["canvas_h"])) / frame_h)
    face = F.sqrt(F.lit(p["face_area_ratio"] * p["canvas_w"] * p["canvas_h"]) / (w * h))
    return F.when((face_count == 1) & (w * h > 0), F.greatest(face, cover)).otherwise(cover)


def add_framing(faces: DataFrame, p: dict = DEFAULTS) -> DataFrame:
    """faces (x, y, w, h, frame_w, frame_h, face_count) plus a framing struct: scale, crop, ideal crop, face place, valid."""
    c, cw, ch = F.col, float(p["canvas_w"]), float(p["canvas_h"])
    out = faces.withColumn("_s", compute_scale(c("w"), c("h"), c("frame_w"), c("frame_h"), c("face_count"), p))
    out = out.withColumns({"_cx": (c("x") + c("w") / 2.0) * c("_s"), "_cy": (c("y") + c("h") / 2.0) * c("_s")})
    out = out.withColumns({"_ix": c("_cx") - cw * p["anchor_x"], "_iy": c("_cy") - ch * p["anchor_y"]})
    out = out.withColumns({"_x": F.greatest(F.lit(0.0), F.least(c("_ix"), c("frame_w") * c("_s") - cw)), "_y": F.greatest(F.lit(0.0), F.least(c("_iy"), c("frame_h") * c("_s") - ch))})
    space = (c("_cx") - c("_x") - c("w") * c("_s") / 2.0) / cw
    framing = F.struct(
        c("_s").alias("scale"), (c("frame_w") * c("_s")).alias("scaled_w"), (c("frame_h") * c("_s")).alias("scaled_h"), c("_x").alias("crop_x"), c("_y").alias("crop_y"),
        c("_ix").alias("ideal_x"), c("_iy").alias("ideal_y"), c("_cx").alias("face_cx"), c("_cy").alias("face_cy"), space.alias("text_space"), (space >= p["min_text_space"]).alias("valid"),
    )
    return out.withColumn("framing", framing).drop("_s", "_cx", "_cy", "_ix", "_iy", "_x", "_y")


def geometry(p: dict = DEFAULTS) -> list[Column]:
    """Whole pixels: size truncated, crop rounded half to even and clamped again."""
    c = lambda k: F.col(f"framing.{k}")
    w, h = c("scaled_w").cast("int"), c("scaled_h").cast("int")
    at = lambda v, size, side: F.greatest(F.lit(0), F.least(F.bround(v, 0).cast("int"), size - F.lit(int(side))))
    return [w.alias("scaled_w"), h.alias("scaled_h"), at(c("crop_x"), w, p["canvas_w"]).alias("crop_x"), at(c("crop_y"), h, p["canvas_h"]).alias("crop_y")]


def reframability_score(p: dict = DEFAULTS) -> Column:
    c = lambda k: F.col(f"framing.{k}")
    drift = (F.abs(c("crop_x") - c("ideal_x")) / float(p["canvas_w"]) + F.abs(c("crop_y") - c("ideal_y")) / float(p["canvas_h"])) / 2.0
    return F.greatest(F.lit(0.0), 1.0 - drift * 3.0)


def face_fill_penalty(w: Column, h: Column, scale: Column, p: dict = DEFAULTS, face_fill: bool = True) -> Column:
    if not face_fill:
        return F.lit(1.0)
    relative = (w * scale) * (h * scale) / (p["canvas_w"] * p["canvas_h"]) / p["face_area_ratio"]
    return F.when(relative <= 1.5, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (relative - 1.5) / 1.5))


def add_score(faces: DataFrame, p: dict = DEFAULTS, weights: dict = WEIGHTS) -> DataFrame:
    """faces plus framing, the seven parts, score = weighted sum times penalty, and sharp label."""
    c = F.col
    out = add_framing(faces, p).withColumns({
        "face_size": face_size_score(c("w"), c("h"), c("frame_w"), c("frame_h")), "sharpness_part": sharpness_score(c("sharpness")), "motion_blur": motion_ratio(c("var_x"), c("var_y")),
        "exposure": exposure_score(c("mean_luma")), "left_space": left_space_score(c("edge_density"), c("framing.valid")), "reframability": reframability_score(p),
        "penalty": face_fill_penalty(c("w"), c("h"), c("framing.scale"), p),
    })
    parts = {"face_size": "face_size", "sharpness": "sharpness_part", "motion_blur": "motion_blur", "exposure": "exposure", "left_space": "left_space", "reframability": "reframability"}
    total = sum((c(col) * weights[k] for k, col in parts.items()), F.lit(0.0))
    return out.withColumn("score", total * c("penalty")).withColumn("sharp", sharp_label(c("sharpness")))


def sharp_label(s: Column) -> Column:
    """strict, relaxed or null (rejected): one scan at the lower floor, the label tells the two apart."""
    return F.when(s >= SHARP, "strict").when(s >= RELAXED, "relaxed")


def eyes_plausible(w: Column, h: Column, eyes: Column, band: Column) -> Column:
    """Two largest eye boxes at opposite halves and like heights of a face that isn't a profile."""
    by_area = F.array_sort(eyes, lambda a, b: F.coalesce(F.nullif(b["w"] * b["h"] - a["w"] * a["h"], F.lit(0)), F.lit(0)).cast("int"))
    a, b = by_area[0], by_area[1]
    gap_x = F.abs((a["x"] + a["w"] / 2.0) - (b["x"] + b["w"] / 2.0)) / w
    gap_y = F.abs((a["y"] + a["h"] / 2.0) - (b["y"] + b["h"] / 2.0)) / band
    return F.when(w / h < 0.60, False).when((F.size(eyes) < 2) | (band <= 0), False).otherwise((gap_x >= 0.25) & (gap_y <= 0.20))


def usable_faces(faces: DataFrame, eyes: Column, floor: float = SHARP) -> DataFrame:
    """faces (w, h, sharpness) that are sharp enough and whose eyes (an array of boxes found in the upper part of the face) are open; the costly test
    is for those that pass the cheap one."""
    return faces.where(F.col("sharpness") >= floor).where(eyes_plausible(F.col("w"), F.col("h"), eyes, F.floor(F.col("h") * 0.55)))


def eye_state(has_face: Column, plausible: Column) -> Column:
    return F.when(~has_face, "no-face").when(plausible, "open").otherwise("shut")


def grab_score(focus: Column, motion: Column, contrast: Column) -> Column:
    return 0.60 * F.least(focus / 400.0, F.lit(1.0)) + 0.25 * motion + 0.15 * F.least(contrast / 60.0, F.lit(1.0))


def face_damage(focus: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (0.060 - focus) / 0.040))


def box_scale(factor: float) -> list[Column]:
    return [F.bround(F.col(k) * factor, 0).cast("int").alias(k) for k in "xywh"]


def box_expand(factor: float, least: int = 0) -> list[Column]:
    """Corners of the box grown around its centre, at least `least` a side, clipped to the frame."""
    out = []
    for at, side, frame, names in (("x", "w", "frame_w", ("x1", "x2")), ("y", "h", "frame_h", ("y1", "y2"))):
        middle, half = F.col(at) + F.col(side) / 2.0, F.greatest(F.col(side) * factor, F.lit(float(least))) / 2.0
        out += [F.greatest(F.lit(0), F.bround(middle - half, 0).cast("int")).alias(names[0]), F.least(F.col(frame), F.bround(middle + half, 0).cast("int")).alias(names[1])]
    return out


def face_region() -> list[Column]:
    """Corners of the face box padded by a third of its larger side and clipped; the whole frame where nothing is left."""
    c = F.col
    pad = (F.greatest("w", "h") / 3.0).cast("int")
    x1, y1 = F.greatest(F.lit(0), c("x") - pad), F.greatest(F.lit(0), c("y") - pad)
    x2, y2 = F.least(c("frame_w"), c("x") + c("w") + pad), F.least(c("frame_h"), c("y") + c("h") + pad)
    full = (x2 > x1) & (y2 > y1)
    return [F.when(full, v).otherwise(e).alias(n) for v, e, n in ((x1, F.lit(0), "x1"), (y1, F.lit(0), "y1"), (x2, c("frame_w"), "x2"), (y2, c("frame_h"), "y2"))]


def full_to_cropped(boxes: DataFrame, top: float = 0.08, bottom: float = 0.24) -> DataFrame:
    """Boxes of full frames in the space of frames whose top and bottom bands are cut away; boxes wholly cut away go."""
    above = (F.col("frame_h") * top).cast("int")
    left = (F.col("frame_h") * (1 - bottom)).cast("int") - above
    y1, y2 = F.greatest(F.lit(0), F.col("y") - above), F.least(left, F.col("y") + F.col("h") - above)
    return boxes.where(y2 > y1).withColumns({"cropped_y": y1, "cropped_h": y2 - y1})


def band_rows(top: Column, bottom: Column, height: Column, full: Column, cut_top: float = 0.08, cut_bottom: float = 0.24) -> list[Column]:
    """Fractions of the full frame as pixel rows, of full frames or of cropped ones of that height."""
    share = 1 - cut_top - cut_bottom
    cut = lambda v: ((v - cut_top) / share * height).cast("int")
    first = F.when(full, (top * height).cast("int")).otherwise(F.greatest(F.lit(0), cut(top)))
    last = F.when(full, (bottom * height).cast("int")).otherwise(F.least(height, cut(bottom)))
    return [first.alias("row_top"), last.alias("row_bottom")]


def unletterbox(boxes: DataFrame, scale: str = "scale", pad_x: str = "pad_x", pad_y: str = "pad_y") -> DataFrame:
    """Network-space boxes back in image pixels, clipped; empty ones go."""
    c = F.col
    x1, y1 = F.greatest(F.lit(0), ((c("x") - c(pad_x)) / c(scale)).cast("int")), F.greatest(F.lit(0), ((c("y") - c(pad_y)) / c(scale)).cast("int"))
    x2 = F.least(c("frame_w"), F.bround((c("x") + c("w") - c(pad_x)) / c(scale), 0).cast("int"))
    y2 = F.least(c("frame_h"), F.bround((c("y") + c("h") - c(pad_y)) / c(scale), 0).cast("int"))
    return boxes.select(*[c for c in boxes.columns if c not in "xywh"], x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h")).where("w > 0 and h > 0")


def centred_subject(w: Column, h: Column, p: dict = DEFAULTS) -> Column:
    """Stand-in box of frames without a face, placed where the anchor gives a centred crop."""
    cw, ch = float(p["canvas_w"]), float(p["canvas_h"])
    scale = F.greatest(F.lit(cw) / w, F.lit(ch) / h)
    place = lambda side, canvas, anchor: (((side * scale - canvas) / 2 + canvas * anchor) / scale).cast("int")
    return F.struct(place(w, cw, p["anchor_x"]).alias("x"), place(h, ch, p["anchor_y"]).alias("y"), F.lit(1).alias("w"), F.lit(1).alias("h"))
