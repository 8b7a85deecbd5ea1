"""Vectors of a video without one group for it: clusters by sums and rounds, near pairs by hashing, and the greedy answer over them."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspan.functions.shared import kept
from reelspan.operators.selection import cosine, deduplicate_large, measure

#: Rows that are projected in one group, partial sums that are added in one, leading components, clusters at most and faces of one.
BLOCK, FAN, PARTS, MOST, FACES = 5_000, 64, 30, 8, 25
#: Hash tables and bits of each: at a cosine of 0.95 a pair meets in one of the tables with a chance of 0.997.
TABLES, BITS = 24, 14


def _sums(batches):
    """Of the rows that a task has read: how many, sum and Gram matrix for each video."""
    total: dict = {}
    for batch in batches:
        video = batch.column(0).to_numpy(zero_copy_only=False)
        x = np.array(batch.column(1).to_pylist(), "f8").reshape(len(video), -1)
        for v in np.unique(video):
            own = x[video == v]
            n, s, g = total.get(v, (0, 0.0, 0.0))
            total[v] = n + len(own), s + own.sum(0), g + own.T @ own
    for v, (n, s, g) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([int(v)]), pa.array([n]), pa.array([s.tobytes()], pa.binary()), pa.array([g.tobytes()], pa.binary())], ["video_id", "n", "total", "gram"])


_PARTIAL = "video_id long, n long, total binary, gram binary"


def _added(group: pd.DataFrame) -> pd.DataFrame:
    add = lambda k: sum(np.frombuffer(b) for b in group[k]).tobytes()
    return pd.DataFrame({"video_id": group["video_id"].iloc[:1], "n": [int(group["n"].sum())], "total": [add("total")], "gram": [add("gram")]})


def _axes(group: pd.DataFrame) -> pd.DataFrame:
    """Mean and leading components of a video from its sums."""
    n, total = int(group["n"].sum()), sum(np.frombuffer(b) for b in group["total"])
    mean = total / n
    spread = sum(np.frombuffer(b) for b in group["gram"]).reshape(len(mean), -1) - n * np.outer(mean, mean)
    _, vectors = np.linalg.eigh(spread)
    axes = vectors[:, ::-1][:, : min(PARTS, n - 1, len(mean))] if n > 1 else np.zeros((len(mean), 1))
    return pd.DataFrame({"video_id": group["video_id"].iloc[:1], "n": [n], "mean": [mean.tobytes()], "axes": [np.ascontiguousarray(axes).tobytes()]})


def cluster_characters(faces: DataFrame, column: str = "descriptor", order: str = "face") -> DataFrame:
    """(video_id, order, character_id): descriptors of a video, centred, projected on the leading components and scaled to length 1; first centre nearest
    the mean direction, then farthest first; each to its most similar centre; ids by first appearance. Null descriptors get -1, fewer
    than two rows 0.

    A video may have any number of rows: its mean and Gram matrix are sums of what tasks have read, added in two steps; rows are projected in
    blocks; a centre is a minimum over the video, so that centres take at most MOST rounds of aggregation.
    """
    known = faces.where(F.col(column).isNotNull()).select("video_id", F.col(order).alias("_o"), F.col(column).cast("array<double>").alias("_x"))
    partial = known.select("video_id", "_x").mapInArrow(_sums, _PARTIAL).withColumn("_salt", (F.rand(1) * FAN).cast("int"))
    added = partial.groupBy("video_id", "_salt").applyInPandas(_added, _PARTIAL)
    axes = kept(added.groupBy("video_id").applyInPandas(_axes, "video_id long, n long, mean binary, axes binary"), "axes")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK)
    dealt = known.join(axes.select("video_id", "n"), "video_id").withColumn("_block", F.pmod(F.xxhash64("_o"), blocks("n")))
    copies = axes.select(F.col("video_id").alias("_v"), "mean", "axes", F.explode(F.sequence(F.lit(0).cast("long"), blocks("n") - 1)).alias("_b"))

    def project(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"video_id": [], "_o": [], "n": [], "y": []})
        mean = np.frombuffer(own["mean"].iloc[0])
        y = (np.array(rows["_x"].tolist(), "f8") - mean) @ np.frombuffer(own["axes"].iloc[0]).reshape(len(mean), -1)
        norm = np.sqrt((y * y).sum(1, keepdims=True))
        y = np.where(norm > 1e-6, y / np.maximum(norm, 1e-6), y)
        return pd.DataFrame({"video_id": rows["video_id"], "_o": rows["_o"], "n": rows["n"], "y": list(y)})

    y = kept(dealt.groupBy("video_id", "_block").cogroup(copies.groupBy("_v", "_b")).applyInPandas(project, "video_id long, _o long, n long, y array<double>"), "projected")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    mean = y.groupBy("video_id").agg(F.array(*[F.coalesce(F.avg(F.get("y", F.lit(k))), F.lit(0.0)) for k in range(PARTS)]).alias("_m"))
    short = lambda m: F.slice(m, F.lit(1), F.size("y"))
    first = y.join(mean, "video_id").groupBy("video_id").agg(F.min(F.struct((-dot(F.col("y"), short(F.col("_m")))).alias("d"), "_o", "y")).alias("c"), F.max("n").alias("n"))
    count = F.least(F.col("n"), F.greatest(F.lit(2), F.least(F.lit(MOST), F.coalesce(F.nullif(F.floor(F.col("n") / FACES), F.lit(0)), F.lit(2)), F.floor(F.col("n") / 2))))
    centres = kept(first.select("video_id", count.alias("k"), F.array("c.y").alias("centres")), "centres")
    for _ in range(MOST - 1):
        wanted = centres.where(F.size("centres") < F.col("k"))
        if not wanted.take(1):
            break
        likeness = F.array_max(F.transform("centres", lambda c: dot(F.col("y"), c)))
        farthest = y.join(wanted, "video_id").groupBy("video_id").agg(F.min(F.struct(likeness.alias("d"), "_o", "y")).alias("c"))
        more = centres.join(farthest, "video_id", "left")
        centres = kept(more.select("video_id", "k", F.when(F.col("c").isNull(), F.col("centres")).otherwise(F.array_append("centres", F.col("c.y"))).alias("centres")), "centres")
    near = F.transform("centres", lambda c: dot(F.col("y"), c))
    assigned = y.where("n > 1").join(centres, "video_id").select("video_id", "_o", F.array_position(near, F.array_max(near)).alias("_c"))
    seen = assigned.groupBy("video_id", "_c").agg(F.min("_o").alias("_first"))
    numbered = seen.withColumn("character_id", F.row_number().over(W.partitionBy("video_id").orderBy("_first")) - 1).drop("_first")
    found = assigned.join(numbered, ["video_id", "_c"]).select("video_id", F.col("_o").alias(order), "character_id")
    out = faces.select("video_id", order, F.col(column).isNotNull().alias("_known")).join(found, ["video_id", order], "left")
    return out.select("video_id", order, F.coalesce("character_id", F.when(F.col("_known"), 0).otherwise(-1)).cast("int").alias("character_id"))


def _codes(batches):
    """(video_id, id, vector) -> the bucket of each vector in each table: the signs of BITS random directions. The directions follow from a fixed seed."""
    planes = None
    for batch in batches:
        x = np.array(batch.column(2).to_pylist(), "f8").reshape(batch.num_rows, -1)
        if planes is None:
            planes = np.random.default_rng(7).standard_normal((x.shape[1], TABLES * BITS)) if x.shape[1] else np.zeros((0, TABLES * BITS))
        code = ((x @ planes > 0).reshape(len(x), TABLES, BITS) * (1 << np.arange(BITS))).sum(2).astype("i4")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(code), pa.list_(pa.int32()))], ["video_id", "face", "codes"])


def near_edges(pool: DataFrame, limit: float, tone: bool = False, column: str = "descriptor") -> DataFrame:
    """(video_id, a, b) of rows (video_id, face, path, score, column) of one video and different frames whose likeness is above limit, a ranked before b:
    pairs that share a bucket of some table, by exact likeness. Equal vectors are one in the buckets. Among themselves only the best is paired with
    the others of other frames, which is enough for the greedy answer: where it stays they go, and where a better row of another frame drops
    it, that row drops them too, so that copies make no squares."""
    rows = pool.select("video_id", "face", "path", "score", F.col(column).cast("array<double>").alias("_x"))
    size = F.size("_x")
    centred = F.transform("_x", lambda v: v - F.aggregate("_x", F.lit(0.0), lambda s, w: s + w) / size) if tone else F.col("_x")
    rows = kept(rows.withColumn("_x", centred), "vectors")
    same = W.partitionBy("video_id", "_x").orderBy(F.desc("score"), F.asc("face"))
    own = kept(rows.withColumns({"_top": F.first("face").over(same), "_path": F.first("path").over(same)}), "copies")
    copies = own.where("face <> _top and path <> _path").where(cosine(F.col("_x"), F.col("_x")) > limit).select("video_id", F.col("_top").alias("a"), F.col("face").alias("b"))
    tops = own.where("face = _top").select("video_id", "face", "_x")
    held = kept(tops.mapInArrow(_codes, "video_id long, face long, codes array<int>"), "codes")
    dealt = held.select("*", F.posexplode("codes").alias("_t", "_b"))
    a, b = dealt.alias("a"), dealt.alias("b")
    meet = (F.col("a.video_id") == F.col("b.video_id")) & (F.col("a._t") == F.col("b._t")) & (F.col("a._b") == F.col("b._b")) & (F.col("a.face") < F.col("b.face"))
    first = F.array_position(F.zip_with("a.codes", "b.codes", lambda p, q: p == q), True) == F.col("a._t") + 1  # a pair counts in the first table that has it
    pairs = a.join(b, meet).where(first).select(F.col("a.video_id").alias("video_id"), F.col("a.face").alias("_p"), F.col("b.face").alias("_q"))
    with_p = pairs.join(tops.select("video_id", F.col("face").alias("_p"), F.col("_x").alias("_xp")), ["video_id", "_p"])
    both = with_p.join(tops.select("video_id", F.col("face").alias("_q"), F.col("_x").alias("_xq")), ["video_id", "_q"])
    close = kept(both.where(cosine(F.col("_xp"), F.col("_xq")) > limit).select("video_id", "_p", "_q"), "close")
    member = lambda k: own.select("video_id", F.col("_top").alias(f"_{k}"), F.struct((-F.col("score")).alias("s"), "face", "path").alias(k))
    met = close.join(member("p"), ["video_id", "_p"]).join(member("q"), ["video_id", "_q"]).where("p.path <> q.path")
    ranked = F.array_sort(F.array(F.struct(F.col("p.s").alias("s"), F.col("p.face").alias("face")), F.struct(F.col("q.s").alias("s"), F.col("q.face").alias("face"))))
    edges = met.select("video_id", ranked.alias("r")).select("video_id", F.get("r", F.lit(0))["face"].alias("a"), F.get("r", F.lit(1))["face"].alias("b"))
    return edges.union(copies)


def deduplicate_hashed(pool: DataFrame, mode: str = "tone", threshold: float | None = None) -> DataFrame:
    """Greedy in score order within videos of any size: a row goes if it is too like a kept row of another frame; rows without a measure stay. face names a
    row in the whole pool. Rows of one frame with equal vectors share their fate, so that the best of them is tried for all."""
    _, standard, column = measure(mode)
    limit, column = standard if threshold is None else threshold, column if column in pool.columns else "descriptor"
    known = pool.where(F.col(column).isNotNull())
    alike = W.partitionBy("video_id", "path", column)
    tried = kept(known.withColumn("_of", F.first("face").over(alike.orderBy(F.desc("score"), "face"))), "tried")
    own = tried.where("face = _of").drop("_of")
    edges = near_edges(own, limit, mode == "tone", column)
    stays = deduplicate_large(own.select("face"), kept(edges.select("a", "b"), "edges"))
    back = tried.join(stays.select(F.col("face").alias("_of")), "_of", "left_semi").drop("_of").select(*pool.columns)
    return back.union(pool.where(F.col(column).isNull()))
