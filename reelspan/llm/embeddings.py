"""Embedding near-duplicates: p-stable hashing of normalised vectors in several tables, then exact cosines within buckets."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, written

#: Least cosine of a link.
COSINE = 0.95
#: Tables, quantised random projections in each, and width of a quantum. Vectors at cosine 0.95 (distance 0.316) share a
#: projection's cell with probability 0.87 and a table's bucket with 0.2; 24 tables then miss 0.5 % of such pairs.
TABLES, PROJECTIONS, QUANTUM = 24, 12, 2.0
#: Vectors in a block; a bucket of more is dealt out to one task per pair of its blocks.
BLOCK = 2000
SEED = 7


def projections(size: int, tables: int = TABLES) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.standard_normal((size, tables * PROJECTIONS)), rng.uniform(0, QUANTUM, tables * PROJECTIONS)


def buckets(unit: np.ndarray, tables: int = TABLES) -> np.ndarray:
    """Bucket of each unit vector in each table."""
    a, b = projections(unit.shape[1], tables)
    cells = np.floor((unit @ a + b) / QUANTUM).astype("i8").reshape(len(unit), tables, PROJECTIONS)
    out = np.zeros((len(unit), tables), "u8")
    for k in range(PROJECTIONS):
        out = (out ^ cells[:, :, k].astype("u8")) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view("i8")


def _unit(rows) -> np.ndarray:
    x = np.array(rows, "f8")
    x = x / np.abs(x).max(1, initial=0)[:, None]  # no square is too large or too small then
    return x / np.sqrt((x * x).sum(1))[:, None]


def _hash_rows(batches):
    for batch in batches:
        by_size: dict[int, list[int]] = {}
        vectors = batch.column(0).to_pylist()
        for i, v in enumerate(vectors):
            by_size.setdefault(len(v), []).append(i)
        for size, at in by_size.items():
            for k in range(0, len(at), 2000):
                part = at[k : k + 2000]
                ids = pa.array(list(buckets(_unit([vectors[i] for i in part]))), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([c.take(pa.array(part)) for c in batch.columns] + [ids], [*batch.schema.names, "buckets"])


LINKS = "node long, other long, n long"


def _compare(table: int, left: list[dict], right: list[dict] | None):
    """Links of a block with itself (right None) or with another. A pair counts in the first table that puts it together."""
    own = right is None
    right = left if own else right
    x, y = _unit([r["v"] for r in left]), _unit([r["v"] for r in right])
    bx, by = np.array([r["buckets"] for r in left]), np.array([r["buckets"] for r in right])
    ids, jds = np.array([r["rep"] for r in left]), np.array([r["rep"] for r in right])
    many, more = np.array([r["n"] for r in left]), np.array([r["n"] for r in right])
    count, gain = np.zeros(len(x), "i8"), np.zeros(len(y), "i8")
    nodes, roots = [], []
    for a in range(0, len(x), 256):
        near = x[a : a + 256] @ y.T >= COSINE
        if own:
            near &= np.arange(a, a + len(near))[:, None] < np.arange(len(y))
        i, j = np.nonzero(near)
        if table:
            new = ~(bx[a + i, :table] == by[j, :table]).any(1)
            i, j = i[new], j[new]
        count += np.bincount(a + i, more[j], len(x)).astype("i8")
        gain += np.bincount(j, many[a + i], len(y)).astype("i8")
        # a spanning forest is enough for components; the counts above hold every link
        node, root = forest(ids[a + i], jds[j])
        nodes.append(node[node != root])
        roots.append(root[node != root])
    node, root = forest(np.concatenate(nodes), np.concatenate(roots))
    found = [(int(i), None, int(n)) for i, n in zip(ids, count) if n] + [(int(i), None, int(n)) for i, n in zip(jds, gain) if n]
    return found + [(int(a), int(b), 0) for a, b in zip(node, root) if a != b]


def _rows(found):
    node, other, n = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(n, pa.int64())], ["node", "other", "n"])


def _within(batches):
    """Rows sorted by cell: each cell is one block, or two blocks of a large bucket."""
    cell, held = None, []

    def closed():
        left = [r for r in held if r["side"] == 0]
        right = [r for r in held if r["side"] == 1]
        table, _, i, j = cell
        if i == j:
            return _compare(table, left, None) if len(left) > 1 else []
        return _compare(table, left, right) if left and right else []

    for batch in batches:
        for r in batch.to_pylist():
            key = (r["t"], r["bucket"], r["i"], r["j"])
            if key != cell:
                if len(held) > 1 and (found := closed()):
                    yield _rows(found)
                cell, held = key, []
            held.append(r)
    if len(held) > 1 and (found := closed()):
        yield _rows(found)


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): links are pairs of rows with cosine >= 0.95 in double precision.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and stand alone, and so do rows
    without vec_id. Vectors of different lengths never link. Equal vectors are compared as one that counts for all its rows.
    Repeated rows with one vec_id are different rows with the same answer each. Other columns are not read; an empty table
    gives an empty one. Pairs below the hashing's recall (measured in the tests) may be missed; no pair below 0.95 is linked.
    """
    raw = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    sound = "vec_id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"
    good = raw.where(sound)
    equal = good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    hashed = written(equal.mapInArrow(_hash_rows, "v array<double>, rep long, n long, buckets array<long>"), "vectors")
    dealt = hashed.select("*", F.posexplode("buckets").alias("t", "bucket"))
    sizes = dealt.groupBy("t", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    blocks = f"cast(ceil(size / {BLOCK}) as int)"
    cells = dealt.join(sizes, ["t", "bucket"]).withColumn("b", F.expr(blocks)).withColumn("own", F.expr("cast(pmod(xxhash64(rep), b) as int)"))
    pairs = F.expr("transform(sequence(0, b - 1), k -> struct(least(own, k) as i, greatest(own, k) as j, if(own <= k, 0, 1) as side))")
    cells = cells.withColumn("pair", F.explode(pairs)).select("t", "bucket", "pair.i", "pair.j", "pair.side", "rep", "n", "v", "buckets")
    cells = cells.repartition("t", "bucket", "i", "j").sortWithinPartitions("t", "bucket", "i", "j")
    found = written(cells.mapInArrow(_within, LINKS), "links")
    counts = found.where("other is null").groupBy(F.col("node").alias("rep")).agg(F.sum("n").alias("more"))
    parts = components(found.where("other is not null").select("node", "other")).withColumnRenamed("id", "rep")
    named = equal.select("v", "rep", "n").join(counts, "rep", "left").join(parts, "rep", "left")
    named = named.select("v", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    linked = good.join(named, "v")
    alone = raw.where(f"not ({sound}) or ({sound}) is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.select("vec_id", "n_links", "component_id").union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
c AS (SELECT vec_id AS id, vec_id AS low FROM embeddings UNION SELECT p.b, c.low FROM c JOIN p ON p.a = c.id WHERE c.low < p.b),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.low AS component_id, m.low = e.vec_id AS kept
FROM embeddings e JOIN (SELECT id, min(low) AS low FROM c GROUP BY id) m ON m.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
