"""Merkle manifest of a table: a content-addressed graph of digests, and proofs of leaves by descent from the root.

The store maps a digest to the digests of its children. A leaf's rank, written in base FAN, names the child to take at each record;
what the record holds beside that child is the path segment, and the segments, reversed, fold a leaf back to the root. The descent
moves a frontier of distinct nodes, not of requests, so that the root is read once however many leaves are asked for.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import width, written

#: Children of a record; columns of documents in the order in which a leaf takes them.
FAN, FIELDS = 16, ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<before:string,after:string>>"
#: Heights that a tree can have: FAN ** 15 leaves are beyond a bigint's rank.
_HEIGHTS = 15


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def spelled(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(*map(spelled, values))


@dataclass
class Manifest:
    """leaves (t, i, h, leaf and the rows' own columns), records[k] of height k + 1 of all trees, and the same of the tree over the subroots."""

    leaves: DataFrame
    records: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: str | None


def _height(n: str) -> Column:
    """Levels above n nodes until one is left."""
    return sum((F.col(n) > F.lit(FAN**k)).cast("int") for k in range(1, _HEIGHTS)) + (F.col(n) > 1).cast("int")


def _ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows plus t, the rank of their group among all groups, i, their rank within it, and h, the height of the group's tree. Rows are sorted by range,
    so that a group of any size lies over many partitions; only one row for each group and partition is ranked by windows."""
    spark = rows.sparkSession
    placed = rows.repartitionByRange(width(spark), group, *order).sortWithinPartitions(group, *order).withColumn("_id", F.monotonically_increasing_id())
    held = written(placed.withColumns({"_part": F.shiftright("_id", 33).cast("int"), "_pos": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"), "ranked")
    runs = held.groupBy(group, "_part").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy(group).orderBy("_part")
    runs = runs.withColumn("_shift", F.sum("_n").over(before) - F.col("_n") - F.col("_first"))
    sizes = runs.groupBy(group).agg(F.sum("_n").alias("_size"), F.min(F.struct("_part", "_first")).alias("_at"))
    parts = {r[0]: r[1] for r in sizes.groupBy("_at._part").count().collect()}  # one number for each partition
    base, total = [], 0
    for p in sorted(parts):
        base.append((p, total))
        total += parts[p]
    inside = F.row_number().over(W.partitionBy("_at._part").orderBy("_at._first")) - 1
    bases = spark.createDataFrame(base, "_p int, _base long")
    groups = sizes.join(F.broadcast(bases), F.col("_at._part") == F.col("_p")).select(F.col(group).alias("_g"), (F.col("_base") + inside).alias("t"), _height("_size").alias("h"))
    known = runs.join(groups, F.col(group).eqNullSafe(F.col("_g"))).select(F.col("_part").alias("_q"), "_g", "_shift", "t", "h")
    mine = (F.col("_part") == F.col("_q")) & F.col(group).eqNullSafe(F.col("_g"))
    return held.join(known, mine).withColumn("i", F.col("_pos") + F.col("_shift")).drop("_part", "_pos", "_q", "_g", "_shift")


def _grow(nodes: DataFrame, tall: int) -> list[DataFrame]:
    """nodes (t, i, h, digest) -> records (t, i, h, digest, children) of each height up to tall; a tree of height h ends with its root at h."""
    levels = []
    for k in range(1, tall + 1):
        runs = nodes.where(F.col("h") >= k).groupBy("t", F.shiftright("i", 4).alias("i")).agg(F.any_value("h").alias("h"), F.array_sort(F.collect_list(F.struct("i", "digest"))).alias("c"))
        level = written(runs.select("t", "i", "h", F.col("c.digest").alias("children")).select("t", "i", "h", F.sha2(F.array_join("children", ""), 256).alias("digest"), "children"), "records")
        levels.append(level)
        nodes = level.drop("children")
    return levels


def build(rows: DataFrame, group: str, order: str, leaf: str = "leaf") -> Manifest:
    """Manifest of rows (group, order, leaf digest, further columns): a tree for each group, leaves ascending by order (null first; equal ones by
    digest), then a tree over the groups' roots in the groups' order (null first, by UTF-8 bytes). FAN consecutive nodes make one, the
    last run of a level may be short, and a level of one node is the root. An empty table has no root (None)."""
    leaves = written(_ranked(rows, group, order, leaf), "leaves")
    tall = leaves.agg(F.max("h")).first()[0] or 0
    records = _grow(leaves.select("t", "i", "h", F.col(leaf).alias("digest")), tall)
    ends = leaves.where("h = 0").select("t", F.col(leaf).alias("digest"), "h")
    for k, level in enumerate(records, 1):
        ends = ends.union(level.where(F.col("h") == k).select("t", "digest", "h"))
    ends = written(ends, "subroots")
    n = ends.count()
    high = next(k for k in range(_HEIGHTS + 1) if n <= FAN**k)
    top = _grow(ends.select(F.lit(0).cast("long").alias("t"), F.col("t").alias("i"), F.lit(high).alias("h"), "digest"), high)
    last = (top[-1] if top else ends).select("digest").first()
    return Manifest(leaves, records, ends, top, last[0] if last else None)


def _segment(children: str, digit: Column) -> Column:
    """What a record holds before and after the child that is taken."""
    join = lambda a, n: F.array_join(F.slice(children, a, n), "")
    return F.struct(join(F.lit(1), digit).alias("before"), join(digit + 2, F.lit(FAN)).alias("after"))


def _taken(frontier: DataFrame, level: DataFrame) -> DataFrame:
    """frontier joined to the store by digest; equal records of equal subtrees are one."""
    return frontier.join(level.select("digest", "children").dropDuplicates(["digest"]), "digest")


def _descend(tops: DataFrame, levels: list[DataFrame], wanted: DataFrame, least: int) -> list[DataFrame]:
    """Frontiers (t, i, digest, subroot, path) of the heights least and above, from tops (t, h, digest, subroot, path) down; wanted: (t, i) of leaves.
    frontiers[k] holds the nodes of height k above some wanted leaf."""
    needed = [wanted.select("t", "i").distinct()]
    for _ in levels:
        needed.append(needed[-1].select("t", F.shiftright("i", 4).alias("i")).distinct())
    columns = ("t", "i", "digest", "subroot", "path")
    start = lambda k: tops.where(F.col("h") == k).withColumn("i", F.lit(0).cast("long")).select(*columns)
    frontiers = {len(levels): start(len(levels))}
    for k in range(len(levels), least, -1):
        opened = _taken(frontiers[k], levels[k - 1]).select("t", "i", "children", "subroot", "path", F.posexplode("children").alias("digit", "child"))
        step = opened.select("t", (F.col("i") * FAN + F.col("digit")).alias("i"), F.col("child").alias("digest"), "subroot", F.concat("path", F.array(_segment("children", F.col("digit")))).alias("path"))
        frontiers[k - 1] = step.join(needed[k - 1], ["t", "i"], "left_semi").union(start(k - 1))
    return [frontiers[k] if k in frontiers else None for k in range(len(levels) + 1)]


def prove(store: Manifest, requests: DataFrame) -> DataFrame:
    """requests (t, i, further columns) of leaves -> the same with digest, subroot and path, the segments (before, after) from the leaf's run up to
    the root's. Requests of one run of leaves go down together; the last record is opened beside them, so that long paths aren't sent for each leaf."""
    none = F.array().cast(_PATH)
    ends = store.subroots
    high = len(store.top)
    trees = requests.select(F.lit(0).cast("long").alias("t"), F.col("t").alias("i")).distinct()
    peak = ends.select(F.lit(0).cast("long").alias("t"), F.lit(high).alias("h"), F.lit(store.root).cast("string").alias("digest"), F.lit("").alias("subroot"), none.alias("path")).limit(1)
    down = _descend(peak, store.top, trees, 0)[0]
    tops = down.select(F.col("i").alias("t"), F.col("digest"), F.col("digest").alias("subroot"), "path").join(ends.select("t", "h"), "t")
    if len(store.records):
        tops = written(tops, "tops")
    asked = F.struct("*")
    runs = requests.where("h > 0").groupBy("t", F.shiftright("i", 4).alias("run")).agg(F.collect_list(asked).alias("_asked"))
    out = None
    if store.records:
        last = _taken(_descend(tops, store.records, requests.where("h > 0"), 1)[1].withColumnRenamed("i", "run"), store.records[0])
        each = last.join(runs, ["t", "run"]).select("children", "subroot", "path", F.explode("_asked").alias("_r"))
        digit = F.col("_r.i").bitwiseAND(F.lit(FAN - 1)).cast("int")
        out = each.select("_r.*", F.element_at("children", digit + 1).alias("digest"), "subroot", F.concat("path", F.array(_segment("children", digit))).alias("path"))
    alone = requests.where("h = 0").join(tops.select("t", "digest", "subroot", "path"), "t").select(*requests.columns, "digest", "subroot", "path")
    return (out.union(alone) if out is not None else alone).withColumn("path", F.reverse("path"))


def folded(leaf: Column, path: Column) -> Column:
    """Root that a leaf and a path give."""
    return F.aggregate(path, leaf, lambda own, s: digest(s["before"], own, s["after"]))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def audit(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): every document's proof, checked against a copy in which the documents whose
    doc_id's crc32 5 divides have lost their capitals A-Z.

    Null columns have a spelling of their own, null doc_ids are never tampered with and come first, rows that are equal throughout are leaves
    of their own with the same digest, empty and very long texts are nothing special; other columns are not read; an empty table gives an
    empty one.
    """
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = leaf_of(*(F.translate("text", UPPER, LOWER) if k == "text" else F.col(k) for k in FIELDS))
    rows = docs.select("doc_id", "source", leaf_of(*map(F.col, FIELDS)).alias("leaf"), F.when(changed, other).alias("tampered"))
    store = build(rows, "source", "doc_id")
    found = prove(store, store.leaves.drop("source"))
    back = found.withColumn("folded_root", folded(F.coalesce("tampered", "digest"), F.col("path")))
    root = F.lit(store.root).cast("string")
    return back.select("doc_id", "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))


#: Unsigned crc32 of a text in DuckDB, whose table has 256 entries made by its rule; {x}: the text.
CRC_TABLE = "(SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) AS r(i)))"
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({x}))), lambda j: CAST('0x' || substr(hex(encode({x})), 2 * j + 1, 2) AS BIGINT))), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)))"


def _sql(levels: int) -> str:
    field = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if k == "text" else k) for k in FIELDS) + ")"
    small = f"translate(text, '{UPPER}', '{LOWER}')"
    ctes = [
        f"crc AS MATERIALIZED {CRC_TABLE}",
        f"d AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {CRC.replace('{x}', 'CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(small)} END AS tampered FROM documents, crc)",
        "l0 AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
        "a0 AS (SELECT t, i, leaf AS h FROM l0)",
    ]

    def grow(name: str) -> None:
        for k in range(1, levels + 1):
            ctes.append(f"{name}{k} AS MATERIALIZED (SELECT t, i // {FAN} AS i, CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY t) AS n FROM {name}{k - 1}) GROUP BY t, i // {FAN})")

    grow("a")
    ctes.append(f"b0 AS (SELECT 0 AS t, t AS i, h FROM a{levels})")
    grow("b")
    f0, joins = "SELECT l0.*, '' AS proof, coalesce(tampered, leaf) AS own, i AS ai, t AS bi FROM l0", []
    ctes.append(f"s0 AS ({f0})")
    step = 0
    for name, at, tree in (("a", "ai", "s.t"), ("b", "bi", "0")):
        for k in range(levels):
            runs = f"g{name}{k}"
            ctes.append(f"{runs} AS MATERIALIZED (SELECT t, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after, count(*) OVER (PARTITION BY t) AS n FROM {name}{k} WINDOW w AS (PARTITION BY t, i // {FAN} ORDER BY i))")
            ctes.append(f"s{step + 1} AS MATERIALIZED (SELECT s.* REPLACE (proof || CASE WHEN n > 1 THEN before || after ELSE '' END AS proof, CASE WHEN n > 1 THEN sha256(before || own || after) ELSE own END AS own, {at} // {FAN} AS {at}) FROM s{step} AS s JOIN {runs} AS g ON g.t = {tree} AND g.i = s.{at})")
            step += 1
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, a{levels}.h AS subroot, b{levels}.h AS root, sha256(proof) AS proof_sha256, own AS folded_root, own = b{levels}.h AS verified FROM s{step} JOIN a{levels} USING (t), b{levels}"


#: For sources of up to 16 ** 5 documents.
SQL = _sql(5)
