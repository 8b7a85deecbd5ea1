"""Helpers that the corpus operators share: tables, the shared folder, written tables and link components."""

import ctypes
import gc
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Setting by which Spark deletes the shuffle files of a query as soon as the query ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_places: "weakref.WeakKeyDictionary[DataFrame, str]" = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions of this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or the folder that SparkContext.setCheckpointDir was given.

    Where neither is set, a local session gets a folder of its own; on a cluster that would be a folder of one machine, so
    that a ValueError says what to set.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not where:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="reelspan-"))
        where = context.getCheckpointDir()
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, so that a lost executor costs one stage, not the lineage.
    The query's shuffle files go when it ends."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(TIDY)
    spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    back = spark.read.schema(df.schema).parquet(path)
    _places[back] = path
    return back


def discard(*tables: DataFrame) -> None:
    """Empty tables that `written` gave and that nothing reads any more."""
    for df in tables:
        if path := _places.pop(df, None):
            df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(path)


#: Keys that a broadcast may hold.
BROADCAST_KEYS = 1_000_000


def without(docs: DataFrame, mine, keys: DataFrame, name: str) -> DataFrame:
    """docs without the rows whose `mine` (a column of theirs) is among the keys, one column of whole numbers. Keys are written and counted first: up to
    BROADCAST_KEYS of them go to every task, so that the documents stay where they are; of more, both sides are shuffled."""
    keys = written(keys.select(F.col(keys.columns[0]).alias("key")).distinct(), name)
    side = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    return docs.join(side, mine == keys["key"], "left_anti")


def lean(run):
    """A mapInArrow function that gives its worker's free memory back to the machine when a task ends. Workers outlive their tasks, and
    what an idle one keeps is taken from the executor's other stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return wrapped


def offsets_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary array (null: empty), without a copy of each value."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if pa.types.is_string(array.type) or pa.types.is_large_string(array.type):
        array = array.fill_null("") if array.null_count else array
    elif array.null_count:
        array = array.fill_null(b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    ends = np.frombuffer(array.buffers()[1], dtype="i8" if wide else "i4")[array.offset : array.offset + len(array) + 1].astype("i8")
    data = array.buffers()[2]
    raw = np.frombuffer(data, "u1") if data is not None and data.size else np.zeros(0, "u1")
    return raw[ends[0] : ends[-1]], ends - ends[0]


def flat(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0]+1, ... of every range, one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype="i8") + np.repeat(starts - before, lengths)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b) and, for each, the smallest node that these links reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        label = new
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[label]


def _contract(batches):
    """Within a task: replace links by a star around the smallest node of each local component."""
    a, b = [], []
    for batch in batches:
        a.append(batch.column(0).to_numpy(zero_copy_only=False))
        b.append(batch.column(1).to_numpy(zero_copy_only=False))
        if sum(map(len, a)) > 1_000_000:
            v, r = forest(np.concatenate(a), np.concatenate(b))
            a, b = [v[v != r]], [r[v != r]]
            if len(a[0]) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(b[0])], ["v", "r"])
                a, b = [], []
    if a:
        v, r = forest(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(v[v != r]), pa.array(r[v != r])], ["v", "r"])


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (id, component_id): each linked node with the smallest node that its links reach.

    Alternating large-star and small-star rounds over tables written to the shared folder; every task first
    contracts its own links, so that the rounds are few. Nulls and self links are ignored; repeated links are fine;
    nodes without a link are not returned.
    """
    a, b = links.columns[:2]
    links = links.select(F.col(a).cast("long").alias("v"), F.col(b).cast("long").alias("r")).where("v is not null and r is not null and v <> r")
    stars = written(links.mapInArrow(_contract, "v long, r long").distinct(), "stars")
    seen = None
    while True:
        both = stars.select(F.col("v").alias("u"), F.col("r").alias("w")).union(stars.select(F.col("r").alias("u"), F.col("v").alias("w")))
        least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("v"), F.col("m").alias("r")).distinct()
        low = large.groupBy("v").agg(F.min("r").alias("m"))
        small = large.join(low, "v").where("r <> m").select(F.col("r").alias("v"), F.col("m").alias("r"))
        done, stars = stars, written(small.union(low.select("v", F.col("m").alias("r"))).distinct(), "stars")
        discard(done)
        now = stars.agg(F.count("*"), F.expr("bit_xor(xxhash64(v, r))")).first()
        if now == seen:
            break
        seen = now
    return stars.select(F.col("v").alias("id"), F.col("r").alias("component_id")).union(stars.select(F.col("r").alias("id"), F.col("r").alias("component_id")).distinct())
