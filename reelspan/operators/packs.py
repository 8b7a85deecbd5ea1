"""Content packs, releases and lint: JSON documents as rows of paths, versions as arrays, findings as rows."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from reelspan.functions.documents import Number, Raw, parse, spell
from reelspan.functions.groups import by_runs
from reelspan.functions.shared import kept
from reelspan.functions.text import version_key

#: Punctuation and symbols beyond ASCII that lint allows, and words of another language that it reports.
ALLOWED = "—–‑…“”‘’·•×÷≥≤≠→←↑↓✓✗°±§¶©®™−─│┌┐└┘├┤┬┴┼ ﻿"
FOREIGN = (
    "nao voce usuario usuarios arquivo arquivos pasta senha janela botao mensagem imagem atualizacao configuracao instalacao clique aguarde carregando "
    "selecione escolha falhou sucesso erro erros salvar abrir fechar enviar baixar instalar atualizar canal canais quadro legenda miniatura"
).split()


def read_packs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Packs (path, doc) of a folder of JSON files, and problem rows for those that aren't an object."""
    return sort_packs(spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc")))


def sort_packs(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    parsed = raw.withColumn("_v", F.try_parse_json("doc"))
    problem = F.when(F.col("_v").isNull(), "unreadable JSON").when(~F.startswith(F.schema_of_variant("_v"), F.lit("OBJECT")), "not an object")
    marked = parsed.withColumn("problem", problem).drop("_v")
    return marked.where("problem is null").drop("problem"), marked.where("problem is not null").select("path", "problem")


def _leaves(doc: str | None):
    """Paths and values of a JSON text, by a stack, whatever its depth."""
    if doc is None:
        return
    plain = lambda v: v if type(v) is str or v is None else spell(v)
    stack = [("", parse(doc))]
    while stack:
        path, value = stack.pop()
        if not isinstance(value, dict) or not value:
            yield path, plain(value)
            continue
        stack.extend((f"{path}/{_escaped(k)}" if path else _escaped(k), v) for k, v in value.items())


def _escaped(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def flatten(packs: DataFrame, key: str = "id") -> DataFrame:
    """(id, doc JSON) -> (id, path, value JSON): objects are opened, however deep; arrays and scalars are values, and so are empty objects. In
    a path / parts the keys; inside a key it stands as ~1, and ~ as ~0. Null documents have no rows; unreadable ones fail (see sort_packs)."""

    def run(batches):
        for batch in batches:
            ids, docs = batch.column(0), batch.column(1).to_pylist()
            found = [(i, *leaf) for i, doc in enumerate(docs) for leaf in _leaves(doc)]
            at, paths, values = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(paths, pa.string()), pa.array(values, pa.string())], [key, "path", "value"])

    named = packs.select(key, "doc").repartition(key)  # a file of many small documents is one task of reading, but not of parsing
    schema = StructType([named.schema[key], StructField("path", StringType()), StructField("value", StringType())])
    return named.mapInArrow(run, schema)


def strip_meta(rows: DataFrame) -> DataFrame:
    """Rows without a path part that is schema, use or starts with an underscore."""
    return rows.where(~F.col("path").rlike("(^|/)(_[^/]*|schema|use)(/|$)"))


def deep_merge(base: DataFrame, over: DataFrame, key: str = "id") -> DataFrame:
    """Rows (id, path, value) of both: over wins; rows of base below a path that over replaces, or above one that it opens, go. An empty
    object of over replaces a scalar or an array, but changes nothing of an object."""
    told = lambda df, mine: df.select(key, "path", "value", F.lit(mine).alias("_mine"))

    def work(rows, starts):
        paths, values, mine = (rows.column(k).to_pylist() for k in ("path", "value", "_mine"))
        none, at, out = rows.column(key).is_null().to_pylist(), [], []
        for a, b in zip(starts, starts[1:]):
            sides = [[(paths[i], values[i]) for i in range(a, b) if mine[i] is m] for m in (True, False)]
            found = sides[0] + sides[1] if none[a] else _over(*sides)
            at += [a] * len(found)
            out += found
        merged = rows.select([key]).take(pa.array(at, pa.int64()))
        for k, name in enumerate(("path", "value")):
            merged = merged.append_column(name, pa.array([o[k] for o in out], pa.string()))
        yield from merged.to_batches()

    return by_runs(told(base, True).union(told(over, False)), (key,), (), work, base.select(key, "path", "value").schema)


def _over(base: list[tuple], over: list[tuple]) -> list[tuple]:
    """deep_merge of one document's rows (path, value)."""
    above = lambda path: (path[:i] for i, ch in enumerate(path) if ch == "/")
    empty = lambda v: v is not None and v.strip(" ") == "{}"
    shut = {path for path, v in over if not empty(v)}
    opened, holds = ({p for path, _ in side for p in above(path)} for side in (over, base))
    held: dict[str, list] = {}
    for path, v in base:
        if path not in opened and shut.isdisjoint(above(path)):
            held.setdefault(path, []).append(v)
    out = []
    for path, v in over:
        if not (empty(v) and path in holds):
            out += [(path, b if v is None else v) for b in held.get(path, [None])]
    done = {path for path, v in over if not (empty(v) and path in holds)}
    return out + [(path, v) for path, vs in held.items() if path not in done for v in vs]


def follow(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """starts (start), steps (at, to) with one step from each place at most -> (start, at, depth, loop): all places on the way from each start, itself at
    depth 0. A way that comes back to a place ends there, with loop true.

    By doubling: step tables of length 1, 2, 4, .. are joined to what is known, so that rounds are the logarithm of the longest way, and rows
    are made for the given starts only.
    """
    jump = kept(steps.where("at is not null and to is not null").groupBy("at").agg(F.min("to").alias("to")), "jump")
    ways = starts.where("start is not null").select("start", F.col("start").alias("at"), F.lit(0).cast("long").alias("depth")).distinct()
    ways, size = kept(ways.withColumn("loop", F.lit(False)), "ways"), 1
    while True:
        open_ = ways.groupBy("start").agg(F.bool_or("loop").alias("_shut")).where("not _shut").select("start")
        more = ways.join(open_, "start").join(jump, "at").select("start", F.col("to").alias("at"), F.col("depth") + size, F.lit(False))
        more = kept(more, "ways")
        if not more.take(1):
            return ways
        again = F.row_number().over(W.partitionBy("start", "at").orderBy("depth")) > 1
        every = ways.union(more).withColumn("loop", again)
        end = F.min(F.when(F.col("loop"), F.col("depth"))).over(W.partitionBy("start"))
        ways = kept(every.withColumn("_end", end).where("_end is null or depth <= _end").drop("_end"), "ways")
        far = jump.select(F.col("at").alias("to"), F.col("to").alias("_far"))
        jump, size = kept(jump.join(far, "to").select("at", F.col("_far").alias("to")), "jump"), 2 * size


def expand_use(packs: DataFrame, presets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packs (id, use, doc rows aside) with the chain of presets (preset, use) that they reach: (id, preset, depth), nearest first; problem rows for
    unknown presets and cycles. Chains are followed once for each preset that is used, however long, and then joined to the packs."""
    chain = follow(packs.where("use is not null").select(F.col("use").alias("start")), presets.select(F.col("preset").alias("at"), F.col("use").alias("to")))
    known = presets.select("preset").distinct().withColumn("_known", F.lit(True))
    reached = chain.select("start", F.col("at").alias("preset"), F.col("depth").cast("int").alias("depth"), "loop").join(known, "preset", "left")
    users = packs.where("use is not null").select("id", F.col("use").alias("start")).join(reached, "start")
    good = users.where("_known is not null and not loop").select("id", "preset", "depth")
    return good, users.where("_known is null or loop").select("id", "preset", F.when(F.col("loop"), "cycle").otherwise("unknown").alias("problem"))


_NODE = "path array<string>, kind string, value string, use string"


def _nodes(key: str):
    """(key, doc) -> every object, array and scalar of a document with its path, and what an object uses. The loader's own keys are left out."""

    def nodes(doc):
        stack = [((), parse(doc))]
        while stack:
            path, v = stack.pop()
            if isinstance(v, dict):
                use = v.get("use")
                empty = use is None or use is False or use == "" or (isinstance(use, Number) and float(use) == 0)
                yield path, "object", None, None if empty else use if type(use) is str else spell(use)
                stack.extend(((*path, k), x) for k, x in v.items() if not (k.startswith("_") or k in ("schema", "use")))
            elif isinstance(v, list):
                yield path, "array", str(len(v)), None
                stack.extend(((*path, str(i)), x) for i, x in enumerate(v))
            else:
                yield path, "scalar", spell(v), None

    def run(batches):
        for batch in batches:
            ids, docs = batch.column(0), batch.column(1).to_pylist()
            found = [(i, *node) for i, doc in enumerate(docs) if doc is not None for node in nodes(doc)]
            at, *rest = zip(*found) if found else ((),) * 5
            types = (pa.list_(pa.string()), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(map(list, r) if k == 0 else r, t) for k, (r, t) in enumerate(zip(rest, types)))], [key, "path", "kind", "value", "use"])

    return run


def _merged(nodes: list[tuple]) -> str:
    """One document of the nodes (path, rank, kind, value) that a pack and the presets in it hold. Ranks are those of the walk: a rank comes before those
    that it begins, and what stands first wins. An object lets later ones add keys; anything else covers all that its own presets and
    its betters' hold below it."""
    at: dict[tuple, list] = {}
    for path, rank, kind, value in nodes:
        at.setdefault(path, []).append((rank, kind, value))
    opened: dict[tuple, set] = {}
    made, root = {}, None
    for path in sorted(at, key=lambda p: (len(p), p)):
        above, alive, here = opened.get(path[:-1], set()) if path else {()}, set(), []
        for rank, kind, value in sorted(at[path], key=lambda x: x[0]):
            begins = rank and -rank[-1] == len(path)  # here the preset is used: it stands and falls with the object that uses it
            if rank[:-1] in alive if begins else rank in above:
                alive.add(rank)
                here.append((rank, kind, value))
        if not here:
            continue
        first: dict[tuple, tuple] = {}
        for rank, kind, _ in here:
            for n in range(len(rank) + 1):
                first.setdefault(rank[:n], (kind, rank))
        agreed = lambda rank, kind: all(k == "object" if kind == "object" else r == rank for k, r in (first[rank[:n]] for n in range(len(rank) + 1)))
        opened[path] = {rank for rank, kind, _ in here if kind != "scalar" and agreed(rank, kind)}
        _, kind, value = here[0]
        own = {} if kind == "object" else [None] * int(value) if kind == "array" else Raw(value)
        if kind != "scalar":
            made[path] = own
        if not path:
            root = own
            continue
        holder = made[path[:-1]]
        holder[int(path[-1]) if isinstance(holder, list) else path[-1]] = own
    return spell(root)


def expand_documents(packs: DataFrame, presets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packs (id, doc) and presets (preset, doc) -> (id, doc) in which every object that says {"use": preset} also holds what the preset says, own keys
    winning, through objects and arrays and presets that use presets; and problems (id, path, preset, problem): a preset that a way comes back
    to (cycle), that isn't there (unknown), or whose document isn't an object. What is wrong adds nothing.

    The walk goes in rounds over all packs at once: a row is one use at one place, with the presets on its way; a round joins the uses inside
    the presets that the last one reached, so that rounds are the longest way. Keys of the loader (schema, use, _..) are left out.
    Null documents have no row; one id has one document.
    """
    own = kept(packs.select("id", "doc").repartition("id").mapInArrow(_nodes("id"), StructType([packs.schema["id"], *_fields(_NODE)])), "nodes")
    held = kept(presets.select("preset", "doc").mapInArrow(_nodes("preset"), StructType([presets.schema["preset"], *_fields(_NODE)])), "nodes")
    roots = held.where("size(path) = 0").groupBy("preset").agg(F.min("kind").alias("_kind"))
    inner = held.where("use is not null").select(F.col("preset").alias("_p"), F.col("path").alias("_sub"), F.col("use").alias("_next"))
    place = lambda p: F.array(-F.size(p))  # noqa: E731  (of two uses in one document, the inner one wins)
    way = own.where("use is not null").select("id", F.col("path").alias("at"), F.col("use").alias("preset"), place("path").alias("rank"), F.array().cast("array<string>").alias("seen"))
    good, bad = [], []
    while True:
        way = kept(way.join(roots, "preset", "left"), "ways")
        if not way.take(1):
            break
        problem = F.when(F.array_contains("seen", F.col("preset")), "cycle").when(F.col("_kind").isNull(), "unknown").when(F.col("_kind") != "object", "not an object")
        told = way.withColumn("problem", problem)
        bad.append(told.where("problem is not null").select("id", F.array_join(F.transform("at", lambda k: F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))), "/").alias("path"), "preset", "problem"))
        good.append(told.where("problem is null").select("id", "at", "preset", "rank"))
        step = told.where("problem is null").join(inner, F.col("preset") == F.col("_p"))
        deeper = F.concat("at", "_sub")
        way = step.select("id", deeper.alias("at"), F.col("_next").alias("preset"), F.concat("rank", place(deeper)).alias("rank"), F.array_append("seen", F.col("preset")).alias("seen"))
    nodes = own.select("id", "path", F.array().cast("array<int>").alias("rank"), "kind", "value")
    for reached in good:
        nodes = nodes.union(reached.join(held, "preset").select("id", F.concat("at", "path").alias("path"), "rank", "kind", "value"))
    schema = StructType([packs.schema["id"], StructField("doc", StringType())])

    def work(rows, starts):
        every = list(zip(map(tuple, rows.column("path").to_pylist()), map(tuple, rows.column("rank").to_pylist()), rows.column("kind").to_pylist(), rows.column("value").to_pylist()))
        docs = [_merged(every[a:b]) for a, b in zip(starts, starts[1:])]
        yield from rows.select(["id"]).take(pa.array(starts[:-1])).append_column("doc", pa.array(docs, pa.string())).to_batches()

    none = packs.sparkSession.createDataFrame([], StructType([packs.schema["id"], *_fields("path string, preset string, problem string")]))
    problems = none
    for b in bad:
        problems = problems.union(b)
    return by_runs(nodes, ("id",), (), work, schema), problems


def _fields(text: str) -> list[StructField]:
    return StructType.fromDDL(text).fields


def packs_by_group(packs: DataFrame) -> DataFrame:
    return packs.groupBy("grp").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def keep_groups(packs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packs of the wanted groups (case aside), and the wanted groups that no pack has."""
    w = wanted.select(F.lower("grp").alias("_g")).distinct()
    return packs.join(w, F.lower("grp") == F.col("_g"), "left_semi"), unknown_groups(packs, wanted)


def unknown_groups(packs: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.select(F.lower("grp").alias("grp")).subtract(packs.select(F.lower("grp").alias("grp")))


def build_feed(manifests: DataFrame) -> DataFrame:
    """One row: patches sorted by version, the latest, and how many manifests were unreadable (null version or file) and skipped."""
    sound = F.col("version").isNotNull() & F.col("file").isNotNull()
    entry = F.struct(version_key(F.col("version")).alias("v"), "version", "file", "sha256", "size")
    out = manifests.agg(F.array_sort(F.collect_list(F.when(sound, entry))).alias("patches"), F.count_if(~sound).alias("skipped"))
    return out.withColumn("latest", F.try_element_at("patches", F.lit(-1)).getField("version"))


def upgrade_path(installs: DataFrame, patches: DataFrame) -> DataFrame:
    """(machine, step, version): from each install (machine, version), again and again the highest patch (version, min_version) above it that
    it may take. Each step raises the version, so that a path ends.

    Paths are followed once for each distinct version, by doubling, and then joined to the machines. The highest patch that a version may take is a
    running maximum over minimum versions, of ranges of them and then within each.
    """
    at = installs.select("machine", "version", version_key(F.col("version")).alias("_at"))
    offered = patches.select(version_key(F.coalesce("min_version", F.lit("0.0.0"))).alias("_at"), F.struct(version_key(F.col("version")).alias("_v"), F.col("version").alias("to")).alias("best"))
    versions = at.select("_at").union(offered.select("best._v")).distinct()
    both = offered.union(versions.select("_at", F.lit(None).cast(offered.schema["best"].dataType)))
    ranged = kept(both.repartitionByRange("_at").withColumn("_range", F.spark_partition_id()), "versions")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row for each range
    tops = ranged.groupBy("_range").agg(F.max("best").alias("_top")).withColumn("_top", F.max("_top").over(before))
    upto = W.partitionBy("_range").orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)
    highest = ranged.join(tops, "_range").withColumn("b", F.greatest("_top", F.max("best").over(upto)))
    ahead = kept(highest.where("best is null and b._v > _at").select("_at", "b"), "ahead")
    paths = follow(at.select(F.col("_at").alias("start")), ahead.select(F.col("_at").alias("at"), F.col("b._v").alias("to")))
    named = ahead.select("b.*").distinct()
    steps = paths.where("depth > 0").join(named, F.col("at") == F.col("_v")).select("start", (F.col("depth") - 1).cast("int").alias("step"), F.col("to").alias("version"))
    return at.select("machine", F.col("_at").alias("start")).join(steps, "start").select("machine", "step", "version")


def offending_chars(line: Column) -> Column:
    """Characters beyond ASCII that aren't allowed, with their kind."""
    found = F.regexp_extract_all(line, F.lit(f"[^\\x00-\\x7F{ALLOWED}]"), F.lit(0))
    kind = lambda ch: F.when(ch.rlike(r"^[À-ɏḀ-ỿ]$") & ~ch.rlike("^[×÷ĐđĦħıĸŁłŊŋŒœŦŧÆæØøÐðÞþß]$"), "accented letter").when(ch.rlike(r"^\p{L}$"), "non-Latin letter").otherwise("unexpected symbol")
    return F.transform(found, lambda ch: F.struct(ch.alias("ch"), kind(ch).alias("kind")))


def offending_words(line: Column) -> Column:
    words = F.regexp_extract_all(F.lower(line), F.lit("[a-z]+"), F.lit(0))
    return F.array_sort(F.array_intersect(F.array_distinct(words), F.array(*map(F.lit, FOREIGN))))


def lint_documents(lines: DataFrame, exemptions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings (path, n, kind, what) of lines (path, n, line) outside exempt paths, and the exemptions that no finding needed. Lines are read once; only
    those with a character beyond ASCII are searched for such."""
    line = F.col("line")
    chars = F.transform(offending_chars(line), lambda c: F.struct(c["kind"].alias("kind"), c["ch"].alias("what")))
    words = F.transform(offending_words(line), lambda w: F.struct(F.lit("word").alias("kind"), w.alias("what")))
    none = F.array().cast("array<struct<kind:string,what:string>>")
    found = F.concat(F.when(line.rlike(r"[^\x00-\x7F]"), chars).otherwise(none), words)
    every = lines.select("path", "n", F.explode(found).alias("f")).select("path", "n", "f.kind", "f.what")
    return every.join(exemptions, "path", "left_anti"), exemptions.join(every.select("path").distinct(), "path", "left_anti")
