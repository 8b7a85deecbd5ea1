"""N-gram Jaccard join by a token-group matrix: similar documents form groups, each group keeps the union of its members'
tokens, a query's overlap with that union is bounded, and only groups that can hold a partner are opened.

A token is the hash of a word shingle. Tokens have one order over the corpus, rare ones first (by a table of counts of fixed
size, then by hash). Two sets with Jaccard similarity 0.8 or more that differ in their first quarter of that order could not
share enough of the rest, so that only these prefixes enter the matrix.

Equal sets are one set: a task first keeps one of those it reads, then one is left over all tasks. Groups grow around centres,
the sets of the commonest tokens among those that share a min-hash: sets similar to a centre are linked with it, sets at least
half like it belong to its group. The matrix then holds (token, group); the sets that its bound leaves are compared on their
whole tokens, block by block, within the groups that they open.
"""

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, flat, lean, without, written

WORDS, SIMILAR = 5, 80
#: Slots of the table of counts that orders tokens; min-hashes of a set, and how many two sets must share to be tried as centre
#: and member; leaders that a batch keeps for one min-hash (what these leave apart falls to the matrix, which is exact);
#: similarity from which a set belongs to a centre's group.
SLOT_BITS, HASHES, AGREE, LEADERS, NEAR = 16, 6, 2, 3, 50
#: Parts into which the members of a centre are dealt; tokens of a block of sets that are compared at once.
SALTS, BLOCK = 64, 250_000
#: Rows among which a task looks for equal and similar sets before it sends; words whose hash a task remembers.
CHUNK, REMEMBERED = 2_000, 100_000
_SALT = np.array([int(xxhash.xxh64_intdigest(f"word {j}")) | 1 for j in range(WORDS)], "u8")
_HASH = np.array([int(xxhash.xxh64_intdigest(f"hash {j}")) | 1 for j in range(HASHES)], "u8")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingles:
    """Distinct tokens of texts; hashes of words are remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        self.known[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def tokens(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Hashes of the words of all texts, of the shingle from each word (texts run on), and words of each text."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        # bytes.lower() and bytes.split() know ASCII only: A-Z, and \\x20 and \\x09-\\x0D
        split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        sizes = [len(s) for s in split]
        get = self.known.get
        code = np.fromiter((h if (h := get(w)) is not None else self._hash(w) for s in split for w in s), "u8", sum(sizes))
        token = np.zeros(max(len(code) - WORDS + 1, 0), "u8")
        for j in range(WORDS):
            token += code[j : j + len(token)] * _SALT[j]
        return code, _mix(token), sizes

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        code, token, sizes = self.tokens(texts)
        out, at = [], 0
        for n in sizes:
            if n >= WORDS:
                out.append(np.unique(token[at : at + n - WORDS + 1]))
            elif n:
                out.append(_mix(np.array([(code[at : at + n] * _SALT[:n]).sum() + np.uint64(n)], "u8")))
            else:
                out.append(np.zeros(0, "u8"))
            at += n
        return out


def _batches(batches, rows: int = 500):
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def shared_tokens(x: np.ndarray, y: np.ndarray) -> int:
    """Tokens that two sorted sets share."""
    at = np.searchsorted(x, y)
    return int((x[np.minimum(at, len(x) - 1)] == y).sum()) if len(x) else 0


def reaches(x: np.ndarray, y: np.ndarray, percent: int = SIMILAR) -> bool:
    both = shared_tokens(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both) and both > 0


def slack(n: int) -> int:
    """Tokens that two prefixes must share at least; a set's prefix is that much longer."""
    return 1 + n // 20


def token_counts(docs: DataFrame) -> np.ndarray:
    """Shingles by slot of their tokens, over the whole corpus; the table's size doesn't depend on it. Shingles across the ends of two
    texts in a batch count too, which changes the order but not what is found."""

    def run(batches):
        shingles, total = Shingles(), np.zeros(1 << SLOT_BITS, "i8")
        for part in _batches(batches):
            _, token, _ = shingles.tokens(part.column(0).to_pylist())
            total += np.bincount((token >> np.uint64(64 - SLOT_BITS)).astype("i8"), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(total[at])], ["slot", "n"])

    counts = np.zeros(1 << SLOT_BITS, "i8")
    for r in docs.select("text").mapInArrow(lean(run), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[r["slot"]] = r["n"]
    return counts


def min_hashes(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES min-hashes of each set, -1 for empty ones."""
    size = np.array([len(x) for x in sets], "i8")
    out = np.full((len(sets), HASHES), -1, "i4")
    if size.any():
        token, begin = np.concatenate(sets), (np.cumsum(size) - size)[size > 0]
        for j in range(HASHES):
            out[size > 0, j] = np.minimum.reduceat((_mix(token ^ _HASH[j]) >> np.uint64(33)).astype("i4"), begin)
    return out


def _leaders(sets: list[np.ndarray], hashes: np.ndarray, common: np.ndarray, own: list[int]) -> list[int]:
    """For each set of a batch a similar one of the same batch, which leads it, or itself; sets of commoner tokens lead."""
    lead, tables = list(range(len(sets))), [{} for _ in range(HASHES)]
    rows = hashes.tolist()
    for i in sorted(own, key=lambda i: -common[i]):
        row, tried = rows[i], set()
        for table, h in zip(tables, row):
            for k in table.get(h, ()):
                if k not in tried and lead[i] == i:
                    tried.add(k)
                    if sum(a == b for a, b in zip(row, rows[k])) >= AGREE and reaches(sets[i], sets[k]):
                        lead[i] = k
        if lead[i] == i:
            for table, h in zip(tables, row):
                if len(known := table.setdefault(h, [])) < LEADERS:
                    known.append(i)
    return lead


SIGNATURE = "doc_id long, n long, sid long, home long, lead long, common float, hashes array<int>, prefix array<long>, packed binary"


def signatures(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """(doc_id, text) -> one row per document: n, size of its set; sid, name of its set (64 bits of its digest; a set of its own
    where it is empty); home, the smallest doc_id of the equal sets of this batch. The row of that doc_id also has lead, the sid of a
    similar set of the batch or its own; common, how common its tokens are; hashes; prefix, the first 48 bits of its leading
    tokens; and packed, its text.
    """
    weight = np.log1p(rank).astype("f4")

    def run(batches):
        shingles, press = Shingles(), zstandard.ZstdCompressor(level=3)
        for batch in _batches(batches, CHUNK):
            doc = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            sets = [x for a in range(0, len(texts), 500) for x in shingles.sets(texts[a : a + 500])]
            sid = [int.from_bytes(xxhash.xxh3_128_digest(x.tobytes() if len(x) else b"empty %d" % (d or 0))[:8], "little", signed=True) for d, x in zip(doc, sets)]
            first: dict[int, int] = {}
            for i, s in enumerate(sid):
                if doc[i] is not None and ((k := first.get(s)) is None or doc[i] < doc[k]):
                    first[s] = i
            home = [doc[first[s]] if d is not None else None for d, s in zip(doc, sid)]
            carries = [d is not None and first[s] == i for i, (d, s) in enumerate(zip(doc, sid))]
            slots = [(x >> np.uint64(64 - SLOT_BITS)).astype("i8") for x in sets]
            common = np.array([weight[x].mean() if len(x) else 0 for x in slots], "f4")
            hashes = min_hashes(sets)
            own = [i for i, c in enumerate(carries) if c and len(sets[i])]
            lead = _leaders(sets, hashes, common, own)
            prefix = [(x[np.argsort(rank[t], kind="stable")[: prefix_size(len(x))]] >> np.uint64(16)).view("i8") if c else None for c, x, t in zip(carries, sets, slots)]
            packed = [press.compress(t.encode("utf-8", "surrogatepass")) if c and len(x) else None for c, t, x in zip(carries, texts, sets)]
            columns = [
                batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(sid, pa.int64()), pa.array(home, pa.int64()),
                pa.array([sid[k] if c else None for c, k in zip(carries, lead)], pa.int64()), pa.array(common),
                pa.array([h if c and n else None for c, h, n in zip(carries, hashes.tolist(), map(len, sets))], pa.list_(pa.int32())),
                pa.array(prefix, pa.list_(pa.int64())), pa.array(packed, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "sid", "home", "lead", "common", "hashes", "prefix", "packed"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), SIGNATURE)


def prefix_size(n: int) -> int:
    return n - (-(-SIMILAR * n // 100)) + slack(n) if n else 0


def _open(press: zstandard.ZstdDecompressor, packed: bytes) -> str:
    return press.decompress(packed).decode("utf-8", "surrogatepass")


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, packed) of the wanted sids, one row each. rows: signatures."""
    found = rows.where("packed is not null").select("sid", "packed").join(wanted, "sid", "left_semi")
    return found.dropDuplicates(["sid"])


def centres(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) to try: of the sets that share a min-hash, b and the one of the commonest tokens, a. One pair at most for each set
    and min-hash, whatever the size of the bucket."""
    one = F.struct("common", "sid", "n", "hashes")
    dealt = sets.select(F.posexplode("hashes").alias("j", "h"), one.alias("own"))
    best = dealt.groupBy("j", "h").agg(F.max("own").alias("best"), F.count("*").alias("held")).where("held > 1").drop("held")
    agree = F.aggregate(F.zip_with("own.hashes", "best.hashes", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    near = dealt.join(best, ["j", "h"]).where("own.sid <> best.sid").where(f"100 * least(own.n, best.n) >= {NEAR} * greatest(own.n, best.n)")
    return near.where(agree >= AGREE).select(F.col("best.sid").alias("a"), F.col("own.sid").alias("b")).distinct()


def verify(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b) -> (a, b, percent) of the pairs whose sets are NEAR or nearer: percent is the Jaccard similarity rounded down.

    The members of a centre are dealt into SALTS parts; each part gets the centre's text once and streams the members'.
    """

    def run(batches):
        shingles, press = Shingles(), zstandard.ZstdDecompressor()
        head, centre = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 300):
                part, found = batch.slice(at, 300), []
                sets = shingles.sets([_open(press, p) for p in part.column(3).to_pylist()])
                for a, b, own in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), sets):
                    if b is None:
                        head, centre = a, own
                    elif a == head:
                        both = shared_tokens(centre, own)
                        if (percent := 100 * both // (len(centre) + len(own) - both)) >= NEAR:
                            found.append((a, b, percent))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b", "percent"])

    salted = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    texts = written(_texts(rows, wanted), "texts")
    heads = salted.select("a", "part").distinct().join(texts.withColumnRenamed("sid", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "packed")
    members = salted.join(texts.withColumnRenamed("sid", "b"), "b").select("a", "part", "b", "packed")
    dealt = heads.union(members).repartition("a", "part").sortWithinPartitions("a", "part", "b")
    done = written(dealt.mapInArrow(lean(run), "a long, b long, percent long"), "verified")
    discard(texts)
    return done


def _rest(n: str) -> str:
    """SQL: tokens of a set of n that its prefix leaves out."""
    return f"(({SIMILAR} * {n} + 99) div 100 - 1 - {n} div 20)"


def _may_reach(n: str, m: str, spare: int = 0) -> str:
    """SQL: whether sets of n and m whose prefixes share `both` tokens can be similar. Shared tokens are in both prefixes or come after
    the end of the prefix that ends first, where that set has no more than its rest."""
    need = f"({SIMILAR} * ({n} + {m}) + {99 + SIMILAR}) div {100 + SIMILAR}"
    return f"(both + {spare} >= 1 + least({n}, {m}) div 20 and both + {spare} + greatest({_rest(n)}, {_rest(m)}) >= {need})"


def opened(prefixes: DataFrame) -> DataFrame:
    """(num, n, label, grp, prefix) -> (num, other): groups that can hold a partner of another label for each set.

    The matrix has a row for each token and group, with the smallest and largest set and label that hold the token there. Tokens
    of one label only are no rows of it. A hot token is rare in prefixes, which start with the rarest. Rows are sent small: a set
    by its number, its label only where other sets have it too, its group only where it isn't its label.
    """
    held = prefixes.select(F.explode("prefix").alias("token"), F.expr("nullif(label, num)").alias("l"), F.expr("nullif(grp, label)").alias("g"), "num", "n").repartition("token")
    label = F.coalesce("l", "num")
    held = held.select("token", "num", "n", label.alias("label"), F.coalesce("g", label).alias("grp"))
    union = held.groupBy("token", F.col("grp").alias("other")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("least"), F.max("label").alias("most"))
    by = Window.partitionBy("token")
    matrix = union.withColumns({"l": F.min("least").over(by), "m": F.max("most").over(by)}).where("l <> m").drop("l", "m")
    # in its own group a set looks for holders of another label
    asked = held.join(matrix, "token").where(f"(grp <> other or label <> least or label <> most) and 100 * high >= {SIMILAR} * n and {SIMILAR} * low <= 100 * n")
    bound = asked.groupBy("num", "n", "other").agg(F.count("*").alias("both"), F.min("low").alias("low"), F.max("high").alias("high"))
    # what a member needs falls on either side of n (but for rounding, hence the spare tokens), so that the smallest and the largest
    # possible member decide
    bound = bound.withColumns({"low": F.expr(f"greatest(low, ({SIMILAR} * n + 99) div 100)"), "high": F.expr(f"least(high, 100 * n div {SIMILAR})")})
    return bound.where(f"{_may_reach('n', 'low', 2)} or {_may_reach('n', 'high', 2)}").select("num", "other")


def compare(asking: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) between similar sets of different labels in the groups that they open. asking: (sid, n, label, grp, other).

    Of two groups, the sets that open each other's group meet; within a group, the sets outside the label that gave the group its
    name meet all. Each side is dealt into blocks of about BLOCK tokens and each pair of blocks is one task's share: the first
    block is indexed by token, the second is streamed past it.
    """

    def index(sets, labels):
        token = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        by = np.argsort(token, kind="stable")
        token, start = np.unique(token[by], return_index=True)
        return token, start, np.diff(start, append=len(by)), owner[by], np.array([len(x) for x in sets]), np.array(labels)

    def look(held, names, known, sets, labels, members):
        token, start, count, owner, size, label = held
        for own, mark, name in zip(sets, labels, members):
            at = np.minimum(np.searchsorted(token, own), len(token) - 1)
            at = at[token[at] == own]
            both = np.bincount(owner[flat(start[at], count[at])], minlength=len(size))
            for k in np.flatnonzero((100 * both >= SIMILAR * (size + len(own) - both)) & (both > 0) & (label != mark)):
                pair = (int(label[k]), mark)
                if pair not in known:  # one link joins two labels
                    known.add(pair)
                    yield names[k], name

    def run(batches):
        shingles, press = Shingles(), zstandard.ZstdDecompressor()
        at, first, held, known = None, [], None, set()
        for batch in batches:
            for a in range(0, batch.num_rows, 300):
                part, links = batch.slice(a, 300), []
                sets = shingles.sets([_open(press, p) for p in part.column(7).to_pylist()])
                names, labels, sides = (part.column(k).to_pylist() for k in (5, 6, 4))
                cells = list(zip(*(part.column(k).to_pylist() for k in range(4))))
                for cell, side, name, mark, own in zip(cells, sides, names, labels, sets):
                    if cell != at:
                        at, first, held, known = cell, [], None, set()
                    if side == 0:
                        first.append((own, mark, name))
                    elif first:
                        held = held or index([x[0] for x in first], [x[1] for x in first])
                        links += look(held, [x[2] for x in first], known, [own], [mark], [name])
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    pair = [F.least("grp", "other").alias("g"), F.greatest("grp", "other").alias("h")]
    across = asking.where("grp <> other").select(*pair, (F.col("grp") > F.col("other")).cast("int").alias("side"), "sid", "n", "label")
    within = asking.where("grp = other").select(*pair, F.lit(1).alias("side"), "sid", "n", "label")
    sides = across.union(within).union(asking.where("grp = other and label <> grp").select(*pair, F.lit(0), "sid", "n", "label"))
    cells = sides.groupBy("g", "h").agg(*(F.sum(F.when(F.col("side") == k, F.col("n"))).alias(f"n{k}") for k in (0, 1)))
    blocks = cells.where("n0 is not null and n1 is not null").select("g", "h", *(F.expr(f"1 + n{k} div {BLOCK}").cast("int").alias(f"b{k}") for k in (0, 1)))
    own = F.pmod(F.xxhash64("sid"), F.when(F.col("side") == 0, F.col("b0")).otherwise(F.col("b1"))).cast("int")
    across = F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("b1")).otherwise(F.col("b0")) - 1)
    met = written(sides.join(blocks, ["g", "h"]).select("g", "h", "side", "sid", "label", own.alias("own"), across.alias("meets")), "met")
    texts = _texts(rows, met.select("sid").distinct())
    dealt = met.join(texts, "sid").withColumn("meets", F.explode("meets"))
    dealt = dealt.select("g", "h", *(F.when(F.col("side") == k, F.col("own")).otherwise(F.col("meets")).alias(f"i{k}") for k in (0, 1)), "side", "sid", "label", "packed")
    found = dealt.repartition("g", "h", "i0", "i1").sortWithinPartitions("g", "h", "i0", "i1", "side", "sid").mapInArrow(lean(run), "a long, b long")
    done = written(found, "compared")
    discard(met)
    return done


def _labels(sets: DataFrame, parts: DataFrame) -> DataFrame:
    return sets.join(parts.withColumnRenamed("id", "num"), "num", "left").withColumn("label", F.coalesce("component_id", "num")).drop("component_id")


def join_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): documents are linked when the Jaccard similarity of their sets of five-word shingles
    is 0.8 or more; component_id is the smallest doc_id that links reach.

    Fewer than five words are one shingle; null texts and texts without words have none and link with nothing. Rows without a
    doc_id link with nothing and have no component. Repeated rows, and rows that share a doc_id, are one document and get
    the same component. Other columns are not read; an empty table gives an empty one. No similar pair of different
    components is left: every pair that the matrix can't rule out is compared on its whole sets.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    table = written(signatures(own, token_counts(own)), "signatures")
    rows = table.where("lead is not null")  # one for each set and batch
    size = rows.groupBy("sid").agg(F.min("home").alias("node"), F.first("n").alias("n"), F.max("common").alias("common"), F.first("hashes").alias("hashes"), F.bool_or(F.col("lead") != F.col("sid")).alias("led"))
    sets = written(size.withColumn("num", F.monotonically_increasing_id()), "sets")
    tried = verify(centres(sets.where("n > 0 and not led")), rows)
    # rows of one doc_id are one document, whatever their texts
    several = table.groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("z")).where("doc_id is not null and a <> z").select("doc_id", "a")
    links = rows.select(F.col("sid").alias("a"), F.col("lead").alias("b")).union(tried.where(f"percent >= {SIMILAR}").select("a", "b"))
    links = links.union(table.join(several, "doc_id").select("a", F.col("sid").alias("b"))).where("a <> b")
    # from here on a set is its number in the table of sets, which is small and stays
    of = lambda c: sets.select(F.col("sid").alias(c), F.col("num").alias(f"{c}_num"))
    links = written(links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_num").alias("a"), F.col("b_num").alias("b")), "links")
    parts = written(components(links), "parts")
    labelled = _labels(sets.select("sid", "num", "n"), parts)
    nearest = tried.groupBy("b").agg(F.max(F.struct("percent", "a")).alias("best")).select(F.col("b").alias("sid"), F.col("best.a").alias("centre"))
    nearest = nearest.join(labelled.select(F.col("sid").alias("centre"), F.col("label").alias("grp")), "centre").drop("centre")
    grouped = written(labelled.join(nearest, "sid", "left").select("sid", "num", "n", "label", F.coalesce("grp", "label").alias("grp")), "grouped")
    prefixes = rows.where("n > 0").select("sid", "prefix").join(grouped, "sid").dropDuplicates(["sid"])
    asking = written(opened(prefixes), "opened")
    more = compare(grouped.join(asking, "num"), rows).join(of("a"), "a").join(of("b"), "b").select(F.col("a_num").alias("a"), F.col("b_num").alias("b"))
    if more.limit(1).count():
        done, parts = parts, components(links.union(more))
        discard(done)
    discard(asking, tried, grouped)
    final = _labels(sets.select("sid", "num", "node"), parts)
    least = final.groupBy("label").agg(F.min("node").alias("component_id"))
    at_home = rows.select("home", "sid").distinct().join(final.join(least, "label").select("sid", "component_id"), "sid")
    named = table.select("doc_id", F.col("n").alias("n_shingles"), "home", "sid").join(at_home, ["home", "sid"], "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each component, that with the smallest doc_id; rows without doc_id stay. All columns stay."""
    joined = join_documents(docs)
    gone = joined.where("doc_id is not null and doc_id <> component_id").select("doc_id")
    return without(docs, docs["doc_id"].cast("long"), gone, "copies")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w),
t AS (SELECT doc_id, len(sh) AS n, md5(x) AS x FROM (SELECT doc_id, sh, unnest(sh) AS x FROM s)),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c AS (SELECT doc_id AS id, doc_id AS low FROM documents UNION SELECT e.b, c.low FROM c JOIN e ON e.a = c.id WHERE c.low < e.b)
SELECT d.doc_id, len(s.sh) AS n_shingles, m.low AS component_id
FROM documents d JOIN s USING (doc_id) JOIN (SELECT id, min(low) AS low FROM c GROUP BY id) m ON m.id = d.doc_id
"""
