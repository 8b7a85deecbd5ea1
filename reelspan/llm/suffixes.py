"""Suffix-array dedup: a radix sort of suffixes that stops at the threshold; equal groups are exactly the repeated windows.

Windows of DEPTH bytes are dealt out by the smallest hash of their GRAM-byte strings, as runs of windows that stand next to each
other, so that a byte is sent about three times instead of fifty. Strings that would place more than GROUP windows, counted over
all texts, give way: their windows are dealt by the smallest hash of FINE bytes as well. A task drops windows whose fingerprint stands
alone and sorts the rest by most significant digits of eight bytes, keeping only groups of more than one window after each pass. Before
anything is sent, each task sorts what it has read itself: a window that a smaller document of the same task holds is settled
there, so that a passage that many documents share leaves each task once.

Partitions are as many as the texts need at PARTITION bytes each, a partition is compared a cell at a time, and equal windows of a cell
are settled before more are taken in, so that a task holds as much of a large table as of a small one.
"""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, lean, offsets_of, width

#: Bytes of a repeated string; bytes of the strings whose smallest hash places a window, and where those are frequent; windows in a run at most.
DEPTH, GRAM, FINE, RUN = 50, 8, 16, 200
#: Windows that a string of GRAM bytes may place, and that are compared at once unless more of them differ.
GROUP, LIMIT = 1_000_000, 2_000_000
#: Bytes of text that a task sorts before it sends.
CHUNK = 5_000_000
#: Positions whose hashes are computed at once.
BLOCK = 1 << 14
#: Bytes of text for each partition; cells into which a partition's windows are dealt, so that one cell at a time is compared.
PARTITION, CELLS = 16_000_000, 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PLACES = [(0x9E3779B97F4A7C15 * k * k + 0x632BE59BD9B4E019 * k | 1) % (1 << 64) for k in range(1, 8)]


def _blocks(n: int):
    """Ranges of BLOCK positions, small enough to stay in a core's cache."""
    return ((a, min(a + BLOCK, n)) for a in range(0, n, BLOCK))


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number, first byte highest; positions in the last seven are filled with zeros."""
    out = np.empty(len(raw), "u8")
    x = np.concatenate([raw, np.zeros(15, "u1")])
    for a, b in _blocks(len(raw)):
        for k in range(8):
            into = out[a + k : b : 8]
            into[:] = x[a + k : a + k + 8 * len(into)].view(">u8")
    return out


def _fingerprints(eights: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Fingerprint of the DEPTH bytes from each start (ascending), built from those of the 8, 16 and 32 bytes from every position."""
    out, done = np.zeros(len(start), "u8"), 0
    for a, b in _blocks(max(len(eights) - DEPTH + 8, 0)):
        upto = int(np.searchsorted(start, b))
        if upto == done:
            continue
        total = eights[a : b + DEPTH - 8]
        for k, step in enumerate((8, 16, DEPTH - 32)):
            total = total[: len(total) - step] * np.uint64(_PLACES[k]) + total[step:] * np.uint64(_PLACES[k + 3])
            total ^= total >> np.uint64(29)
        out[done:upto] = total[start[done:upto] - a] * _ODD
        done = upto
    return out


def _not_alone(prints: np.ndarray) -> np.ndarray:
    """Indices of fingerprints of which there may be more than one."""
    bits = max(int(len(prints) - 1).bit_length(), 1)
    low = np.uint64((1 << bits) - 1)
    both = prints & ~low
    both |= np.arange(len(prints), dtype="u8")
    both.sort()
    same = (both[1:] ^ both[:-1]) <= low
    twice = np.zeros(len(prints), bool)
    twice[(both[1:][same] & low).astype("i8")] = True
    twice[(both[:-1][same] & low).astype("i8")] = True
    return np.flatnonzero(twice)


def equal_groups(eights: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that aren't alone and, for each, the number of its group of equal windows: one radix pass per eight bytes, the last
    of fewer, over the groups that are left."""
    kept = _not_alone(_fingerprints(eights, start))
    group = np.zeros(len(kept), "i8")
    for at in (*range(0, DEPTH - 8, 8), DEPTH - 8):
        digit = eights[start[kept] + at]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        mixed = np.flatnonzero((~np.logical_and.reduceat(digit == digit[first][group], first))[group]) if len(kept) else first
        if len(mixed):  # groups of one digit stay as they are
            by = np.arange(len(kept))
            by[mixed] = mixed[np.lexsort((digit[mixed], group[mixed]))]
            kept, digit = kept[by], digit[by]
        new = np.ones(len(kept), bool)
        new[1:] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        group = np.cumsum(new) - 1
        several = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
        if not several.all():
            kept, group = kept[several], group[several]
            group = np.cumsum(np.diff(group, prepend=-1) != 0) - 1
    return kept, group


def repeated(eights: np.ndarray, start: np.ndarray, of: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a smaller document holds each window; of: the place among `doc` of each window's document."""
    kept, group = equal_groups(eights, start)
    found = np.zeros(len(start), bool)
    if len(kept):
        least, order = np.full(int(group.max()) + 1, np.iinfo("i8").max), doc[of[kept]]
        np.minimum.at(least, group, order)
        found[kept] = order > least[group]
    return found


def _runs(flag: np.ndarray, start: np.ndarray, limit: int, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and number of windows of runs of flagged windows that stand next to each other and agree in `same`."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(start[at]) != 1)
    for x in same:
        new[1:] |= x[at[1:]] != x[at[:-1]]
    first = np.flatnonzero(new)
    size = np.diff(first, append=len(at))
    if limit and len(size) and size.max() > limit:
        parts = -(-size // limit)
        k = flat(np.zeros(len(parts), "i8"), parts)
        first, size = np.repeat(first, parts) + k * limit, np.minimum(np.repeat(size, parts) - k * limit, limit)
    return at[first], size


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Smallest of the n values from every position on."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def _hashes(eights: np.ndarray, size: int) -> np.ndarray:
    """32 bits for the `size` bytes from every position; sizes are multiples of eight."""
    x, n = eights * _ODD, len(eights) - size + 8
    for k in range(8, size, 8):
        x = (x[:n] ^ (x[:n] >> np.uint64(31)) ^ eights[k : k + n]) * _ODD
    x = (x >> np.uint64(32)).astype("u4")
    return (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)


def _places(eights: np.ndarray, start: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Smallest hash of the strings of `size` bytes in each window."""
    out, n = np.zeros(len(eights), "u4"), DEPTH - size + 1
    for a, b in _blocks(max(len(eights) - DEPTH + 8, 0)):
        x = _least(_hashes(eights[a : b + DEPTH - 8], size), n)
        out[a : a + len(x)] = x
    return out[start]


def _stretches(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and number of windows that agree in their place, next to each other."""
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, "i8")
    return first, np.diff(first, append=len(place))


def _refined(eights: np.ndarray, start: np.ndarray, place: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Places, finer ones where the string of GRAM bytes is frequent (sorted hashes)."""
    if not len(frequent) or not len(place):
        return place
    first, size = _stretches(place)
    at = np.minimum(np.searchsorted(frequent, place[first]), len(frequent) - 1)
    often = np.repeat(frequent[at] == place[first], size)
    fine = (place[often] ^ _places(eights, start, FINE)[often]) * np.uint32(0x9E3779B1)
    out = place.copy()
    out[often] = fine ^ (fine >> np.uint32(16))
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane, so that equal high bytes stand together."""
    planes = [np.ascontiguousarray(a.view("u1").reshape(len(a), a.itemsize).T).tobytes() if len(a) else b"" for a in arrays]
    return zstandard.ZstdCompressor(level=5).compress(b"".join([np.array([len(a) for a in arrays], "<i8").tobytes(), *planes]))


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = np.frombuffer(raw, "<i8", len(kinds)), 8 * len(kinds), []
    for n, k in zip(sizes.tolist(), kinds):
        width = np.dtype(k).itemsize
        planes = np.frombuffer(raw, "u1", n * width, at)
        out.append(planes if width == 1 else np.ascontiguousarray(planes.reshape(width, n).T).view(k).ravel())
        at += n * width
    return out


PACKED = "kind int, part int, cell int, packed binary"
_TYPES = (pa.int32(), pa.int32(), pa.int32(), pa.binary())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], ["kind", "part", "cell", "packed"])


def _key(doc: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Number of a row: its doc_id and 32 bits of its text's hash, which tell rows of one doc_id apart."""
    return (doc.astype("i8").view("u8") * _ODD + check.astype("u8")).view("i8")


def _settled(doc: np.ndarray, check: np.ndarray, begin: np.ndarray, size: np.ndarray, parts: int) -> list[tuple]:
    """Rows of kind 1: stretches of repeated windows, by the partition of their document."""
    key, part = _key(doc, check), np.mod(doc ^ (doc >> 7), parts)
    by = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[by], prepend=-1, append=parts + 1))
    return [(1, int(part[by[a]]), 0, _pack(key[by[a:b]], begin[by[a:b]], size[by[a:b]])) for a, b in zip(cuts[:-1], cuts[1:])] if len(by) else []


def _chunks(batches):
    """(check, doc_id, text) -> raw bytes, bounds, checks and doc_ids of about CHUNK bytes; a longer text is a chunk of its own."""
    held, total = [], 0
    for batch in batches:
        raw, ends = offsets_of(batch.column(2))
        check, doc = (batch.column(k).to_numpy(zero_copy_only=False).astype("i8") for k in (0, 1))
        a = 0
        while a < len(doc):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK - total, "right")) - 1)
            b = min(b, len(doc))
            held.append((raw[ends[a] : ends[b]], np.diff(ends[a : b + 1]), check[a:b], doc[a:b]))
            total += int(ends[b] - ends[a])
            a = b
            if total >= CHUNK:
                yield _joined(held)
                held, total = [], 0
    if held:
        yield _joined(held)


def _windows(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The eight bytes from each position, and start and document of each window."""
    windows = np.maximum(np.diff(bounds) - DEPTH + 1, 0)
    return _eights(raw), flat(bounds[:-1], windows), np.repeat(np.arange(len(windows), dtype="i4"), windows)


def _count(total: int, group: int):
    """(check, doc_id, text) -> windows that a string of GRAM bytes places in a chunk. Counts are left out that stay below the share of the chunk
    in half of GROUP, so that half of GROUP is missed at most."""

    def run(batches):
        for raw, bounds, _, _ in _chunks(batches):
            eights, start, _ = _windows(raw, bounds)
            place = _places(eights, start)
            first, size = _stretches(place)
            value, at = np.unique(place[first], return_inverse=True)
            n = np.bincount(at, weights=size, minlength=len(value)).astype("i8")
            told = n * 2 * total >= group * len(raw)
            yield pa.RecordBatch.from_arrays([pa.array(value[told].astype("i8")), pa.array(n[told])], ["place", "n"])

    return run


def _send(parts: int, told):
    """(check, doc_id, text) -> settled stretches (kind 1) and runs of windows that are left to compare (kind 0), a row for a partition's cells."""

    def rows(raw, bounds, check, doc):
        eights, start, of = _windows(raw, bounds)
        if not len(start):
            return []
        known = repeated(eights, start, of, doc)
        first, n = _runs(known, start, 0, of)
        rows = _settled(doc[of[first]], check[of[first]], (start[first] - bounds[of[first]]).astype("<i8"), n.astype("<i8"), parts)
        place = _refined(eights, start, _places(eights, start), told.value)
        first, n = _runs(~known, start, RUN, of, place)
        cell = (place[first].astype("u8") * _ODD >> np.uint64(20)) % np.uint64(parts * CELLS)
        by = np.lexsort((of[first], place[first], cell))
        first, n, cell = first[by], n[by], cell[by].astype("i8")
        cuts = np.flatnonzero(np.diff(cell // CELLS, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            f, m = first[a:b], n[a:b]
            text = raw[flat(start[f], m + DEPTH - 1)]
            at = start[f] - bounds[of[f]]
            cells = np.bincount(cell[a:b] % CELLS, minlength=CELLS).astype("<i4")
            rows.append((0, int(cell[a]) // CELLS, 0, _pack(cells, text, m.astype("u1"), doc[of[f]], check[of[f]].astype("<u4"), at.astype("<i4"))))
        return rows

    def run(batches):
        for piece in _chunks(batches):
            if found := rows(*piece):
                yield _batch(found)

    return run


def _joined(held):
    raw, size, check, doc = (np.concatenate(x) for x in zip(*held))
    return raw, np.concatenate([[0], np.cumsum(size)]), check, doc


def _divided(packed: bytes) -> list[tuple[np.ndarray, ...]]:
    """text, n, doc, check and at of each cell's runs."""
    cells, text, n, *rest = _unpack(packed, "<i4", "u1", "u1", "<i8", "<u4", "<i4")
    runs, ends = np.concatenate([[0], np.cumsum(cells)]), np.concatenate([[0], np.cumsum(n.astype("i8") + DEPTH - 1)])
    return [(text[ends[a] : ends[b]], n[a:b], *(x[a:b] for x in rest)) for a, b in zip(runs[:-1], runs[1:])]


def _fold(pieces):
    """Runs of a cell, a list of which is used up -> stretches (doc, check, begin, size) that a smaller document holds. LIMIT windows are compared at
    once; those that aren't settled go on beside the next, twice as many at least."""
    held, count, limit = [], 0, LIMIT
    while pieces:
        held.append(pieces.pop())
        count += int(held[-1][1].sum(dtype="i8"))
        if pieces and count < limit:
            continue
        text, n, doc, check, at = (np.concatenate(x) for x in zip(*held))
        held.clear()
        n = n.astype("i8")
        begin = np.cumsum(n + DEPTH - 1) - (n + DEPTH - 1)
        start, of = flat(begin, n), np.repeat(np.arange(len(n), dtype="i4"), n)
        found = repeated(_eights(text), start, of, doc)
        first, size = _runs(found, start, 0, of)
        run = of[first]
        yield doc[run], check[run], at[run] + start[first] - begin[run], size
        if pieces:
            first, size = _runs(~found, start, 0, of)
            run = of[first]
            held.append((text[flat(start[first], size + DEPTH - 1)], size.astype("u1"), doc[run], check[run], (at[run] + start[first] - begin[run]).astype("<i4")))
            count = int(size.sum())
            limit = max(LIMIT, 2 * count)


def _compare(parts: int):
    """Rows sorted by partition and kind: those of kind 0 -> stretches that a smaller document holds (kind 1); the others go on."""

    def part(cells):
        done = []
        while cells:
            done.extend(_fold(cells.pop()))
        doc, check, begin, size = (np.concatenate(x) for x in zip(*done))
        return _settled(doc, check, begin.astype("<i8"), size.astype("<i8"), parts)

    def run(batches):
        at, held = None, [[] for _ in range(CELLS)]
        for batch in batches:
            for kind, p, packed in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(3)):
                if kind:
                    yield _batch([(kind, p, 0, packed.as_py())])
                    continue
                if p != at:
                    if any(held) and (rows := part([x for x in held if x])):
                        yield _batch(rows)
                    at, held = p, [[] for _ in range(CELLS)]
                for x, piece in zip(held, _divided(packed.as_py())):
                    if len(piece[1]):
                        x.append(piece)
        if any(held) and (rows := part([x for x in held if x])):
            yield _batch(rows)

    return run


def _ship(parts: int):
    """(check, doc_id, text) of all documents -> rows of kind 2: the documents of each partition, packed together, CHUNK bytes at a time."""

    def rows(raw, ends, check, doc, named):
        size = np.diff(ends)
        part = np.where(named, np.mod(doc ^ (doc >> 7), parts), check % parts)
        by = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[by], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            i = by[a:b]
            yield _batch([(2, int(part[i[0]]), 0, _pack(raw[flat(ends[i], size[i])], size[i].astype("<i8"), doc[i], check[i], named[i].astype("u1")))])

    def run(batches):
        for batch in batches:
            raw, ends = offsets_of(batch.column(2))
            check = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<u4")
            named = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            doc = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
            a = 0
            while a < len(doc):
                b = min(max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK, "right")) - 1), len(doc))
                yield from rows(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a], check[a:b], doc[a:b], named[a:b])
                a = b

    return run


def _cut(rest: bool):
    """A partition's settled stretches first, then its documents: what is left of each."""

    def run(batches):
        at, held, by = None, [], None
        for batch in batches:
            for kind, part, packed in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(3)):
                if part != at:
                    at, held, by = part, [], None
                if kind == 1:
                    held.append(_unpack(packed.as_py(), "<i8", "<i8", "<i8"))
                    continue
                if by is None:
                    key, begin, size = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, "i8"),) * 3
                    held = []
                    order = np.lexsort((begin, key))
                    by = (key[order], begin[order], size[order])
                docs = _unpack(packed.as_py(), "u1", "<i8", "<i8", "<u4", "u1")
                for k in range(0, len(docs[1]), 500):
                    yield _documents(docs, k, k + 500, *by, rest)

    return run


def _documents(docs, a, b, key, begin, size, rest):
    raw, sizes, names, check, named = docs
    ends = np.concatenate([[0], np.cumsum(sizes)])
    own = _key(names[a:b], check[a:b])
    first, last = np.searchsorted(key, own, "left"), np.searchsorted(key, own, "right")
    out = []
    for i, (doc, known) in enumerate(zip(names[a:b].tolist(), named[a:b].tolist())):
        text = raw[ends[a + i] : ends[a + i + 1]]
        steps = np.zeros(len(text) + 1, "i4")
        if known and last[i] > first[i]:
            at = slice(first[i], last[i])
            np.add.at(steps, begin[at], 1)
            np.add.at(steps, begin[at] + size[at] + DEPTH - 1, -1)
        gone = np.cumsum(steps[:-1]) > 0
        left = text[~gone].tobytes()
        spans = int((np.diff(gone.astype("i1"), prepend=0) == 1).sum())
        out.append((doc if known else None, len(text), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), *([left] if rest else [])))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if rest else []))
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if rest else [])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], columns)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): each document without the bytes that a string of 50 bytes covers
    which a document of a smaller doc_id holds too.

    Texts are UTF-8 bytes, null is empty, matches never cross documents and are judged on the input. Rows that share a doc_id
    aren't smaller than each other, so repeated rows lose the same bytes. Rows without doc_id lose nothing and prove nothing.
    kept (with rest): the bytes that are left. Other columns are not read; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("check", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)))
    sound = own.where("doc_id is not null and octet_length(text) >= 50").select("check", "doc_id", "text")
    total = sound.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(width(spark), total // PARTITION)
    told = spark.sparkContext.broadcast(_frequent(sound, total))
    dealt = sound.mapInArrow(lean(_send(parts, told)), PACKED).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind")
    settled = dealt.mapInArrow(lean(_compare(parts)), PACKED)
    rows = own.select("check", "doc_id", "text").mapInArrow(lean(_ship(parts)), PACKED)
    both = settled.union(rows).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * rest
    return both.mapInArrow(lean(_cut(rest)), schema)


def _frequent(sound: DataFrame, total: int) -> np.ndarray:
    """Hashes of strings that place GROUP windows or more of the `total` bytes, some of half as many too, ascending; at most 2 * total / GROUP."""
    if total < GROUP:
        return np.zeros(0, "u4")
    counts = sound.mapInArrow(lean(_count(total, GROUP)), "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    return np.sort(counts.where(F.col("n") >= GROUP // 2).select("place").toPandas()["place"].to_numpy().astype("u4"))


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM d, unnest(range(greatest(0, length(h) // 2 - 49))) AS r(i)),
m AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
f AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM w JOIN m USING (s) WHERE doc_id > low),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM r),
t AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS n, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
