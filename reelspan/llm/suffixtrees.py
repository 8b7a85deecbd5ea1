"""Substring dedup by prefix-partitioned suffix trees over words.

A window of DEPTH words is a suffix of its document, cut off at that depth. Suffixes are split into groups that fit in memory by a prefix
of variable length: the smallest hash among a window's prefixes of PREFIXES[0] words names its group, unless that prefix, counted over the
whole corpus, would name more than GROUP windows; windows that have only such prefixes go by one of PREFIXES[1] words. Neighbours share a
prefix, so that they are sent as one stretch and a word is sent about three times instead of twenty. A task holds one cell of groups at a
time and grows their suffix tree from the root down, a word at each step; leaves below one deep internal node are the same repeat.
Before anything is sent, each task grows the tree of what it has read itself and settles the repeats in it, so that a passage which many
documents share leaves a task once.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, flat, lean, offsets_of, width, written
from .suffixes import _batch, _joined, _not_alone, _pack, _runs, _unpack

#: Words of a repeated window; words of the prefixes that name a group, the longer one where the shorter is too frequent.
DEPTH, PREFIXES = 20, (2, 5)
#: Windows that a shorter prefix may name; frequent prefixes that are told to every task, at most; windows of a stretch.
GROUP, FREQUENT, RUN = 50_000, 1_000_000, 200
#: Bytes of text that a task indexes before it sends; windows of a partition and cells into which it is dealt.
CHUNK, PARTITION, CELLS = 4_000_000, 3_000_000, 8
#: Positions whose hashes are computed, and words that are copied, at once.
BLOCK = 1 << 15
_ODD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint32(0xFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: White space of the contract, and a number for each other byte.
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = np.where(_SPACE, np.uint64(0), _mixed(np.arange(1, 257, dtype="u8") * _ODD))


def split_words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and length of each word; words end at white space and at the bounds of documents."""
    word = ~_SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[bounds] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | cut[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | cut[1:-1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(end) + 1 - start


def symbols(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64 bits for each word, from its bytes and their places in it; between words there is white space or nothing."""
    if not len(start):
        return np.zeros(0, "u8")
    power = np.full(int(length.max()), np.uint64(0xD6E8FEB86659FD93))
    power[0] = 1
    power = np.cumprod(power)
    out = np.empty(len(start), "u8")
    for a in range(0, len(start), 1 << 16):
        at, n = start[a : a + (1 << 16)], length[a : a + (1 << 16)]
        first = np.cumsum(n) - n
        if int(n.sum()) == int(at[-1] + n[-1] - at[0]):  # no gaps
            bytes_ = raw[at[0] : at[-1] + n[-1]]
        else:
            bytes_ = raw[flat(at, n)]
        place = np.arange(len(bytes_)) - np.repeat(first, n)
        out[a : a + len(at)] = np.add.reduceat(_BYTE[bytes_] * power[place], first)
    return _mixed(out + length.astype("u8") * _ODD)


def _spans(symbol: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the `size` symbols from every position, for each of the sizes; positions near the end have none and keep 0. A block of positions
    at a time, so that steps between need no room."""
    out = [np.empty(len(symbol), "u8") for _ in sizes]
    for a in range(0, len(symbol), BLOCK):
        for whole, part in zip(out, _block(symbol[a : a + BLOCK + max(sizes) - 1], sizes)):
            whole[a : a + BLOCK] = part[:BLOCK]
    return out


def _block(symbol: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    powers, have = {1: symbol}, 1
    join = lambda a, b, k: _mixed(a[: len(a) - k] * np.uint64(0xA0761D6478BD642F) + b[k:][: len(a) - k] * _ODD) if len(a) > k else a[:0]
    while 2 * have <= max(sizes):
        powers[2 * have] = join(powers[have], powers[have], have)
        have *= 2
    out = []
    for size in sizes:
        part, done = None, 0
        for k in sorted(powers, reverse=True):
            if size - done >= k:
                tail = powers[k][done:]
                n = max(len(symbol) - done - k + 1, 0)
                part = tail[:n] if part is None else _mixed(part[:n] * np.uint64(0xE7037ED1A0B428DB) + tail[:n])
                done += k
        whole = np.zeros(len(symbol), "u8")
        whole[: len(part)] = part
        out.append(whole)
    return out


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Smallest of the n values from every position on."""
    out, have = values, 1
    while have < n and len(out) > 1:
        step = min(have, n - have)
        out = np.minimum(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        have += step
    whole = np.full(len(values), _NONE)
    whole[: len(out)] = out
    return whole


def places(pairs: np.ndarray, longer: np.ndarray, start: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The prefix that names the group of each window: its least hash, of PREFIXES[0] words where one isn't frequent, else of PREFIXES[1]."""
    short = np.minimum((pairs >> np.uint64(32)).astype("u4"), _NONE - np.uint32(1))
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, short), len(frequent) - 1)
        short = np.where(frequent[at] == short, _NONE, short)
    out = _least(short, DEPTH - PREFIXES[0] + 1)[start]
    if len(frequent):
        out = np.where(out == _NONE, _least((longer >> np.uint64(32)).astype("u4"), DEPTH - PREFIXES[1] + 1)[start], out)
    return out


@dataclass
class Subtree:
    """Leaves in tree order, and the depth of the internal node at which each leaf parts from the leaf before it (DEPTH: nowhere, -1: the first).
    These two say the whole tree: an internal node of depth d is a longest run of leaves that part at d or deeper."""

    leaves: np.ndarray
    depth: np.ndarray

    def deep(self) -> tuple[np.ndarray, np.ndarray]:
        """Leaves below the deep internal nodes, and the number of the node of each."""
        node = np.cumsum(self.depth < DEPTH) - 1
        several = np.bincount(node, minlength=1)[node] > 1 if len(node) else np.zeros(0, bool)
        return self.leaves[several], node[several]


def grow(symbol: np.ndarray, start: np.ndarray, prints: np.ndarray) -> Subtree:
    """Suffix tree, down to DEPTH words, of those windows whose fingerprint doesn't stand alone. From the root down, a step splits every node whose
    leaves go on with different words; nodes whose leaves go on alike only get longer edges."""
    leaves = _not_alone(prints)
    node = np.zeros(len(leaves), "i8")
    depth = np.full(len(leaves), DEPTH)
    depth[:1] = -1
    for d in range(DEPTH):
        if not len(leaves):
            break
        word = symbol[start[leaves] + d]
        first = np.flatnonzero(np.diff(node, prepend=-1))
        split = np.flatnonzero((~np.logical_and.reduceat(word == word[first][node], first))[node])
        if len(split):
            by = split[np.lexsort((word[split], node[split]))]
            leaves[split], word[split] = leaves[by], word[by]
        new = np.zeros(len(leaves), bool)
        new[1:] = (node[1:] == node[:-1]) & (word[1:] != word[:-1])
        depth[new] = d
        node = np.cumsum(depth < DEPTH) - 1
    return Subtree(leaves, depth)


def later(tree: Subtree, doc: np.ndarray, key: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Which of n windows a smaller document holds too, or their own document at an earlier place."""
    leaf, node = tree.deep()
    found = np.zeros(n, bool)
    if len(leaf):
        by = np.lexsort((place[leaf], key[leaf], doc[leaf], node))
        leaf, node = leaf[by], node[by]
        first = np.flatnonzero(np.diff(node, prepend=-1))
        rank = np.cumsum(np.diff(node, prepend=-1) != 0) - 1
        least = doc[leaf][first][rank]
        own = np.ones(len(leaf), bool)
        own[1:] = (rank[1:] != rank[:-1]) | (key[leaf][1:] != key[leaf][:-1])
        begin = place[leaf][np.flatnonzero(own)][np.cumsum(own) - 1]
        found[leaf] = (doc[leaf] > least) | (place[leaf] > begin)
    return found


def _settled(key: np.ndarray, begin: np.ndarray, size: np.ndarray, parts: int) -> list[tuple]:
    """Rows of kind 1: stretches of repeated windows, by the partition of their document."""
    part = (key.view("u8") % np.uint64(parts)).astype("i8")
    by = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[by], prepend=-1, append=-1))
    return [(1, int(part[by[a]]), 0, _pack(key[by[a:b]], begin[by[a:b]].astype("<i4"), size[by[a:b]].astype("<i4"))) for a, b in zip(cuts[:-1], cuts[1:])]


def _spaced(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """These words with one space after each, and where each begins (one more: the end)."""
    begin = np.concatenate([[0], np.cumsum(length + 1)])
    out = np.full(int(begin[-1]), 32, "u1")
    for a in range(0, len(start), BLOCK):
        n = length[a : a + BLOCK]
        out[flat(begin[a : a + len(n)], n)] = raw[flat(start[a : a + len(n)], n)]
    return out, begin


class _Chunk:
    """Words, windows and their hashes of some documents."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray):
        self.raw = raw
        self.start, self.length = split_words(raw, bounds)
        before = np.searchsorted(self.start, bounds)
        self.first, self.words = before[:-1], np.diff(before)
        self.symbol = symbols(raw, self.start, self.length)
        n = np.maximum(self.words - DEPTH + 1, 0)
        self.windows = flat(self.first, n)
        self.of = np.repeat(np.arange(len(n)), n)
        self.pairs, self.longer, whole = _spans(self.symbol, (*PREFIXES, DEPTH))
        self.prints = whole[self.windows]

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All words with one space after each, and where each begins (one more: the end)."""
        return _spaced(self.raw, self.start, self.length)


def _chunks(batches):
    """(key, doc_id, text) -> raw bytes, bounds, keys and doc_ids of about CHUNK bytes; a longer text is a chunk of its own."""
    held, total = [], 0
    for batch in batches:
        raw, ends = offsets_of(batch.column(2))
        key, doc = (batch.column(k).to_numpy(zero_copy_only=False).astype("i8") for k in (0, 1))
        a = 0
        while a < len(doc):
            b = min(max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK - total, "right")) - 1), len(doc))
            held.append((raw[ends[a] : ends[b]], np.diff(ends[a : b + 1]), key[a:b], doc[a:b]))
            total += int(ends[b] - ends[a])
            a = b
            if total >= CHUNK:
                yield _joined(held)
                held, total = [], 0
    if held:
        yield _joined(held)


def _count(batches):
    """Windows that each shorter prefix would name."""
    for raw, bounds, _, _ in _chunks(batches):
        c = _Chunk(raw, bounds)
        value, n = np.unique(places(c.pairs, c.longer, c.windows, np.zeros(0, "u4")), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(value.astype("i8")), pa.array(n.astype("i8"))], ["prefix", "n"])


def _send(parts: int, told):
    """(key, doc_id, text) -> settled stretches (kind 1) and stretches of windows that are left to compare (kind 0)."""

    def run(batches):
        for raw, bounds, key, doc in _chunks(batches):
            c = _Chunk(raw, bounds)
            if not len(c.windows):
                continue
            at = c.windows - c.first[c.of]
            known = later(grow(c.symbol, c.windows, c.prints), doc[c.of], key[c.of], at, len(at))
            first, n = _runs(known, c.windows, 0, c.of)
            if rows := _settled(key[c.of[first]], at[first], n, parts):
                yield _batch(rows)
            place = places(c.pairs, c.longer, c.windows, told.value)
            first, n = _runs(~known, c.windows, RUN, c.of, place)
            cell = (_mixed(place[first].astype("u8") + _ODD) % np.uint64(parts * CELLS)).astype("i8")
            by = np.lexsort((first, place[first], cell))
            first, n, cell = first[by], n[by], cell[by]
            text, begin = c.joined()
            cuts = np.flatnonzero(np.diff(cell, prepend=-1, append=-1))
            for a, b in zip(cuts[:-1], cuts[1:]):
                f, m = first[a:b], n[a:b]
                low, high = begin[c.windows[f]], begin[c.windows[f] + m + DEPTH - 1]
                of = c.of[f]
                yield _batch([(0, int(cell[a]) // CELLS, int(cell[a]) % CELLS, _pack(text[flat(low, high - low)], m.astype("u1"), doc[of], key[of], at[f].astype("<i4")))])

    return run


def _compare(parts: int):
    """Rows sorted by kind and cell: those of kind 0 -> stretches that stand earlier elsewhere (kind 1); the others go on."""

    def cell(packed):
        raw, n, doc, key, at = (np.concatenate(x) for x in zip(*(_unpack(p, "u1", "u1", "<i8", "<i8", "<i4") for p in packed)))
        packed.clear()
        n, end = n.astype("i8"), np.flatnonzero(raw == 32)
        start = np.concatenate([[0], end[:-1] + 1])
        symbol = symbols(raw, start, end - start)
        del raw, start, end
        begin = np.cumsum(n + DEPTH - 1) - (n + DEPTH - 1)
        windows = flat(begin, n)
        tree = grow(symbol, windows, _spans(symbol, (DEPTH,))[0][windows])
        leaf = np.sort(tree.leaves)  # documents and places of these alone are looked at
        of = np.searchsorted(np.cumsum(n), leaf, "right")
        place = at[of] + windows[leaf] - begin[of]
        found = later(Subtree(np.searchsorted(leaf, tree.leaves), tree.depth), doc[of], key[of], place, len(leaf))
        first, size = _runs(found, windows[leaf], 0, of)
        return _settled(key[of[first]], place[first], size, parts)

    def run(batches):
        at, held = None, []
        for batch in batches:
            for kind, part, c, packed in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                if kind:
                    yield _batch([(kind, part, c, packed.as_py())])
                    continue
                if c != at:
                    if held and (rows := cell(held)):
                        yield _batch(rows)
                    at, held = c, []
                held.append(packed.as_py())
        if held and (rows := cell(held)):
            yield _batch(rows)

    return run


def _ship(parts: int):
    """(key, doc_id, text) of all documents -> rows of kind 2: the words of each partition's documents, packed together."""

    def rows(raw, ends, key, doc, named):
        start, length = split_words(raw, ends)
        before = np.searchsorted(start, ends)
        text, begin = _spaced(raw, start, length)
        low, size = begin[before[:-1]], np.diff(begin[before])
        part = (key.view("u8") % np.uint64(parts)).astype("i8")
        by = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[by], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            i = by[a:b]
            yield _batch([(2, int(part[i[0]]), 0, _pack(text[flat(low[i], size[i])], size[i].astype("<i8"), doc[i], key[i], named[i].astype("u1")))])

    def run(batches):
        for batch in batches:
            raw, ends = offsets_of(batch.column(2))
            key = batch.column(0).to_numpy(zero_copy_only=False).astype("i8")
            named = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            doc = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype("i8")
            a = 0
            while a < len(key):  # CHUNK bytes at a time, or one longer text
                b = min(max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK, "right")) - 1), len(key))
                yield from rows(raw[ends[a] : ends[b]], ends[a : b + 1] - ends[a], key[a:b], doc[a:b], named[a:b])
                a = b

    return run


_SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _documents(packed: bytes, key, begin, size, rest: bool):
    raw, sizes, names, own, named = _unpack(packed, "u1", "<i8", "<i8", "<i8", "u1")
    ends = np.concatenate([[0], np.cumsum(sizes)])
    low, high = np.searchsorted(key, own, "left"), np.searchsorted(key, own, "right")
    out = []
    for i, (doc, known) in enumerate(zip(names.tolist(), named.tolist())):
        text = raw[ends[i] : ends[i + 1]]
        end = np.flatnonzero(text == 32)
        lost = 0
        if known and high[i] > low[i]:
            at = slice(low[i], high[i])
            steps = np.zeros(len(end) + 1, "i4")
            np.add.at(steps, begin[at], 1)
            np.add.at(steps, begin[at] + size[at] + DEPTH - 1, -1)
            gone = np.cumsum(steps[:-1]) > 0
            lost = int(gone.sum())
            text = text[np.repeat(~gone, np.diff(end, prepend=-1))]
        left = text[:-1].tobytes()
        out.append((doc if known else None, len(end), lost, hashlib.sha256(left).hexdigest(), *([left.decode()] if rest else [])))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.string()] if rest else []))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if rest else [])])


def _cut(rest: bool):
    """Settled stretches of a partition's documents first, then the documents: what is left of each."""

    def run(batches):
        held, by = [], None
        for batch in batches:
            for kind, packed in zip(batch.column(0).to_pylist(), batch.column(3)):
                if kind == 1:
                    held.append(_unpack(packed.as_py(), "<i8", "<i4", "<i4"))
                    continue
                if by is None:
                    key, begin, size = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, "i8"),) * 3
                    order = np.argsort(key, kind="stable")
                    by, held = (key[order], begin[order], size[order]), []
                yield _documents(packed.as_py(), *by, rest)

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]): each document without the words that a window of DEPTH words covers which also starts in a
    document of a smaller doc_id, or earlier in the same one.

    Words are runs of anything but blanks and the characters 9 to 13; windows never cross documents and are judged on the input. Null
    and empty texts have no words. Rows that share a doc_id aren't smaller than each other; repeated rows lose the same words. Rows without
    doc_id lose nothing and prove nothing. kept (with rest): the words that are left, joined by one space. Other columns are not
    read; an empty table gives an empty one. Words are told apart by 64 bits of hash.
    """
    spark = docs.sparkSession
    own = docs.select(F.xxhash64(doc_id, text).alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sound = own.where(f"doc_id is not null and octet_length(text) >= {2 * DEPTH - 1}")
    counts = written(sound.mapInArrow(lean(_count), "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n")), "prefixes")
    windows = counts.agg(F.sum("n")).first()[0] or 0
    frequent = counts.where(F.col("n") >= max(GROUP, windows // FREQUENT)).select("prefix").orderBy("prefix").limit(FREQUENT).toPandas()["prefix"].to_numpy("u4")
    discard(counts)
    told, parts = spark.sparkContext.broadcast(frequent), max(width(spark), windows // PARTITION)
    schema = "kind int, part int, cell int, packed binary"
    dealt = sound.mapInArrow(lean(_send(parts, told)), schema).repartition(parts, "part").sortWithinPartitions("part", "kind", "cell")
    settled = written(dealt.mapInArrow(lean(_compare(parts)), schema), "settled")
    both = settled.union(own.mapInArrow(lean(_ship(parts)), schema)).repartition(parts, "part").sortWithinPartitions("kind")
    return both.mapInArrow(lean(_cut(rest)), _SCHEMA + ", kept string" * rest)


SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - {DEPTH - 2})) AS i, ws FROM d WHERE len(ws) >= {DEPTH}),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + {DEPTH - 1}], ' ') ORDER BY doc_id, i) AS k FROM w),
g AS (SELECT DISTINCT doc_id, i + j AS i FROM r, range({DEPTH}) AS o(j) WHERE k > 1),
l AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
e AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS x FROM d),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM e ANTI JOIN g USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)
"""
