"""Benchmark decontamination: numbers, names and units become typed slots, windows of the templates are hash-joined, and the
slots of an aligned stretch must be filled consistently, so that re-parameterised questions are found too."""

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, without

#: Words in a window; words that an aligned stretch must cover (all of a shorter item); literal words that a window must hold.
WINDOW, STRETCH, LITERALS = 8, 13, 3
#: Bits of the filter through which documents' windows pass before the join; its size doesn't depend on the benchmark.
FILTER_BITS = 22
#: Benchmark windows up to which their table is sent to every executor.
BROADCAST_WINDOWS = 500_000
REMEMBERED = 200_000
#: Unit words and spelled numbers.
UNITS = frozenset(
    "mm cm m km mg g kg t ml cl l ms s min h kb mb gb mph kph kmh hz khz mhz w kw v a j kj cal kcal pa bar inch inches foot feet yard yards mile miles "
    "ounce ounces pound pounds ton tons gram grams kilogram kilograms meter meters metre metres kilometer kilometers kilometre kilometres liter liters litre litres "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees".split()
)
NUMBERS = frozenset("one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split())
_EDGE = re.compile(r"^[^\w$€£%+-]+|[^\w%$€£]+$")
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,/]*%?[$€£]?")
_QUANTITY = re.compile(r"[$€£]?(\d[\d.,/]*)-?([a-z]+)")
_SALT = np.array([int(xxhash.xxh64_intdigest(f"place {j}")) | 1 for j in range(WINDOW)], "u8")


#: Marks that the edges lose; between them letters alone need no pattern.
_MARKS = "()[].,;:!?\"'"


def slot(word: str, first: bool) -> tuple[str, str]:
    """Template word and the value of its slot (empty for literals); both empty for marks without a letter or digit.
    first: the word opens a sentence, where a capital doesn't make a name."""
    return _slot(_EDGE.sub("", word), first)


def _slot(core: str, first: bool) -> tuple[str, str]:
    low = core.lower()
    if not any(c.isalnum() for c in core):
        return "", ""
    if low in NUMBERS or _NUMBER.fullmatch(core):
        return "<number>", low
    if (m := _QUANTITY.fullmatch(low)) and m[2] in UNITS:
        return "<quantity>", low
    if low in UNITS and len(low) > 1:
        return "<unit>", low
    if not first and core[0].isupper() and core[1:].islower():
        return "<name>", low
    return low, ""


class _Places(dict):
    """Number of each spelling; one that is not there is learned."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str) -> int:
        return self.learn(word)


def _code(template: str) -> int:
    return xxhash.xxh64_intdigest(template) if template else 0


_FIXED, _NAME = UNITS | NUMBERS, _code("<name>")


class Templates:
    """Template words by number; each spelling is looked at once. by_word: codes of the bare words are wanted too."""

    def __init__(self, by_word: bool = True):
        self.by_word = by_word
        self.clear()

    def clear(self):
        self.place = _Places(self._learn)
        self.found: list[tuple] = []
        self.known = [np.zeros(0, d) for d in ("u8", "u8", bool, bool, bool, "u8")]

    def _learn(self, word: str) -> int:
        core = word.strip(_MARKS)
        low, value, inner_value = core.lower(), "", ""
        if core.isalpha() and low not in _FIXED:  # a literal, or a name inside a sentence: most spellings are
            opens = inner = xxhash.xxh64_intdigest(low)
            if core[0].isupper() and core[1:].islower():
                inner, inner_value = _NAME, low
        else:
            core = _EDGE.sub("", word)
            first, value = _slot(core, True)
            within, inner_value = _slot(core, False)
            low, opens, inner = core.lower(), _code(first), _code(within)
        bare = _code("=" + low) if self.by_word else 0
        self.found.append((opens, inner, value != "", inner_value != "", word[-1] in ".!?:", bare, value, inner_value))
        self.place[word] = at = len(self.found) - 1
        return at

    def read(self, texts: list[str | None]):
        """Of all texts: text number, code, whether it is a slot, whether it is one in both readings, number of the spelling, and
        whether it opens a sentence, one row per template word."""
        if len(self.place) > REMEMBERED:
            self.clear()
        split = [(t or "").split() for t in texts]
        sizes = np.array([len(s) for s in split], "i8")
        index = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), "i8", int(sizes.sum()))
        if more := self.found[len(self.known[0]) :]:
            self.known = [np.concatenate([x, np.array(f, x.dtype)]) for x, f in zip(self.known, zip(*more))]
        opens, inner, opens_slot, inner_slot, ends, _ = self.known
        first = np.ones(len(index), bool)
        first[1:] = ends[index[:-1]]
        first[(np.cumsum(sizes) - sizes)[(sizes > 0)]] = True
        code = np.where(first, opens[index], inner[index])
        of = np.repeat(np.arange(len(texts)), sizes)
        kept = code != 0
        of, code, index, first = of[kept], code[kept], index[kept], first[kept]
        return of, code, np.where(first, opens_slot[index], inner_slot[index]), opens_slot[index], index, first  # an opening word's slot is one inside too

    def other(self, index: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Codes if these words did (not) open a sentence after all."""
        return np.where(first, self.known[1][index], self.known[0][index])

    def bare(self, index: np.ndarray) -> np.ndarray:
        """Codes of these words as they stand."""
        return self.known[5][index]

    def value(self, index: int, first: bool) -> str:
        return self.found[index][6 if first else 7]


def _sums(code: np.ndarray, width: int) -> np.ndarray:
    """Of every window of so many words, a sum that the order of its words changes."""
    n = max(len(code) - width + 1, 0)
    total = np.full(n, _SALT[width - 1])
    for j in range(width):
        total += code[j : j + n] * _SALT[j]
    return total


def _mixed(total: np.ndarray) -> np.ndarray:
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return total ^ (total >> np.uint64(29))


def _windows(of: np.ndarray, literal: np.ndarray, either: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every window within one text, and whether it holds enough literal words. literal: 1 for words without a slot; either:
    in one reading at least, which counts for a window's first word, because the word before it may differ in a copy."""
    n = max(len(of) - width + 1, 0)
    words = np.concatenate([[0], np.cumsum(literal)])
    start = np.flatnonzero(of[:n] == of[width - 1 :])
    return start, words[start + width] - words[start + 1] + either[start] >= LITERALS


SCHEMA = "key long, id long, position int, size int, width int, before int, after int, own boolean, bare boolean, hash long, slots array<struct<at: int, value: string>>"
_NAMES = "key id position size width before after own bare hash slots".split()
_SLOTS = pa.list_(pa.struct([("at", pa.int32()), ("value", pa.string())]))
_BARE = np.uint64(xxhash.xxh64_intdigest("bare"))


def _scan(passes: np.ndarray | None, sorts: list[tuple[int, bool]] = ()):
    """Windows of (key, id, text) rows. Of items (passes None) all: as wide as the item where that is short, in both readings of the
    first word, and, of items that have no window with enough literal words, by the bare words. Of documents those widths and
    sorts (by bare words or not) that items have, and of them what the filter's bits let through."""

    def run(batches):
        templates = Templates(passes is None or any(b for _, b in sorts))
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                of, code, slotted, both, index, first = templates.read(part.column(2).to_pylist())
                sizes = np.bincount(of, minlength=part.num_rows)
                begin = np.cumsum(sizes) - sizes

                def rows(start, width, hashed, own, by_word, before, after):
                    row, filled = of[start], []
                    for s in start:
                        held = [] if by_word else [(i, first[i]) for i in range(s + 1, s + width) if slotted[i]]
                        if not by_word and templates.value(index[s], first[s] == own):
                            held.insert(0, (s, first[s] == own))
                        filled.append([{"at": int(i - begin[of[s]]), "value": templates.value(index[i], f)} for i, f in held])
                    many = lambda v, t: pa.array(np.broadcast_to(v, len(start)), t)
                    columns = [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), many(start - begin[row], pa.int32()), many(sizes[row], pa.int32()), many(width, pa.int32()), many(before, pa.int32()), many(after, pa.int32()), many(own, pa.bool_()), many(by_word, pa.bool_()), pa.array(hashed.view("i8")), pa.array(filled, _SLOTS)]
                    return pa.RecordBatch.from_arrays(columns, _NAMES)

                if passes is not None:
                    for width in sorted({w for w, _ in sorts}):
                        every, rich = _windows(of, ~slotted, ~both, width)
                        for by_word in (b for w, b in sorts if w == width):
                            start = every[rich != by_word]
                            hashed = _mixed((_sums(templates.bare(index), width) + _BARE if by_word else _sums(code, width))[start])
                            bit = hashed & np.uint64((1 << FILTER_BITS) - 1)
                            chosen = passes[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1) == 1
                            if chosen.any():
                                yield rows(start[chosen], width, hashed[chosen], True, by_word, 0, 0)
                    continue
                other, bare = templates.other(index, first), templates.bare(index)
                for width in range(1, WINDOW + 1):
                    every, rich = _windows(of, ~slotted, ~both, width)
                    fits = np.minimum(sizes, WINDOW)[of[every]] == width
                    every, rich = every[fits], rich[fits]
                    poor = np.bincount(of[every], rich, part.num_rows)[of[every]] == 0
                    if poor.any():
                        yield rows(every[poor], width, _mixed((_sums(bare, width) + _BARE)[every[poor]]), True, True, 0, 0)
                    start = every[rich]
                    if not len(start):
                        continue
                    # windows without enough literal words right before and after each one
                    row, place, edge = of[start], start - begin[of[start]], np.ones(1, bool)
                    new = np.concatenate([edge, row[1:] != row[:-1]])
                    before = place - np.where(new, -1, np.concatenate([[-1], place[:-1]])) - 1
                    after = np.where(np.concatenate([new[1:], edge]), sizes[row] - width + 1, np.concatenate([place[1:], [0]])) - place - 1
                    sums = _sums(code, width)[start]
                    yield rows(start, width, _mixed(sums), True, False, before, after)
                    two = code[start] != other[start]
                    if two.any():
                        turned = start[two]
                        yield rows(turned, width, _mixed(sums[two] + (other[turned] - code[turned]) * _SALT[0]), False, False, before[two], after[two])

    return run


def _consistent(pairs: set) -> bool:
    return len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def _enough(windows: list[dict], width: int, size: int) -> bool:
    """Whether windows, by position in the item, are as many as cover the stretch, or some in a row are, if those count that no text can show."""
    need = min(STRETCH, size) - width + 1
    if len(windows) >= need:
        return True
    begin = last = None
    for w in windows:
        if last is None or w["at"] - w["before"] - 1 != last:
            begin = w["at"] - w["before"]
        last = w["at"]
        if last + w["after"] - begin + 1 >= need:
            return True
    return False


def _unchanged(windows: list[dict], width: int, size: int) -> list[dict]:
    """The longest run of windows in a row that holds the item's own words over the length of a stretch, or none."""
    best, begin = (0, 0), 0
    for k, w in enumerate(windows):
        if any(x != y for x, y in w["pairs"]):
            begin = k + 1
            continue
        if k > begin and w["at"] - windows[k - 1]["at"] > min(w["before"] + 1, width):
            begin = k
        if w["at"] - windows[begin]["at"] + width >= min(STRETCH, size) and k + 1 - begin > best[1] - best[0]:
            best = (begin, k + 1)
    return windows[slice(*best)]


def _stretch(windows: list[dict], width: int, size: int):
    """Windows that make an alignment a leak, or none: all, those in the item's own reading, or an unchanged run."""
    for some in (windows, [w for w in windows if w["own"]]):
        if some and _enough(some, width, size) and _consistent({p for w in some for p in w["pairs"]}):
            return some
    return _unchanged(windows, width, size)


KEPT = "key long, doc_id long, item_id long, n int, position int, same boolean"


def _decide(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            windows = sorted(r["windows"], key=lambda w: w["at"])
            for w in windows:
                w["pairs"] = {(p["theirs"], p["ours"]) for p in w["pairs"]}
            if some := _stretch(windows, r["width"], r["item_size"]):
                same = all(x == y for w in some for x, y in w["pairs"])
                out.append((r["key"], r["id"], r["item_id"], len(some) + r["width"] - 1, some[0]["at"] + r["shift"], same))
        if out:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [x.split()[0] for x in KEPT.split(", ")])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, key, n_words, position, same_values): documents that hold a stretch of a benchmark item.

    docs (doc_id, text), benchmark (item_id, text); key is xxhash64 of doc_id and text, for documents without an id. A stretch is aligned windows
    of equal templates that together cover 13 words, or all windows of a shorter item; each value of the item's slots must
    stand for one value of the document's and the reverse. Windows with fewer than three literal words are not looked up, and
    those next to matching ones count as matching; an item that has no others is looked up word by word as it stands. An item of
    fewer than 8 words is one window. A run of windows that holds 13 of the item's words unchanged is a stretch whatever the slots
    beside it hold. n_words: words of the longest stretch's windows; position: its first
    word in the document; same_values: the slots hold the item's own values. Null and empty texts match nothing; repeated rows
    give one row; other columns are not read; empty tables give none.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.xxhash64("text").alias("key"), F.col("item_id").cast("long").alias("id"), "text").where("text is not null")
    windows = items.mapInArrow(_scan(None), SCHEMA)
    windows = windows.select(F.col("id").alias("item_id"), F.col("position").alias("item_position"), F.col("size").alias("item_size"), "width", "before", "after", "own", "bare", "hash", F.col("slots").alias("item_slots"))
    windows = windows.distinct().cache()
    bits = windows.select((F.col("hash").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word"))
    words = bits.agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).collect()  # at most 2 ** (FILTER_BITS - 6) rows
    passes = np.zeros(1 << (FILTER_BITS - 6), "i8")
    for w in words:
        passes[w["word"]] = w["bits"]
    sorts = [(r["width"], r["bare"]) for r in windows.select("width", "bare").distinct().collect()]  # at most 2 * WINDOW rows
    index = F.broadcast(windows) if windows.count() <= BROADCAST_WINDOWS else windows
    found = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), F.col("doc_id").cast("long").alias("id"), "text").where("text is not null")
    found = found.mapInArrow(lean(_scan(passes.view("u8"), sorts)), SCHEMA).select("key", "id", "position", "hash", "slots").join(index, "hash")
    pairs = F.expr("zip_with(slots, item_slots, (a, b) -> struct(b.value as theirs, a.value as ours))").alias("pairs")
    aligned = found.groupBy("key", "id", "item_id", "item_size", "width", (F.col("position") - F.col("item_position")).alias("shift")).agg(
        F.collect_set(F.struct(F.col("item_position").alias("at"), "before", "after", "own", pairs)).alias("windows")
    )
    kept = aligned.mapInArrow(lean(_decide), KEPT)
    best = F.max_by(F.struct("position", "same"), F.struct(F.col("n"), -F.col("position")))
    return kept.groupBy("key", "doc_id", "item_id").agg(F.max("n").alias("n_words"), best.alias("best")).select(
        "doc_id", "item_id", "key", "n_words", "best.position", F.col("best.same").alias("same_values")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a stretch of a benchmark item; all columns, nulls and repeated rows stay."""
    return without(docs, F.xxhash64(docs["doc_id"].cast("long"), docs["text"]), leaks(docs, benchmark).select("key"), "leaks")
