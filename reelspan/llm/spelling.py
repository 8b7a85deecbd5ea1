"""Spelling variants by search schemes on a bidirectional FM-index over the delimited vocabulary.

If two words differ by one code point, the left or the right half of one stands unchanged in the other. Two searches cover both cases: one
matches the left half exactly from the word's first delimiter and extends to the right, the other matches the right half exactly from
its last delimiter and extends to the left, each across the other half with one error. Both are intervals of suffix ranks: of the words, or
of the words reversed, which is the index of the other direction. Words meet by the half that must match, so that a task holds an index
of some thousand words and every word that a query can find there.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, flat, lean, width, written
from .merkle import CRC, CRC_TABLE, LOWER, UPPER

#: A run in which a code point may go missing is one of so many; code points and occurrences of a word, at least; how much more frequent a form is.
ODDS, SHORTEST, RAREST, TIMES = 97, 5, 3, 2
#: Code points of an index; words of one half before they are dealt to several indexes.
CELL, HOT = 150_000, 50_000
LETTERS = "[A-Za-zÀ-ÿ]"


class FMIndex:
    """Suffix ranks of the text $w1$w2$..$wk$ of sorted distinct words. A delimiter ranks by the word behind it, so that any suffix is told from any
    other at its next delimiter, and the k-th delimiter before a word, by rank, is that of word k."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, letters: int):
        k = len(lengths)
        begin = np.concatenate([[0], np.cumsum(lengths + 1)])
        text = np.zeros(int(begin[-1]) + 1, "i8")  # 0 is the delimiter
        text[flat(begin[:-1] + 1, lengths)] = codes
        rank = text + k
        rank[begin[:-1]] = np.arange(1, k + 1)
        rank[-1] = 0
        n, step = len(text), 1
        while True:
            both = rank * np.int64(n + k + letters + 1)
            both[:-step or n] += rank[step:]
            order = np.argsort(both, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(both[order]) != 0)])
            rank = np.empty(n, "i8")
            rank[order] = new
            if new[-1] == n - 1:
                break
            step *= 2
        before = np.where(order > 0, text[order - 1], letters + 1)  # no letter stands before the first delimiter
        seen = np.zeros((n + 1, letters + 1), "i4")
        seen[np.flatnonzero(before <= letters) + 1, before[before <= letters]] = 1
        self.seen = np.cumsum(seen, axis=0, dtype="i4")
        self.first = np.searchsorted(text[order], np.arange(letters + 1)).astype("i4")
        self.k, self.letters = k, letters

    def extend(self, low: np.ndarray, high: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more letter (or delimiter) before them."""
        return self.first[code] + self.seen[low, code], self.first[code] + self.seen[high, code]

    def extend_all(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every pattern with any letter before it, those that occur: number of the pattern, letter, interval."""
        a, b = self.first + self.seen[low], self.first + self.seen[high]
        a, b = a[:, 1:], b[:, 1:]
        at, letter = np.nonzero(b > a)
        return at, letter + 1, a[at, letter], b[at, letter]


def search(index: FMIndex, codes: np.ndarray, begin: np.ndarray, length: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) of the words of the index that differ from a query by one code point, the query's last `exact` code points standing unchanged at
    the word's end. Queries are codes[begin:begin + length]."""
    q = np.arange(len(length))
    left, low, high, wrong = length.copy(), np.zeros(len(q), "i4"), np.full(len(q), index.k + 1, "i4"), np.zeros(len(q), bool)
    found = []
    step = 4096
    stack = [(q[a : a + step], left[a : a + step], low[a : a + step], high[a : a + step], wrong[a : a + step]) for a in range(0, len(q), step)]
    while stack:
        q, left, low, high, wrong = stack.pop()
        while len(q):
            done = (left == 0) & wrong
            if done.any():
                a, b = index.extend(low[done], high[done], np.zeros(int(done.sum()), "i8"))
                hit = b > a
                found.append((q[done][hit], a[hit]))
                q, left, low, high, wrong = (x[~done] for x in (q, left, low, high, wrong))
            nxt = codes[begin[q] + np.maximum(left, 1) - 1]
            on = left > 0
            a, b = index.extend(low[on], high[on], nxt[on])
            parts = [(q[on], left[on] - 1, a, b, wrong[on])]
            free = ~wrong & (length[q] - left >= exact[q])
            if free.any():
                fq, fl, fx, flow, fhigh = q[free], left[free], nxt[free], low[free], high[free]
                at, letter, a, b = index.extend_all(flow, fhigh)
                other = (letter != fx[at]) | (fl[at] == 0)  # a letter put in before its like is one put in behind it
                at, letter, a, b = at[other], letter[other], a[other], b[other]
                parts.append((fq[at], fl[at], a, b, np.ones(len(at), bool)))  # inserted
                swap = fl[at] > 0
                parts.append((fq[at][swap], fl[at][swap] - 1, a[swap], b[swap], np.ones(int(swap.sum()), bool)))  # replaced
                some = fl > 0
                parts.append((fq[some], fl[some] - 1, flow[some], fhigh[some], np.ones(int(some.sum()), bool)))  # deleted
            q, left, low, high, wrong = (np.concatenate(x) for x in zip(*parts))
            alive = high > low
            q, left, low, high, wrong = (x[alive] for x in (q, left, low, high, wrong))
    if not found:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    pairs = np.unique(np.concatenate([a.astype("i8") * index.k + b for a, b in found]))
    return pairs // index.k, pairs % index.k


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, and where each word begins and how long it is."""
    length = np.array([len(w) for w in words], "i8")
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), np.cumsum(length) - length, length


def _cell(side: int, words: list[str], n: np.ndarray, asks: np.ndarray, here: np.ndarray):
    """Near words among those that are `here` of the words that ask: (word, how many, n of the most frequent, the most frequent). A pair that both
    searches find counts in the first, whose side is 0."""
    turned = [w[::-1] for w in words] if side == 0 else words
    held = np.array(sorted(np.flatnonzero(here).tolist(), key=turned.__getitem__), "i8")
    query = np.flatnonzero(asks)
    if not len(held) or not len(query):
        return None
    text, begin, length = _codes(turned)
    alphabet, codes = np.unique(text, return_inverse=True)
    codes = codes.astype("i8") + 1
    index = FMIndex(codes[flat(begin[held], length[held])], length[held], len(alphabet))
    m = length[query]
    a, b = search(index, codes, begin[query], m, m // 2 if side == 0 else m - m // 2)
    a, b = query[a], held[b]
    if side:
        both = np.array([words[x][: len(words[x]) // 2] == words[y][: len(words[x]) // 2] for x, y in zip(a.tolist(), b.tolist())], bool)
        a, b = a[~both], b[~both]
    if not len(a):
        return None
    place = np.empty(len(words), "i8")
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    by = np.lexsort((place[b], -n[b], a))
    a, b = a[by], b[by]
    first = np.flatnonzero(np.diff(a, prepend=-1))
    columns = [pa.array([words[i] for i in a[first].tolist()]), pa.array(np.diff(first, append=len(a))), pa.array(n[b[first]]), pa.array([words[i] for i in b[first].tolist()])]
    return pa.RecordBatch.from_arrays(columns, ["word", "n_near", "best_n", "best"])


def _near(batches):
    """Rows sorted by side, block and half: the words of whole halves are gathered into cells. A block of a crowded half is a cell of its own."""

    def closed():
        names = list(held)
        n, asks, here = zip(*held.values())
        return _cell(side, names, np.array(n, "i8"), np.array(asks, bool), np.array(here, bool))

    side, block, half, held, size = None, None, None, {}, 0
    for batch in batches:
        for s, b, h, word, n, asks, here in zip(*(batch.column(k).to_pylist() for k in range(7))):
            if held and (s != side or b != block or (h != half and (size >= CELL or b >= 0))):
                if (out := closed()) is not None:
                    yield out
                held, size = {}, 0
            side, block, half = s, b, h
            if known := held.get(word):
                held[word] = (n, asks or known[1], here or known[2])
            else:
                held[word] = (n, asks, here)
                size += len(word) + 1
    if held and (out := closed()) is not None:
        yield out


def near_words(words: DataFrame) -> DataFrame:
    """words (word, n), each once -> (word, n_near, best_n, best) of the words that differ from some other by one inserted, deleted or replaced code
    point: how many do, and the most frequent of them (of equals the first in code-point order)."""
    size = F.char_length("word")
    even, half = size % 2 == 0, F.floor(size / 2).cast("int")

    def under(side, length, asks):
        part = F.left("word", length) if side == 0 else F.right("word", length)
        return F.struct(F.lit(side).alias("side"), part.alias("half"), F.lit(asks).alias("asks"))

    # A word is asked for by words one shorter, as long and one longer; their halves have its own half's length or one other.
    keys = F.array(
        under(0, half, True),
        under(0, F.when(even, half - 1).otherwise(half + 1), False),
        under(1, size - half, True),
        under(1, F.when(even, half + 1).otherwise(half), False),
    )
    rows = words.select("word", "n", F.explode(keys).alias("r")).select("r.*", "word", "n")
    crowded = rows.groupBy("side", "half").count().where(F.col("count") > HOT).select("side", "half", F.ceil(F.col("count") / HOT).cast("int").alias("_blocks"))
    marked = rows.join(F.broadcast(crowded), ["side", "half"], "left")  # at most 4 / HOT rows for each word
    own = F.pmod(F.xxhash64("word"), F.col("_blocks")).cast("int")
    into = F.when(F.col("_blocks").isNull(), F.array(F.lit(-1))).when(F.col("asks"), F.sequence(F.lit(0), F.col("_blocks") - 1)).otherwise(F.array(own))
    dealt = marked.withColumn("block", F.explode(into)).select("side", "block", "half", "word", "n", "asks", (F.col("_blocks").isNull() | (F.col("block") == own)).alias("here"))
    placed = dealt.repartition(width(words.sparkSession), "side", "half", "block").sortWithinPartitions("side", "block", "half")
    found = placed.mapInArrow(lean(_near), "word string, n_near long, best_n long, best string")
    least = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root), following forms to the last by doubling: each round halves what is left of a way, so that rounds are the
    logarithm of the longest. Forms must rise in some order (here: n), else they would go round."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        new = written(at.join(step, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_on")), "roots")
        discard(at)
        at = new.drop("_on")
        if not new.where("_on").limit(1).count():
            return at


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of SHORTEST code points and RAREST occurrences. From a run whose crc32 with its document's id ODDS
    divides, one code point is gone."""
    run = F.explode(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"{LETTERS}{{{SHORTEST},}}"), F.lit(0)))
    runs = docs.select(F.col(doc_id).cast("string").alias("_d"), run.alias("_w"))
    h = F.crc32(F.concat("_d", F.lit(":"), "_w"))
    cut = (h % F.char_length("_w")).cast("int")
    fewer = F.concat(F.left("_w", cut), F.substr("_w", cut + 2))
    words = runs.select(F.when(h % ODDS == 0, fewer).otherwise(F.col("_w")).alias("word")).where(F.char_length("word") >= SHORTEST)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= RAREST)


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary of all documents: form is the most frequent near word, if it occurs TIMES as often; root is
    what forms lead to at last, or the word itself.

    Null and empty texts have no words; rows without doc_id count, but lose no code point; repeated rows count each time; words of any length are
    searched. Other columns are not read; an empty table gives an empty one.
    """
    words = written(vocabulary(docs, doc_id, text), "words")
    near = words.join(near_words(words), "word", "left")
    enough = F.col("best_n") >= TIMES * F.col("n")
    rated = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n")), "rated")
    ends = roots(rated.where("form is not null"))
    return rated.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED {CRC_TABLE},
r AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{LETTERS}{{{SHORTEST},}}')) AS w FROM documents) GROUP BY ALL),
h AS MATERIALIZED (SELECT w, n, {CRC.replace('{x}', "(CAST(doc_id AS VARCHAR) || ':' || w)")} AS h FROM r, crc),
e AS (SELECT CASE WHEN h % {ODDS} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {RAREST}),
d AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS k FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS other FROM d a JOIN d b ON a.k = b.k AND a.i = b.i AND a.word <> b.word UNION
  SELECT d.word, v.word FROM d JOIN v ON v.word = d.k UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.k),
b AS MATERIALIZED (SELECT p.word, count(*) AS n_near, first(p.other ORDER BY o.n DESC, p.other) AS best, max(o.n) AS best_n FROM p JOIN v o ON o.word = p.other GROUP BY p.word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {TIMES} * n THEN best END AS form, CASE WHEN best_n >= {TIMES} * n THEN best_n END AS form_n FROM v LEFT JOIN b USING (word)),
t AS (SELECT word, word AS at, form AS nx FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.nx)
SELECT f.word, f.form, t.at AS root, f.n, f.n_near, f.form_n FROM f JOIN t ON t.word = f.word AND t.nx IS NULL
"""
