"""Toxicity: a support vector machine over a gapped subsequence string kernel with Nyström landmarks.

A sentence, and so a text, is as toxic as its worst word: the machine rates words, and training finds which words of a
toxic text are to blame by rating them with the machine so far. The kernel of two words is the cosine of their counts of
letter triples that stand in order within SPAN letters, each missing neighbour weighing GAP, so that inserted and left-out
letters cost little.
"""

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import lean

SPAN, GAP = 5, 0.6
#: Most labelled documents of each class that training takes (by a hash of doc_id) and most characters that such a text may have; landmarks of
#: toxic and of other words.
TRAINING_ROWS, TRAINING_CHARS, LANDMARKS, BACKGROUND = 1000, 50_000, 48, 16
#: Rounds of choosing the words to blame, and other words that each round trains with.
ROUNDS, OTHER_WORDS = 4, 20_000
#: Share from which a document counts as toxic.
TOXIC = 0.7
#: Toxic training texts that must share a string before it can be a landmark: among all strings of a corpus, some stand in three or four toxic texts
#: and in no other by chance alone (with 3 instead of 5, 6 of 95 clean held-out texts of sf0.01 are called toxic, and no more toxic ones are found).
LEAST_TEXTS = 5
REMEMBERED = 200_000
_SHIFTS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN - a)]
#: Letters to 1-26, the marks of a word's ends to 62 and 63, others to 27-61.
_CODE = np.array([62 + (chr(c) == ">") if chr(c) in "<>" else ord(chr(c).lower()[0]) - 96 if "a" <= chr(c).lower()[0] <= "z" else 27 + c % 35 for c in range(1 << 12)], "i8")
_SPELLED = re.compile(r"(?<!\w)[^\W\d_](?:[ .*_\-]{1,2}[^\W\d_]){3,}(?!\w)")
_NO_LETTER = re.compile(r"[\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Words of a text, lower-cased, split at white space; runs of single letters are one more word."""
    words = (text or "").lower().split()
    return words + [m.group() for m in _SPELLED.finditer((text or "").lower())]


def letters(word: str) -> str:
    """Letters of a word between marks for its begin and end; nothing for words of fewer than three letters."""
    bare = _NO_LETTER.sub("", word)
    return f"<{bare}>" if len(bare) > 2 else ""


def _parts(word: str) -> set[str]:
    return {word[i : i + n] for n in (*range(4, 9), len(word)) for i in range(len(word) - n + 1)}


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word index, code and weight of each triple of each word, summed and scaled to length 1 a word."""
    sizes = np.fromiter(map(len, words), "i8", len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    code = _CODE[np.where(points < len(_CODE), points, 0x3FF + points % 1024)]
    of = np.repeat(np.arange(len(words)), sizes)
    keys, weights = [], []
    for a, b in _SHIFTS:
        n = max(len(code) - a - b, 0)
        whole = np.flatnonzero(of[:n] == of[a + b :])
        keys.append(of[whole] << 18 | code[whole] << 12 | code[whole + a] << 6 | code[whole + a + b])
        weights.append(np.full(len(whole), GAP ** (a + b - 2)))
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    weight = np.bincount(at, np.concatenate(weights), len(key))
    of = key >> 18
    norm = np.sqrt(np.bincount(of, weight * weight, len(words)))
    return of, key & 0x3FFFF, weight / norm[of]


@dataclass
class Model:
    """Landmarks, the weight of the kernel with each, the intercept, and the logistic curve from margins to shares."""

    landmarks: list[str]
    alpha: np.ndarray
    intercept: float = 0.0
    slope: float = 0.0
    offset: float = -20.0

    def __post_init__(self):
        self.row = np.zeros(1 << 18, "i4")
        of, code, weight = triples(self.landmarks)
        used = np.unique(code)
        self.row[used] = np.arange(1, len(used) + 1)
        self.table = np.zeros((len(used) + 1, max(len(self.landmarks), 1)))
        self.table[self.row[code], of] = weight

    def kernel(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.table.shape[1]), "f4")
        for a in range(0, len(words), 5000):
            part = words[a : a + 5000]
            of, code, weight = triples(part)
            hit = np.flatnonzero(self.row[code])
            starts = np.flatnonzero(np.diff(of[hit], prepend=-1))
            if len(hit):
                out[a + of[hit][starts]] = np.add.reduceat(self.table[self.row[code[hit]]] * weight[hit, None], starts)
        return out

    def margins(self, words: list[str]) -> np.ndarray:
        return self.kernel(words) @ self.alpha.astype("f4") + self.intercept

    def share(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def _machine(x: np.ndarray, y: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Primal linear machine with squared hinge loss, by Newton steps; the last column of x is 1. often: weights of the rows;
    both classes weigh the same."""
    w = np.zeros(x.shape[1])
    weight = often * np.where(y > 0, 0.5 / often[y > 0].sum(), 0.5 / often[y < 0].sum()) * len(y)
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(15):
        inside = y * (x @ w) < 1
        xi, wi = x[inside], weight[inside]
        step = np.linalg.solve(ridge + (xi * wi[:, None]).T @ xi, ridge @ w + xi.T @ (wi * (xi @ w - y[inside])))
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve through margins, with the class shares evened out."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, 1 - 1 / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2))
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1)) * len(y)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-6)
        m = np.array([[h @ margin**2 + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-3]])
        da, db = np.linalg.solve(m, [g @ margin + 1e-3 * a, g.sum() + 1e-3 * b])
        da, db = np.clip([da, db], -1, 1)
        a, b = a - da, b - db
    return float(a), float(b)


def _landmarks(bags: list[list[str]], clean: Counter, toxic: int, other: int) -> tuple[list[str], set[str]]:
    """Strings of letters that toxic texts have and others hardly, chosen so that each explains words that those before it don't;
    and the words that they explain. bags: words of each toxic text; clean: number of other texts by word."""
    texts: dict[str, set[int]] = {}
    for i, bag in enumerate(bags):
        for w in bag:
            texts.setdefault(w, set()).add(i)
    holders: dict[str, set[str]] = {}
    for w, at in texts.items():
        if len(at) / toxic > 10 * clean[w] / other:
            for s in _parts(w):
                holders.setdefault(s, set()).add(w)
    least = max(LEAST_TEXTS, toxic // 40)
    weight = {s: len(set().union(*(texts[w] for w in ws))) for s, ws in holders.items() if sum(len(texts[w]) for w in ws) >= least}
    weight = {s: n for s, n in weight.items() if n >= least}
    found: Counter = Counter()
    for w, n in clean.items():
        for s in _parts(w):
            if s in weight:
                found[s] += n
    pure = {s for s, n in weight.items() if n / toxic > 20 * found[s] / other}
    chosen, explained = [], set()
    while len(chosen) < LANDMARKS:
        gain = {s: len(set().union(*(texts[w] for w in holders[s] - explained))) for s in pure}
        most = max(gain.values(), default=0)
        if most < least:
            break
        best = max((s for s in gain if gain[s] >= 0.9 * most), key=lambda s: (len(s), gain[s], s))
        chosen.append(best)
        explained |= holders[best]
        pure = {s for s in pure if gain[s] >= least and s != best}
    return chosen, explained


def _fit(batches):
    """All training rows -> one row that says the model."""
    rows = sorted(row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    m = fitted(rows)
    yield pa.RecordBatch.from_pylist([{"landmarks": m.landmarks, "alpha": m.alpha.tolist(), "intercept": m.intercept, "slope": m.slope, "offset": m.offset}], _MODEL)


_MODEL = pa.schema([("landmarks", pa.list_(pa.string())), ("alpha", pa.list_(pa.float64())), *((k, pa.float64()) for k in ("intercept", "slope", "offset"))])


def train(rows: DataFrame) -> Model:
    """Fit to (text, label) rows, which `training_rows` has bounded, in one task; the driver sees the model alone."""
    schema = "landmarks array<string>, alpha array<double>, intercept double, slope double, offset double"
    found = rows.repartition(1).mapInArrow(lean(_fit), schema).first()
    return Model(list(found.landmarks), np.array(found.alpha), found.intercept, found.slope, found.offset) if found else fitted([])


def fitted(rows: list[tuple[str, int]]) -> Model:
    """Fit to (text, label) rows. Without rows of both classes the model gives every text a share near 0."""
    bags = [sorted({x for w in words_of(t) if (x := letters(w))}) for t, _ in rows]
    y = np.array([1 if label else 0 for _, label in rows])
    if len(set(y)) < 2 or not any(b for b, k in zip(bags, y) if k):
        return Model([], np.zeros(1))
    toxic, other = int(y.sum()), int(len(y) - y.sum())
    seen = Counter(w for bag, k in zip(bags, y) if k for w in bag)
    clean = Counter(w for bag, k in zip(bags, y) if not k for w in bag)
    clean_words = sorted(clean)
    chosen, blamed = _landmarks([b for b, k in zip(bags, y) if k], clean, toxic, other)
    if not chosen:
        return Model([], np.zeros(1))
    spread = clean_words[:: max(1, len(clean_words) // BACKGROUND)][:BACKGROUND]
    model = Model(chosen + spread, np.zeros(len(chosen) + len(spread)))
    values, vectors = np.linalg.eigh(model.kernel(model.landmarks).astype("f8"))
    nystrom = vectors / np.sqrt(np.maximum(values, 1e-2))
    vocabulary = sorted(set(seen) | set(clean))
    place = {w: i for i, w in enumerate(vocabulary)}
    gapped = sorted({c[:i] + "x" + c[i:] for c in chosen for i in range(2, len(c) - 1)})
    kernel = model.kernel(vocabulary + gapped)
    phi = np.concatenate([kernel @ nystrom, np.ones((len(kernel), 1))], 1)
    bag_ids = [np.array([place[w] for w in b], "i8") for b in bags]
    clean_ids = np.array([place[w] for w in clean_words], "i8")
    even = clean_ids[:: max(1, len(clean_ids) // OTHER_WORDS)]
    to_blame = np.array(sorted(place[w] for w in blamed), "i8")
    variants = np.arange(len(vocabulary), len(phi))
    often = np.sqrt([seen[w] + clean[w] for w in vocabulary] + [1] * len(gapped))
    margin = kernel[:, : len(chosen)].max(1)
    for _ in range(ROUNDS):
        # against the words to blame: an even spread of the words of clean texts, and the worst of them
        against = np.unique(np.concatenate([clean_ids[np.argsort(-margin[clean_ids])[: OTHER_WORDS // 4]], even]))
        bad = np.concatenate([np.setdiff1d(to_blame, against), variants])
        w = _machine(phi[np.concatenate([bad, against])], np.concatenate([np.ones(len(bad)), -np.ones(len(against))]), np.concatenate([often[bad], often[against]]))
        margin = phi @ w
        model.alpha, model.intercept = nystrom @ w[:-1], float(w[-1])
        worst = [b[np.argmax(margin[b])] for b, k in zip(bag_ids, y) if k and len(b)]
        to_blame = np.unique([*to_blame[margin[to_blame] > -0.5], *(i for i in worst if margin[i] > 0)]).astype("i8")
    top = np.array([margin[b].max() if len(b) else model.intercept for b in bag_ids])
    model.slope, model.offset = _curve(top, y)
    return model


def fold(doc_id: str = "doc_id") -> Column:
    """Remainder of crc32 of the id as text by 3; remainder 1 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> DataFrame:
    """(text, label) of at most `most` labelled documents of each class outside the held-out fold, by a hash of their ids; one whose text has more than
    TRAINING_CHARS characters isn't used. Of several labels of a doc_id the largest counts, of several texts the first in order."""
    own = labels.where("toxic is not null and doc_id is not null").where(fold() != 1).groupBy("doc_id").agg((F.max("toxic") != 0).cast("int").alias("label"))
    first = lambda k: own.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = first(0).union(first(1)).withColumnRenamed("doc_id", "_doc")
    found = docs.select("doc_id", "text").where(F.length("text") <= TRAINING_CHARS).join(F.broadcast(chosen), F.col("doc_id") == F.col("_doc"))  # at most 2 * most short rows
    return found.groupBy("_doc").agg(F.min("text").alias("text"), F.min("label").alias("label")).select("text", "label")


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs plus score (0 to 1) and predicted (1 if score >= TOXIC, else 0); columns of these names are replaced.

    Null and empty texts, and texts without words, get the score of the intercept. Repeated rows, null ids and extra columns
    stay; an empty table stays empty.
    """
    keep = docs.drop("score", "predicted")
    sent = keep.schema.names.index(text)

    def run(batches):
        known: dict[str, float] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                words = [words_of(t) for t in part.column(sent).to_pylist()]
                new = list(set().union(*words).difference(known))
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = list(set().union(*words))
                bare = [letters(w) for w in new]
                short = sorted({w for w in bare if w})
                rated = dict(zip(short, model.margins(short).tolist())) if short else {}
                known.update((w, rated.get(b, model.intercept)) for w, b in zip(new, bare))
                worst = np.array([max(map(known.__getitem__, w), default=model.intercept) for w in words])
                share = np.maximum(model.share(worst), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(share), pa.array((share >= TOXIC).astype("i4"))], [*part.schema.names, "score", "predicted"])

    schema = StructType([*keep.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return keep.mapInArrow(lean(run), schema)


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on labels outside the held-out fold and score all of docs."""
    return score(docs, train(training_rows(docs, labels)))
