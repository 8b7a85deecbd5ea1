"""SentencePiece encoding and decoding as a weighted transducer: normaliser, pieces and byte fallback are compiled to states and
arcs, composed with each input, and the shortest path is taken in the tropical semiring.

Unigram models weigh a piece by minus its score. In BPE models a path is what the merges give exactly if every two
neighbouring pieces are (Berglund and van der Merwe, 2023), so that a piece weighs 0 after a piece that the merges leave apart
from it and infinity after any other. The merges inside every piece are compiled, step by step, with the fragments at its two ends;
whether two pieces stay apart is read from these tables. As every prefix of a text has one path of finite weight, one piece a
position is all that the relaxation has to remember, for both kinds of model alike.
"""

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

SPACE = "▁"
#: Weight of an unknown character over the lightest piece, as the library has it.
UNKNOWN_PENALTY = 10.0
#: Distinct words whose ids, and pairs of pieces whose weight, a worker remembers before it starts afresh.
REMEMBERED_WORDS, REMEMBERED_PAIRS = 250_000, 250_000
#: A rank behind all others, and what stands before the first piece or for a character that no piece holds.
NEVER, NOTHING = 1 << 30, -1
#: Characters of a word up to which plain lists hold the lattice.
SHORT = 10_000
_WORD = re.compile(f"[ {SPACE}]+[^ {SPACE}]*|[^ {SPACE}]+")


class Transducer:
    """Normaliser (a space reads as the space sign, one goes ahead of the text), pieces with their weights, and byte fallback.

    `arcs` holds (state, code point) -> state, state 0 is the root, `final` the piece that ends at a state or -1. Symbols are the
    pieces, then characters that pieces hold but that are none themselves.
    """

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], bpe: bool = True, prefix: bool = True):
        """kinds: 1 piece, 2 unknown, 3 control, 6 byte, as in model files."""
        self.pieces, self.bpe, self.prefix = pieces, bpe, " " if prefix else ""
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 1}
        self.unknown = next((i for i, k in enumerate(kinds) if k == 2), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 6}
        self.out = [bytes([int(p[3:5], 16)]) if k == 6 else b"" if k == 3 else " ⁇ ".encode() if k == 2 else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds)]
        least = min((s for s, k in zip(scores, kinds) if k == 1), default=0.0)
        extra = sorted(set("".join(self.ids)) - set(self.ids))
        self.foreign = 0.0 if bpe else UNKNOWN_PENALTY - least
        self.weight = [0.0 if bpe else -s for s in scores] + [self.foreign] * len(extra)
        symbols = self.ids | {c: len(pieces) + k for k, c in enumerate(extra)}
        self.length = [0] * (len(pieces) + len(extra))
        for p, i in symbols.items():
            self.length[i] = len(p)
        usable = self._compile_merges(symbols, scores) if bpe else set(symbols.values())
        self._compile_arcs({p: i for p, i in symbols.items() if i in usable})
        joints = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.joints = joints | {a + b for j in joints if SPACE in j for a in (j[0], " " if j[0] == SPACE else j[0]) for b in (j[1], " " if j[1] == SPACE else j[1])}
        self.whole_words = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.pairs: dict[int, bool] = {}
        self.forget()

    def _compile_arcs(self, symbols: dict[str, int]) -> None:
        self.arcs: dict[int, int] = {}
        self.final = [-1]
        for p, i in symbols.items():
            state = 0
            for c in p:
                target = self.arcs.get(state << 21 | ord(c))
                if target is None:
                    target = self.arcs[state << 21 | ord(c)] = len(self.final)
                    self.final.append(-1)
                    if c == SPACE:  # the normaliser's arc: a space goes where the space sign goes
                        self.arcs[state << 21 | ord(" ")] = target
                state = target
            self.final[state] = i

    def _compile_merges(self, symbols: dict[str, int], scores: list[float]) -> set[int]:
        """For every symbol the states that its own merges pass through: rank of the next merge, fragments at its left and right
        end; `steps` says where they begin. Returns the symbols that their merges make whole."""
        rank = {s: k for k, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        self.joins = {symbols[p[:k]] << 20 | symbols[p[k:]]: rank[scores[i]] for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols}
        self.steps = array("i", [0] * len(self.length))
        self.next, self.left, self.right = array("i"), array("i"), array("i")
        joins, usable = self.joins, set()
        for p, i in symbols.items():
            at = [symbols[c] for c in p]
            spelt = list(p)
            self.steps[i] = len(self.next)
            while True:
                best, k = min(((joins.get(a << 20 | b, NEVER), k) for k, (a, b) in enumerate(zip(at, at[1:]))), default=(NEVER, 0))
                self.next.append(best)
                self.left.append(at[0])
                self.right.append(at[-1])
                if best == NEVER:
                    break
                spelt[k : k + 2] = [spelt[k] + spelt[k + 1]]
                at[k : k + 2] = [symbols[spelt[k]]]
            if len(at) == 1:
                usable.add(i)
        return usable

    @classmethod
    def load(cls, path: str) -> "Transducer":
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only normalisers that keep all characters are compiled")
        if model.trainer_spec.model_type not in (1, 2) or any(p.type not in (1, 2, 3, 6) for p in model.pieces):
            raise ValueError("only unigram and BPE models of plain, byte and control pieces are compiled")
        return cls([p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces], model.trainer_spec.model_type == 2, spec.add_dummy_prefix)

    def forget(self) -> None:
        """Let go of what was remembered of words, at the end of a task: other operators share the worker. Pairs are few and stay."""
        self.words: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}

    def apart(self, left: int, right: int) -> bool:
        """Whether the merges leave two neighbouring pieces as they are: the better merge goes first, the leftmost of equals, and none
        may reach across."""
        if left == NOTHING:
            return True
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            i, j = self.steps[left], self.steps[right]
            while True:
                a, b, across = self.next[i], self.next[j], self.joins.get(self.right[i] << 20 | self.left[j], NEVER)
                if across < a and across <= b or a == b == NEVER:
                    break
                if a <= b:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) > REMEMBERED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = across == NEVER
        return known

    def shortest_path(self, word: str) -> list[int]:
        """Symbols on the lightest path through the composition with a word; ~c for a character c that no piece holds."""
        n, infinity = len(word), float("inf")
        if n < SHORT:
            codes, cost, last = list(map(ord, word)), [infinity] * (n + 1), [NOTHING] * (n + 1)
        else:  # the same in less memory
            codes, cost, last = array("I", word.encode("utf-32-le")), array("d", [infinity]) * (n + 1), array("i", [NOTHING]) * (n + 1)
        cost[0] = 0.0
        step, final, weight, free, pairs, apart = self.arcs.get, self.final, self.weight, not self.bpe, self.pairs, self.apart
        for start in range(n):
            so_far, before = cost[start], last[start]
            opens, beside = free or before == NOTHING, before << 20
            state = step(codes[start])
            if state is None or final[state] < 0:  # fallback: one character on its own, which nothing joins
                if so_far + self.foreign < cost[start + 1]:
                    cost[start + 1], last[start + 1] = so_far + self.foreign, NOTHING
            end = start + 1
            while state is not None:
                piece = final[state]
                if piece >= 0:
                    total = so_far + weight[piece]
                    if total < cost[end]:
                        known = opens or pairs.get(beside | piece)
                        if known or known is None and apart(before, piece):
                            cost[end], last[end] = total, piece
                if end == n:
                    break
                state = step(state << 21 | codes[end])
                end += 1
        if cost[n] == infinity:
            raise AssertionError(f"no path over {word[:100]!r}")
        path = []
        while n:
            piece = last[n]
            path.append(piece if piece != NOTHING else ~codes[n - 1])
            n -= self.length[piece] if piece != NOTHING else 1
        return path[::-1]

    def lightest_path(self, word: str) -> list[str]:
        """Pieces (or single characters without a piece) on the lightest path."""
        spelt, at = [], 0
        for x in self.shortest_path(word):
            size = self.length[x] if x >= 0 else 1
            spelt.append(word[at : at + size])
            at += size
        return spelt

    def word_ids(self, word: str) -> tuple[int, ...]:
        """Where no piece holds two neighbouring characters, no path crosses between them, so that the parts are independent."""
        joints, known, ids, a = self.joints, self.parts, [], 0
        if len(known) > REMEMBERED_WORDS:
            known.clear()
        for b in range(1, len(word) + 1):
            if b == len(word) or word[b - 1 : b + 1] not in joints:
                part = word[a:b]
                got = known.get(part)
                if got is None:
                    got = self.part_ids(part)
                    if b - a < 100:
                        known[part] = got
                ids += got
                a = b
        return tuple(ids)

    def part_ids(self, word: str) -> tuple[int, ...]:
        ids, at = [], 0
        for x in self.shortest_path(word):
            if 0 <= x < len(self.pieces):
                ids.append(x)
            elif self.bytes:
                ids += [self.bytes[b] for b in word[at].encode()]
            else:
                ids.append(self.unknown)
            at += self.length[x] if x >= 0 else 1
        return tuple(ids)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text. Where no piece has a space after another character, words with the spaces ahead of them are independent."""
        if not text:
            return np.zeros(0, "u4")
        text = self.prefix + text
        if not self.whole_words:
            words = [text]
        elif "  " in text or text[0] != " " or text[-1] == " " or SPACE in text:
            words = _WORD.findall(text)
        else:
            words = [" " + w for w in text[1:].split(" ")]
        known = self.words
        ids: list[int] = []
        for w in words:
            got = known.get(w)
            if got is None:
                if len(known) > REMEMBERED_WORDS:
                    known.clear()
                got = self.word_ids(w)
                if len(w) < 100:
                    known[w] = got
            ids += got
        return np.array(ids, "u4")

    def decode(self, ids) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _loaded:
        _loaded[path] = Transducer.load(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, n_bytes, ids_crc32, round_trip[, ids]): ids of every whole text, how many are byte fallbacks, the
    unsigned crc32 of the ids as little-endian 32-bit integers, and whether decoding gives the text back.

    Null texts are empty and have no ids. Repeated rows and null ids are kept, other columns are not read, an empty table
    gives an empty one. A text that holds the space sign itself (U+2581) decodes to a space there, so its round trip is false.
    """

    def run(batches):
        t = transducer(model)
        fallback = np.zeros(len(t.pieces), bool)
        fallback[list(t.bytes.values())] = True
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [x or "" for x in part.column(1).to_pylist()]
                ids = [t.encode(x) for x in texts]
                columns = [
                    part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([int(fallback[x].sum()) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()), pa.array([t.decode(x.tolist()) == y for x, y in zip(ids, texts)]),
                ]
                names = ["doc_id", "n_tokens", "n_bytes", "ids_crc32", "round_trip"]
                if keep_ids:
                    columns.append(pa.array([x.astype("i4") for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        t.forget()

    schema = "doc_id long, n_tokens long, n_bytes long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * keep_ids
    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(lean(run), schema)


def decode_ids(encoded: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) from ids; null ids give an empty text, invalid UTF-8 gives replacement characters."""

    def run(batches):
        t = transducer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.decode(x or ()) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(doc_id).cast("long"), ids).mapInArrow(lean(run), "doc_id long, text string")
