"""Token files: ids of all documents in canonical length-limited Huffman code, in independent blocks with bit-offset checkpoints."""

import re
import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, flat, lean, shared_dir, width, written

#: Longest code in bits; the decoding table has 2 ** MAX_BITS entries.
MAX_BITS = 18
#: Tokens after which a block is closed (at the end of a document), and between two checkpoints.
BLOCK_TOKENS, STRIDE = 1 << 19, 256
#: Distinct pieces of text whose ids a worker remembers before it starts afresh.
REMEMBERED = 900_000
#: Id that ends every document.
END_ID = 2

_INSIDE = re.compile(r"(?<=\S) (?=\S)")
#: A word with marks behind it, and the same again on the next line: the vocabulary's pattern splits it at these places.
_SIMPLE = re.compile(r"([^\W\d_]+)([.,;:!?]*)(?:(\n)([^\W\d_]+)([.,;:!?]*))?")


class Encoder:
    """Ids of whole texts by the tokenizers library, remembering the ids of the pieces between single spaces.

    The vocabulary's pattern never joins text across a space that stands between two characters that aren't spaces, nor
    letters with the marks behind them, so that encoding the pieces apart gives the same ids. The distinct pieces of a batch are
    looked up once; the ids of its texts are then taken from one array.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self._forget()

    def _forget(self) -> None:
        self.after: dict[str, int] = {}  # number of a piece with a space before it
        self.parts: dict[str, int] = {}  # number of a string without one
        self.ids = np.full(1 << 16, END_ID, self.kind)
        self.begin, self.size = np.zeros(1 << 12, "i8"), np.zeros(1 << 12, "i8")
        self.size[0], self.known, self.filled = 1, 1, 1  # number 0 is the end id

    def _keep(self, numbers: dict[str, int], words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        """Number the words and put their ids behind those that are known."""
        known, filled = self.known + len(words), self.filled + len(ids)
        if known > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros(max(known, len(x)), "i8")]) for x in (self.begin, self.size))
        if filled > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(filled, len(self.ids)), self.kind)])
        self.ids[self.filled : filled] = ids
        self.begin[self.known : known], self.size[self.known : known] = self.filled + np.cumsum(size) - size, size
        numbers.update(zip(words, range(self.known, known)))
        self.known, self.filled = known, filled

    def _keep_each(self, numbers: dict[str, int], words: list[str], lead: str) -> None:
        found = [e.ids for e in self.library.encode_batch_fast([lead + x for x in words], add_special_tokens=False)]
        size = np.fromiter(map(len, found), "i8", len(found))
        self._keep(numbers, words, np.fromiter(chain.from_iterable(found), self.kind, int(size.sum())), size)

    def _learn_words(self, words: list[str]) -> None:
        """Words of letters, each with a space before it, go to the library as one text."""
        for k in range(0, len(words), 1000):
            part = words[k : k + 1000]
            found = self.library.encode(" " + " ".join(part), add_special_tokens=False)
            size = np.bincount(np.array(found.word_ids, "i8"), minlength=len(part))
            if len(size) > len(part):  # the library splits one of these words
                self._keep_each(self.after, part, " ")
            else:
                self._keep(self.after, part, np.array(found.ids, self.kind), size)

    def _learn_parts(self, parts: set[str]) -> None:
        self._keep_each(self.parts, list(parts.difference(self.parts)), "")

    def _learn(self, words: list[str]) -> None:
        bare, whole, pieces, other = [], [], [], []
        for w in words:
            if w.isalpha():
                bare.append(w)
            elif m := _SIMPLE.fullmatch(w):
                whole.append(w)
                pieces.append(m.groups(""))
            else:
                other.append(w)
        after, parts = self.after, self.parts
        self._learn_words(bare)
        self._keep_each(after, other, " ")
        if whole:
            word, *tails = zip(*pieces)
            self._learn_words(list(set(word).difference(after)))
            self._learn_parts(set().union(*tails))
            codes = np.array([list(map(after.__getitem__, word)), *(list(map(parts.__getitem__, t)) for t in tails)]).T
            size = self.size[codes]
            self._keep(after, whole, self.ids[flat(self.begin[codes].ravel(), size.ravel())], size.sum(1))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, END_ID last."""
        return binaries(*self.encode_all(texts)).to_pylist()

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, END_ID behind each, and their number by text."""
        if self.known > REMEMBERED:
            self._forget()
        if not texts:
            return np.zeros(0, self.kind), np.zeros(0, "i8")
        odd = [i for i, t in enumerate(texts) if "  " in t or t[-1:] == " " or t[:1] == " "]
        plain = list(texts)
        for i in odd:
            plain[i] = ""
        split = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        words, count = split.flatten(), np.diff(split.offsets.to_numpy())
        if odd:
            apart = [_INSIDE.split(texts[i]) for i in odd]
            begin, place = len(words) + np.cumsum([0] + [len(x) for x in apart[:-1]]), split.offsets.to_numpy()[:-1].copy()
            place[odd], count = begin, count.copy()
            count[odd] = [len(x) for x in apart]
            words = pa.concat_arrays([words, pa.array([w for x in apart for w in x], pa.large_string())]).take(pa.array(flat(place, count)))
        coded = words.dictionary_encode()
        first = np.cumsum(count) - count
        which = coded.indices.to_numpy()
        names = coded.dictionary.to_pylist()
        inner = np.ones(len(which), bool)
        inner[first] = False
        used = np.zeros(len(names), bool)
        used[which[inner]] = True
        at = np.flatnonzero(used).tolist()
        get = self.after.get
        if new := [w for k in at if get(w := names[k]) is None]:
            self._learn(new)
        number = np.zeros(len(names), "i8")
        number[at] = np.fromiter((get(names[k]) for k in at), "i8", len(at))
        heads = [names[k] for k in which[first].tolist()]
        self._learn_parts(set(heads))
        # one number for each piece, and number 0 behind each text
        ends = np.cumsum(count + 1)
        codes = np.zeros(int(ends[-1]), "i8")
        codes[np.arange(len(which)) + np.repeat(np.arange(len(texts)), count)] = number[which]
        codes[ends - count - 1] = [self.parts[w] for w in heads]
        size = self.size[codes]
        return self.ids[flat(self.begin[codes], size)], np.add.reduceat(size, ends - count - 1)


def binaries(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary value for each run of ids, sharing their memory."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * ids.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(np.ascontiguousarray(ids))])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _batches_of(batch: pa.RecordBatch, chars: int = 8_000_000):
    """Row ranges of a batch with at most about so many characters."""
    at, held = 0, 0
    sizes = pc.utf8_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(sizes):
        held += n
        if held >= chars:
            yield at, i + 1
            at, held = i + 1, 0
    if at < batch.num_rows:
        yield at, batch.num_rows


def encode_documents(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text) -> (doc_id, kind, ids): kind 0 holds a document's ids, END_ID last; kind 1 holds a task's counts by id."""

    def run(batches):
        own = encoder(tokenizer)
        counts = np.zeros(own.library.get_vocab_size() + 1, "i8")
        for batch in batches:
            for a, b in _batches_of(batch):
                part = batch.slice(a, b - a)
                ids, sizes = own.encode_all([x or "" for x in part.column(1).to_pylist()])
                counts += np.bincount(ids, minlength=len(counts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.zeros(len(sizes), "i4")), binaries(ids, sizes)], ["doc_id", "kind", "ids"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([1], pa.int32()), pa.array([zlib.compress(counts.tobytes())], pa.binary())], ["doc_id", "kind", "ids"])

    return docs.select(F.col(doc_id).cast("long"), text).mapInArrow(lean(run), "doc_id long, kind int, ids binary")


def id_counts(encoded: DataFrame) -> DataFrame:
    """(id, count) over all documents, from the counts that the tasks left."""

    def run(batches):
        for batch in batches:
            total = sum(np.frombuffer(zlib.decompress(x), "i8") for x in batch.column(0).to_pylist())
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(np.asarray(total)[at])], ["id", "count"])

    return encoded.where("kind = 1").select("ids").mapInArrow(lean(run), "id int, count long").groupBy("id").agg(F.sum("count").alias("count"))


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Code length of each symbol with a count (others 0), none over limit, by package-merge."""
    lengths = np.zeros(len(counts), "u1")
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit in codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype("f8")
    levels, current = [], weights
    for _ in range(limit):
        merged = np.concatenate([weights, current]) if levels else weights
        item = np.arange(len(merged)) < len(weights)
        by = np.argsort(merged, kind="stable")
        merged, item = merged[by], item[by]
        levels.append(item)
        current = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(used) - 2
    sizes = np.zeros(len(used), "u1")
    for item in reversed(levels):
        items = int(item[:take].sum())
        sizes[:items] += 1
        take = 2 * (take - items)
    lengths[order] = sizes
    return lengths


class Code:
    """Canonical code of given lengths: shorter codes first, then smaller ids."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        used = np.flatnonzero(lengths)
        used = used[np.lexsort((used, lengths[used]))]
        self.bits = bits = max(int(lengths.max(initial=1)), 1)
        share = np.left_shift(1, bits - lengths[used].astype("i8"))
        self.codes = np.zeros(len(lengths), "u8")
        self.codes[used] = (np.cumsum(share) - share) >> (bits - lengths[used].astype("i8"))
        self.symbol, self.size = np.zeros(1 << bits, "i4"), np.ones(1 << bits, "i8")
        filled = int(share.sum())
        self.symbol[:filled], self.size[:filled] = np.repeat(used, share), np.repeat(lengths[used], share)

    def pack(self, ids: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
        """Bits of ids, first bit highest, and the bit offset of every stride-th id."""
        sizes = self.lengths[ids].astype("i8")
        start = np.cumsum(sizes) - sizes
        words = int((start[-1] + sizes[-1] + 31) >> 5) if len(ids) else 0
        value = self.codes[ids] << (64 - (start & 31) - sizes).astype("u8")
        at = start >> 5  # codes don't overlap, so sums of their halves are exact
        total = np.bincount(at, (value >> np.uint64(32)).astype("f8"), words + 2)
        total += np.bincount(at + 1, (value & np.uint64(0xFFFFFFFF)).astype("f8"), words + 2)
        return total[:words].astype(">u4").tobytes(), start[::stride].astype("<u8")

    def unpack(self, data: bytes, checkpoints: np.ndarray, n: int, stride: int = STRIDE) -> np.ndarray:
        """The n ids of a block: all stretches between checkpoints are decoded side by side, one table look-up a step."""
        words = np.concatenate([np.frombuffer(data, ">u4").astype("u8"), np.zeros(2, "u8")])
        at, last, out = checkpoints.astype("i8"), len(words) - 2, np.empty((min(stride, n), len(checkpoints)), "i4")
        shift = np.uint64(64 - self.bits)
        for k in range(len(out)):
            i = np.minimum(at >> 5, last)
            peek = (((words[i] << np.uint64(32)) | words[i + 1]) << (at & 31).astype("u8")) >> shift
            out[k] = self.symbol[peek]
            at += self.size[peek]
        return out.T.ravel()[:n]


MAGIC, VERSION = b"RTOK", 1
_HEADER = struct.Struct("<4sHBBI")


def header(lengths: np.ndarray, width: int, stride: int = STRIDE) -> bytes:
    """Head of a token file: magic, version, bytes of an id, 0, stride, then the packed code length of every id."""
    return _HEADER.pack(MAGIC, VERSION, width, 0, stride) + zlib.compress(lengths.astype("u1").tobytes())


def read_header(data: bytes) -> tuple[np.ndarray, int, int]:
    """Code lengths, bytes of an id and stride from the head of a token file; ValueError where it is none."""
    magic, version, width, _, stride = _HEADER.unpack_from(data) if len(data) >= _HEADER.size else (b"", 0, 0, 0, 0)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token file of this version")
    return np.frombuffer(zlib.decompress(data[_HEADER.size :]), "u1"), width, stride


BLOCKS = "file int, block int, code long, rel_start long, n_tokens long, doc_ids array<long>, doc_tokens binary, checkpoints binary, bits binary"
_BLOCK_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
_BLOCK_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]


def write_blocks(encoded: DataFrame, lengths: np.ndarray, kind: str, partitions: int) -> DataFrame:
    """Token files, one for each range partition in ascending doc_id order (nulls first). Block -1 of a file is its header, in bits;
    the others hold whole documents: code (crc32 of the header that they are decoded with), rel_start (tokens before the block in
    its file), n_tokens, doc_ids, doc_tokens, checkpoints, bits."""
    head = header(lengths, np.dtype(kind).itemsize)
    code_id = zlib.crc32(head)

    def run(batches):
        from pyspark import TaskContext

        code, file = Code(lengths), TaskContext.get().partitionId()
        block, start, names, ids, held = 0, 0, [], [], 0
        row = lambda *x: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((file, *x), _BLOCK_TYPES)], _BLOCK_NAMES)
        yield row(-1, code_id, 0, 0, [], b"", b"", head)

        def closed():
            tokens = np.frombuffer(b"".join(ids), kind)
            data, checkpoints = code.pack(tokens)
            sizes = np.array([len(x) // np.dtype(kind).itemsize for x in ids], "<u8")
            return row(block, code_id, start, len(tokens), names, sizes.tobytes(), checkpoints.tobytes(), data)

        for batch in batches:
            for name, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(name)
                ids.append(x.as_py())
                held += len(ids[-1]) // np.dtype(kind).itemsize
                if held >= BLOCK_TOKENS:
                    yield closed()
                    block, start, names, ids, held = block + 1, start + held, [], [], 0
        if names:
            yield closed()

    in_order = encoded.where("kind = 0").select("doc_id", "ids").repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "ids")
    return in_order.mapInArrow(lean(run), BLOCKS)


def read_blocks(blocks: DataFrame) -> DataFrame:
    """Decode blocks apart from each other, by the files alone: (file, doc_id, rel_start, ids as little-endian unsigned 32-bit
    integers). All files of one table have one code, so that the header of the first serves all (its size is bounded by the
    vocabulary); a block of another code is an error."""
    first = blocks.where("block = -1").orderBy("file").select("bits").first()
    head = bytes(first["bits"]) if first else header(np.zeros(0, "u1"), 2)
    lengths, _, stride = read_header(head)
    code_id = zlib.crc32(head)

    def run(batches):
        code = Code(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                if row["code"] != code_id:
                    raise ValueError(f"file {row['file']} is written with another code")
                ids = code.unpack(row["bits"], np.frombuffer(row["checkpoints"], "<u8"), row["n_tokens"], stride).astype("<u4")
                sizes = np.frombuffer(row["doc_tokens"], "<u8").astype("i8")
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(sizes), row["file"], "i4")), pa.array(row["doc_ids"], pa.int64()), pa.array(row["rel_start"] + ends - sizes), binaries(ids, sizes)],
                    ["file", "doc_id", "rel_start", "ids"],
                )

    return blocks.where("block >= 0").mapInArrow(lean(run), "file int, doc_id long, rel_start long, ids binary")


def open_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of the token files below path: start counts the tokens of all documents before; one number for each file
    is all that the driver holds."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = sorted((r["file"], r["n"]) for r in blocks.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect())
    before = np.cumsum([0] + [n for _, n in totals]).tolist()
    files = spark.createDataFrame([(f, x) for (f, _), x in zip(totals, before)], "file int, before long")
    opened = read_blocks(blocks).join(F.broadcast(files), "file")
    return opened.select("doc_id", (F.col("before") + F.col("rel_start")).alias("start"), "ids")


def save_files(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Write the ids of docs (doc_id, text) as token files below path, one code over all documents.

    Null texts are empty documents of one token; null doc_ids come first; repeated rows are kept, next to each other; other
    columns are not read; an empty table gives empty files. The driver holds one number for each id of the vocabulary.
    """
    encoded = written(encode_documents(docs, tokenizer), "ids")
    counted = id_counts(encoded).collect()  # at most one row for each id of the vocabulary
    counts = np.zeros(max([int(r["id"]) for r in counted], default=0) + 1, "i8")
    for r in counted:
        counts[r["id"]] = r["count"]
    write_blocks(encoded, code_lengths(counts), encoder(tokenizer).kind, width(docs.sparkSession)).write.parquet(path)
    discard(encoded)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document, from files in the shared folder: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    save_files(docs, tokenizer, path)
    opened = open_files(spark, path)
    return opened.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
