"""WARC in Zstandard archives: a dictionary in the leading skippable frame, one frame per record, checked on reading."""

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Magic number of the skippable frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
#: Payload bytes in an archive; records, bytes and size of the dictionary's training sample, which is the archive's first records.
ARCHIVE_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 8_000_000, 200, 1_000_000, 16_384
#: Payloads from this size are stored once; later records refer to the stored one.
REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_digest, refers_to): of equal payloads of REVISIT_BYTES or more, the record with the largest
    page_id is the response and the others refer to it; all smaller ones are responses.

    Null html is an empty payload. Repeated rows with the largest page_id are all responses; a null page_id is below any other,
    and where all are null none refers to another.
    """
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    plain = plain.withColumn("payload_digest", F.sha1("payload"))
    large = plain.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    copies = large.where("n > 1").select(F.col("payload_digest").alias("d"), "kept")
    joined = plain.join(copies, (F.col("payload_digest") == F.col("d")) & (F.octet_length("payload") >= REVISIT_BYTES), "left")
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept")).alias("refers_to"))


def _name(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _clean(value: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value or "")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit keeps the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """Dictionary frame, then one frame per record. Archives with too few records for training hold an empty dictionary."""
    sample, held = [], 0
    for r in records[:SAMPLE_RECORDS]:
        sample.append(r[:20_000])
        held += len(sample[-1])
        if held > SAMPLE_BYTES:
            break
    raw = b""
    if len(sample) >= 16 and held > 8 * DICTIONARY_BYTES:
        try:
            raw = zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=200, d=8).as_bytes()
        except zstandard.ZstdError:  # e.g. all samples alike: there is nothing to learn
            raw = b""
    press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(raw)), raw, *map(press.compress, records)])


def build_archives(planned: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Planned records -> (archive binary, n_records int); a task fills archives of about archive_bytes of payload."""

    def run(batches):
        records, held = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "payload_digest", "refers_to"))):
                values = [x.as_py() for x in row]
                records.append(record(*values))
                held += len(records[-1])
                if held >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([archive(records)], pa.binary()), pa.array([len(records)], pa.int32())], ["archive", "n_records"])
                    records, held = [], 0
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([archive(records)], pa.binary()), pa.array([len(records)], pa.int32())], ["archive", "n_records"])

    return planned.mapInArrow(run, "archive binary, n_records int")


def frames(data: bytes):
    """The dictionary (None if empty) first, then each record's bytes; raises ValueError where the archive isn't whole."""
    if len(data) < 8:
        raise ValueError("archive is shorter than a dictionary frame")
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC or 8 + size > len(data):
        raise ValueError("no dictionary frame at the start")
    raw = data[8 : 8 + size]
    if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw)
    yield raw or None
    open_frame = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        try:
            about, end = zstandard.get_frame_parameters(view[at : at + 18]), at + zstandard.frame_header_size(view[at : at + 18])
            last = 0
            while not last:
                word = int.from_bytes(view[end : end + 3], "little")
                if end + 3 > len(data):
                    raise ValueError("frame is cut off")
                last, kind, length = word & 1, word >> 1 & 3, word >> 3
                end += 3 + (1 if kind == 1 else length)
            end += 4 * about.has_checksum
            if end > len(data):
                raise ValueError("frame is cut off")
            yield open_frame.decompress(view[at:end])
        except zstandard.ZstdError as e:
            raise ValueError(f"frame at byte {at}: {e}") from e
        at = end


def parse(data: bytes) -> dict:
    """Headers and payload of one record; raises ValueError where a header, a length or a digest is wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not found or not version.startswith("WARC/1."):
        raise ValueError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if missing := [k for k in REQUIRED if k not in fields]:
        raise ValueError(f"headers missing: {missing}")
    if len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't match the block")
    http, found, payload = rest[:-4].partition(b"\r\n\r\n")
    sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not found or len(sizes) != 1:
        raise ValueError("no HTTP headers")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    if fields["warc-type"] == "response":
        if len(payload) != sizes[0]:
            raise ValueError("HTTP Content-Length doesn't match the payload")
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("payload digest doesn't match")
    elif fields["warc-type"] != "revisit" or payload or not fields.get("warc-refers-to"):
        raise ValueError("neither a response nor a revisit of another record")
    number = lambda name: int(x) if (x := name.removeprefix("<urn:x-page:").removesuffix(">")) else None
    return {
        "page_id": number(fields["warc-record-id"]), "payload_bytes": sizes[0], "payload_digest": digest, "record_type": fields["warc-type"],
        "refers_to": number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, "url": fields.get("warc-target-uri"), "payload": payload,
    }


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """(archive binary, ...) -> one row per record. An archive or record that isn't whole fails the job with its reason."""
    schema = READ if payloads else READ.removesuffix(", payload binary")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for k, x in enumerate(frames(data.as_py())):
                    if k:
                        rows.append(parse(x))
                        held += len(x) * payloads + 100
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds)], names)
                        rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds)], names)

    return archives.select("archive").mapInArrow(run, schema)


def save_files(archives: DataFrame, uri: str) -> DataFrame:
    """Write each archive as <uri>/<sha1>.warc.zst in a store that pyarrow opens; returns (file, bytes) when evaluated. A file is
    complete when it appears, and a task that runs again writes the same name."""

    def run(batches):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                name = f"{folder}/{hashlib.sha1(data).hexdigest()}.warc.zst"
                with store.open_output_stream(f"{name}.part") as out:
                    out.write(data)
                store.move(f"{name}.part", name)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data)], pa.int64())], ["file", "bytes"])

    return archives.select("archive").mapInArrow(run, "file string, bytes long")


def open_files(spark, path: str) -> DataFrame:
    """Archives of a folder of .warc.zst files, for read_archives."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select(F.col("content").alias("archive"))
