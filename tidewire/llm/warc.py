"""WARC archives compressed with Zstandard: a writer and a reader.

An archive begins with a skippable frame that holds a dictionary (plain, or
itself a Zstandard frame), followed by one frame per record, compressed with
that dictionary.  Writers run inside Spark tasks, each making archives of a
bounded size under names of its own; the manifest, which Spark commits, lists the
archives of the attempts that count.  Readers stream one frame at a time.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, local_path, new_path, written

#: First four bytes of the skippable frame with the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"

#: Bound on the rows from which a dictionary is trained, and on its bytes.
DICTIONARY_ROWS = 400
DICTIONARY_CHARS = 100_000
DICTIONARY_BYTES = 64 << 10

#: An archive is closed once it has this many compressed bytes.
ARCHIVE_BYTES = 32 << 20

#: A task reads about so many archives at most (256 MB compressed).
ARCHIVES_PER_TASK = 8

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record or an archive that breaks the format."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; ``file:`` URIs of any spelling are local."""
    return (pafs.LocalFileSystem(), local_path(uri)) if uri.startswith(("file:", "/")) else pafs.FileSystem.from_uri(uri)


def build_record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One uncompressed record.  A revisit has the HTTP head only; its payload is another record's."""
    url = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    digest = payload_digest(payload)
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {kind} {digest}")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Page-ID", "" if page_id is None else page_id),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To-Page-ID", refers_to)]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Headers and block of one record; ``WarcError`` if it is malformed."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        raise WarcError("no WARC version line and header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"header line without a name: {line[:60]!r}")
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not headers.get(name):
            raise WarcError(f"{name} is missing")
    if not headers["content-length"].isdigit():
        raise WarcError("content-length is no number")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"block of {max(len(rest) - 4, 0)} bytes; content-length says {size}")
    block = rest[:size]
    if (said := headers.get("warc-block-digest")) and said != f"sha1:{payload_digest(block)}":
        raise WarcError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if headers["warc-type"] == "response" and said and said != payload_digest(payload):
        raise WarcError("payload digest differs")
    length = len(payload)
    if headers["warc-type"] == "revisit":
        found = [x.split(b":")[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        if not found or not found[0].isdigit():
            raise WarcError("revisit without the length of its payload")
        length = int(found[0])
    return {"headers": headers, "payload": payload, "payload_bytes": length, "payload_digest": said or payload_digest(payload)}


def dictionary_frame(dictionary: bytes) -> bytes:
    return DICTIONARY_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary


class _Source:
    """Bytes of a stream, read in pieces, with some pushed back."""

    def __init__(self, stream, piece: int = 1 << 20) -> None:
        self.stream, self.piece, self.left = stream, piece, b""

    def take(self, n: int) -> bytes:
        while len(self.left) < n and (more := self.stream.read(self.piece)):
            self.left += more
        out, self.left = self.left[:n], self.left[n:]
        return out

    def more(self) -> bytes:
        out, self.left = self.left or self.stream.read(self.piece), b""
        return out


def frames(stream, lenient: bool = False) -> Iterator[bytes | WarcError]:
    """Decoded frames of an archive, one at a time.

    The dictionary comes from the leading skippable frame, if there is one; other
    skippable frames are passed over.  Anything else that is not a whole Zstandard frame is a
    ``WarcError``: raised, or, if ``lenient``, given in the broken frame's place, and reading goes on at the
    next frame that can be decoded.
    """
    source = _Source(stream)
    reader = zstandard.ZstdDecompressor()
    first, lost = True, False
    while start := source.take(4):
        magic = int.from_bytes(start, "little")
        raw = [start]  # what has been read of this frame
        try:
            if len(start) == 4 and 0x184D2A50 <= magic <= 0x184D2A5F:
                raw.append(source.take(4))
                size = int.from_bytes(raw[1], "little")
                if lost and size > 1 << 24:  # the magic may be a broken frame's content
                    raise WarcError("no skippable frame")
                data = source.take(size)
                raw.append(data)
                if len(data) != size:
                    raise WarcError("skippable frame cut short")
                if first and magic == DICTIONARY_MAGIC:
                    if data.startswith(FRAME_MAGIC):
                        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
                    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
            elif start == FRAME_MAGIC:
                frame, out = reader.decompressobj(), []
                out.append(frame.decompress(start))
                while not frame.eof:
                    if not (piece := source.more()):
                        raise WarcError("frame cut short")
                    raw.append(piece)
                    out.append(frame.decompress(piece))
                source.left = frame.unused_data + source.left
                lost = False
                yield b"".join(out)
            else:
                raise WarcError(f"no frame begins with {start!r}")
        except (WarcError, zstandard.ZstdError) as e:
            problem = e if isinstance(e, WarcError) else WarcError(f"frame can't be decoded: {e}")
            if not lenient:
                raise problem from e
            if not lost:  # one problem for a run of bytes that can't be read
                yield problem
            lost = True
            source.left = b"".join(raw)[1:] + source.left
            if not _find_frame(source):
                return
        first = False


def _find_frame(source: _Source) -> bool:
    """Moves on to the next bytes that may begin a frame; false at the end."""
    held = b""
    while piece := source.more():
        held += piece
        at = held.find(FRAME_MAGIC)
        if at >= 0:
            source.left = held[at:] + source.left
            return True
        held = held[-3:]
    return False


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from whole records of at most ``DICTIONARY_ROWS`` pages of bounded length; empty if they
    are too few or too small.  It only makes archives smaller: their records hold every page whole."""
    rows = pages.where(F.length("html") <= DICTIONARY_CHARS).select("html", "url").limit(DICTIONARY_ROWS).collect()
    samples = [build_record("response", 0, r["url"], r["html"].encode(), None, "2024-01-01T00:00:00Z") for r in rows]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html and ``keeper``: the largest page_id with an equal payload, for payloads that several rows have."""
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("_sha", F.sha1(F.col("html").cast("binary")))
    groups = own.groupBy("_sha").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return join_hot(own, written(groups, "warc-groups"), ["_sha"], "n", "left").drop("_sha", "n")


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html) and return the manifest: path, records, bytes.

    Null html is an empty payload.  Of rows with equal payloads the one with the
    largest page_id is a response and the others revisit it; rows that share
    that page_id are responses too, and so are all rows of a group without any
    page_id.  A null page_id in another group revisits.  An empty table writes no
    archive; columns other than the three are ignored.  Payloads are written whole, however long.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    shared = spark.sparkContext.broadcast(train_dictionary(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        trained = shared.value
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_checksum=True)
        done: list[tuple[str, int, int]] = []
        out, path, records, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, html, keeper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, records, size = f"{base}/{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = fs.open_output_stream(path, compression=None)
                    if trained:
                        out.write(frame := dictionary_frame(trained))
                        size += len(frame)
                again = keeper is not None and page_id != keeper
                frame = packer.compress(build_record("revisit" if again else "response", page_id, url, html, keeper if again else None, date))
                out.write(frame)
                records, size = records + 1, size + len(frame)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        yield pa.record_batch([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    rows = plan_records(pages).select("page_id", "url", F.col("html").cast("binary").alias("html"), "keeper")
    manifest = rows.mapInArrow(run, "path string, records long, bytes long")
    scheme = "" if folder.startswith(("file:", "/")) else folder.split("://")[0] + "://"
    return written(manifest.withColumn("path", F.concat(F.lit(scheme), "path")), "warc-manifest")


def read_archives(manifest: DataFrame, payload: bool = True, strict: bool = True) -> DataFrame:
    """The records of the archives in ``manifest`` (path).

    Returns page_id, url, record_type, payload_bytes, payload_digest, refers_to,
    payload (null for revisits, or if not asked for) and ``problem``.  A record that breaks the
    format fails the job if ``strict``; otherwise it becomes a row with only a
    ``problem``, as does a run of bytes that can't be decoded, and reading goes on behind it.  An empty manifest gives no rows.  A task reads about ``ARCHIVES_PER_TASK`` archives at most.
    """
    fields = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("problem", pa.string())])

    def rows(path: str) -> Iterator[tuple]:
        fs, name = filesystem(path)
        with fs.open_input_stream(name, compression=None) as stream:
            for record in frames(stream, lenient=not strict):
                try:
                    if isinstance(record, WarcError):
                        raise record
                    r = parse_record(record)
                    number = lambda k, h=r["headers"]: int(h[k]) if h.get(k) else None
                    kind = r["headers"]["warc-type"]
                    yield number("warc-page-id"), r["headers"].get("warc-target-uri"), kind, r["payload_bytes"], r["payload_digest"], number("warc-refers-to-page-id"), r["payload"] if payload and kind != "revisit" else None, None
                except WarcError as e:
                    if strict:
                        raise WarcError(f"{path}: {e}") from e
                    yield None, None, None, None, None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for r in rows(path):
                    held.append(r)
                    size += 200 + len(r[6] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), fields, strict=True)], schema=fields)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), fields, strict=True)], schema=fields)

    kinds = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, problem string"
    # the manifest is small, its archives are not: a stated number of tasks, which AQE leaves as it is, follows the archives
    n = manifest.count()
    per_task = max(1, min(ARCHIVES_PER_TASK, n // manifest.sparkSession.sparkContext.defaultParallelism))
    return manifest.select("path").repartition(max(1, math.ceil(n / per_task))).mapInArrow(run, kinds)
