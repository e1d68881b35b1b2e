"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by page_id. The ranges follow from the data alone: ids are counted, by bytes, in bins of their
leading bits, heavy bins in finer ones, and cut where a range is full; an id heavier than a range is cut by its digests. So
equal pages give equal files, whatever the session, its partitions or retries. Each range rolls its files by compressed
size, regenerates headers and digests, writes each file under a temporary name and moves it to its final one. The driver
commits the files in a manifest; a file that no manifest names doesn't exist for readers.

Of records with equal payloads of at least `least` bytes, the one with the largest page_id is the response and the others
are revisits of it.

Defined results: a null html is an empty payload; a null url is an empty target; rows with equal page_id and payload are
one response and revisits of the same id; a null page_id sorts first, and never is referred to while another id is there;
an empty table gives an empty archive; other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, scratch, written
from .files import commit, get, opened, put, temporary

LEAST = 1000
ROLL_BYTES = 256_000_000
#: Ranges that an archive falls into (fewer, if that made them smaller than RANGE_LEAST bytes; more, beyond RANGE_BYTES each).
RANGES, RANGE_LEAST, RANGE_BYTES = 512, 4 << 20, 1 << 30
#: Bytes that a record has besides its payload; bits by which heavy bins are cut finer.
RECORD_BYTES, FINER = 512, 6
#: What a null id counts as in the order of ids.
FIRST = -(1 << 63)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "file string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"
NO_ID = 1 << 63


def record_id(page_id: int | None, copy: int = 0) -> str:
    """A URN whose low 64 bits are the page_id and whose high ones tell rows with equal page_id apart."""
    low = NO_ID if page_id is None else page_id & 0x7FFF_FFFF_FFFF_FFFF | (NO_ID if page_id < 0 else 0)
    text = f"{(copy << 1 | (page_id is None)) & (1 << 64) - 1:016x}{low:016x}"
    return f"<urn:uuid:{text[:8]}-{text[8:12]}-{text[12:16]}-{text[16:20]}-{text[20:]}>"


def page_of(urn: str | None) -> int | None:
    if not urn:
        return None
    digits = urn.removeprefix("<urn:uuid:").removesuffix(">").replace("-", "")
    if int(digits[:16], 16) & 1:
        return None
    low = int(digits[16:], 16)
    return low - (1 << 64) if low >= NO_ID else low


def record(kind: str, page_id: int | None, copy: int, url: str, payload: bytes, digest: bytes, refers_to: int | None, date: str) -> bytes:
    """One gzip member with one WARC record."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, copy)}",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "revisit":
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    else:
        block += payload
    head.append(f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}")
    head.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(5, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def clean_url(url: str | None) -> str:
    return "".join(c for c in url or "" if c.isprintable() and c != " ")


class Roller:
    """Writes members to files of one range, a new one once a file has reached the size."""

    def __init__(self, folder: str, task: int, limit: int) -> None:
        self.fs, self.folder = opened(folder)
        self.task, self.limit, self.number, self.out = task, limit, 0, None
        self.done: list[tuple[str, int, int, str]] = []

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.task:06d}-{self.number:05d}.warc.gz"
            self.temp = temporary(f"{self.folder}/{self.name}")
            self.out, self.size, self.count, self.hash = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
        self.out.write(member)
        self.hash.update(member)
        self.size, self.count = self.size + len(member), self.count + 1
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            commit(self.fs, self.temp, f"{self.folder}/{self.name}")
            self.done.append((self.name, self.count, self.size, self.hash.hexdigest()))
            self.out, self.number = None, self.number + 1


def range_starts(sizes: DataFrame, ranges: int = RANGES, least: int = RANGE_LEAST, most: int = RANGE_BYTES) -> list[tuple[int, int]]:
    """Starts (page_id, first 32 bits of the digest) of the ranges of rows (page_id, bytes), in order; a null id counts as the least one.

    The driver sees a few bins for each range.
    """
    rows = sizes.select(F.coalesce("page_id", F.lit(FIRST)).alias("k"), (F.col("bytes") + RECORD_BYTES).alias("w"))
    total, low, high = rows.agg(F.sum("w"), F.min("k"), F.max("k")).first()
    starts = [(FIRST, 0)]
    if total is None:
        return starts
    goal = min(most, max(least, -(-total // ranges)))
    shift = max(0, (high - low).bit_length() - (-(-total // goal)).bit_length() - 3)
    leaves: list[tuple[int, int]] = []
    while True:
        bins = [tuple(r) for r in rows.groupBy(F.shiftright("k", shift).alias("bin")).agg(F.sum("w").alias("w")).collect()]
        heavy = [b for b, w in bins if w > goal and shift]
        leaves += [(b << shift, w) for b, w in bins if w <= goal or not shift]
        if not heavy:
            break
        inside = rows.sparkSession.createDataFrame([(b,) for b in heavy], "bin long")
        rows = rows.join(inside, F.shiftright("k", shift) == F.col("bin"), "left_semi")
        shift = max(0, shift - FINER)
    held = 0
    for k, w in sorted(leaves):
        if held and held + w > goal:
            starts.append((k, 0))
            held = 0
        held += w
        if w > goal:
            parts = -(-w // goal)
            starts += [(k, (j << 32) // parts) for j in range(1, parts)]
            held = goal
    return starts


def range_of(starts: list[tuple[int, int]]):
    """A function of arrays (ids, first 32 bits of digests): the number of the range that holds each."""
    ids = np.array(sorted({k for k, _ in starts}), np.int64)
    places = np.searchsorted(ids, np.array([k for k, _ in starts], np.int64)).astype(np.uint64)
    edges = places << np.uint64(33) | np.array([d for _, d in starts], np.uint64)

    def of(k: np.ndarray, digest: np.ndarray) -> np.ndarray:
        at = np.searchsorted(ids, k, side="right") - 1
        # past a start's own id all of its digests lie behind
        bits = np.where(ids[at] == k, digest.astype(np.uint64), np.uint64(1 << 32))
        return (np.searchsorted(edges, at.astype(np.uint64) << np.uint64(33) | bits, side="right") - 1).astype(np.int32)

    return of


def write_archive(pages: DataFrame, folder: str, least: int = LEAST, roll_bytes: int = ROLL_BYTES, date: str = "2024-01-01T00:00:00Z", ranges: int = RANGES, range_least: int = RANGE_LEAST) -> DataFrame:
    """Writes pages (page_id, url, html) as an archive in folder; returns the manifest: file, records, bytes, sha256."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    # Ids, digests and sizes alone say what is equal and where ranges begin; written out so that their size decides how they are joined.
    sizes = written(rows.select("page_id", "digest", F.octet_length("payload").cast("long").alias("bytes")), "sizes")
    groups = sizes.filter(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.filter("n > 1").select("digest", "keeper"), "equal-payloads")
    rows = rows.join(groups, (rows["digest"] == groups["digest"]) & (F.octet_length("payload") >= least), "left").select("page_id", "url", "payload", rows["digest"], "keeper")
    starts = range_starts(sizes, ranges, range_least)
    of = range_of(starts)

    @F.pandas_udf("int")
    def number(k: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series(of(k.to_numpy(), digest.to_numpy()))

    key = F.coalesce("page_id", F.lit(FIRST)), F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    rows = rows.withColumn("range", number(*key)).repartition("range").sortWithinPartitions("range", F.col("page_id").asc_nulls_first(), "digest", "url")
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)
    parted = {n: k for n, (k, d) in enumerate(starts) if d}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, last, copies, kept = None, None, 0, set()
        done: list[tuple[str, int, int, str]] = []
        for batch in pieces(batches, 2):
            for page_id, url, payload, digest, keeper, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = roller is None or roller.task != part
                if new:
                    if roller is not None:
                        roller.close()
                        done += roller.done
                    roller = Roller(folder, part, roll_bytes)
                if new or page_id != last:
                    # an id that goes on from the range before has copies of its own numbers
                    copies = part << 32 if parted.get(part) == (FIRST if page_id is None else page_id) else 0
                    kept, last = set(), page_id
                revisit = keeper is not None and (page_id != keeper or digest in kept)
                if keeper is not None and page_id == keeper:
                    kept.add(digest)
                roller.add(record("revisit" if revisit else "response", page_id, copies, clean_url(url), payload, digest, keeper if revisit else None, date))
                copies += 1
        if roller is not None:
            roller.close()
            done += roller.done
        names, counts, bytes_, hashes = zip(*done, strict=True) if done else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(bytes_, pa.int64()), pa.array(hashes, pa.string())], names=["file", "records", "bytes", "sha256"])

    manifest = written(rows.select("page_id", "url", "payload", "digest", "keeper", "range").mapInArrow(write, WRITTEN), "manifest")
    # One small row for each file: the only thing that the driver holds.
    files = [r.asDict() for r in manifest.orderBy("file").toLocalIterator()]
    put(f"{folder}/manifest.json", json.dumps({"written": date, "starts": starts, "files": files}, indent=0).encode())
    return manifest


def members(fs, path: str) -> Iterator[bytes]:
    """The gzip members of a file, each unpacked."""
    with fs.open_input_stream(path, compression=None) as f:
        unpacker, out, more = zlib.decompressobj(31), [], b""
        while True:
            chunk = more or f.read(1 << 20)
            more = b""
            if not chunk:
                break
            out.append(unpacker.decompress(chunk))
            if unpacker.eof:
                yield b"".join(out)
                more, unpacker, out = unpacker.unused_data, zlib.decompressobj(31), []


def parsed(raw: bytes) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of a record; its digests are checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    if hashlib.sha1(block).digest() != base64.b32decode(fields["WARC-Block-Digest"].removeprefix("sha1:")):
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} doesn't match")
    kind, length = fields["WARC-Type"], int(fields["X-Payload-Length"])
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if len(payload) != length or hashlib.sha1(payload).digest() != digest:
            raise ValueError(f"payload digest of {fields['WARC-Record-ID']} doesn't match")
    return page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI", ""), length, digest.hex(), kind, page_of(fields.get("WARC-Refers-To"))


def read_archive(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """Records of the files that the manifest in folder names. Files are dealt one by one, so a task holds one record at a time."""
    if manifest is None:
        names = [x["file"] for x in json.loads(get(f"{folder}/manifest.json"))["files"]]
        manifest = spark.createDataFrame([(x,) for x in names], "file string")
    files = manifest.select("file")
    files = files.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string())])
        fs, path = opened(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                for raw in members(fs, f"{path}/{name}"):
                    rows.append((*parsed(raw), name))
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.mapInArrow(read, RECORDS)


def archived(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes pages to a new archive in the shared folder and reads it back."""
    folder = scratch(pages.sparkSession, "warc")
    manifest = write_archive(pages, folder, least)
    return read_archive(pages.sparkSession, folder, manifest)
