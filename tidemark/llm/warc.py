"""WARC archives with a two-level capture index.

Records are gzip members of archive files in the shared folder. The index holds a line for each capture, sorted by
reversed-host key, in compressed blocks; behind the blocks of each index file stands its sparse directory, the first key
and place of each block. A lookup finds files by their key ranges, blocks by binary search in the directory, and then
reads the ranges of blocks and records only.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._shared import cut, new_path, partitions_for, remove, stage

DATE = "2024-01-01T00:00:00Z"  # records made from a table carry no capture time
FEW_REVISITS = 100_000  # rows of two numbers and a digest: 8 MB
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


@dataclass(frozen=True)
class Warc:
    """Equal payloads of min_bytes or more are stored once; archive files end after file_bytes; lines make an index block.
    The index has index_files files at most, so the list of their key ranges, which every search task gets, stays below 2 MB however much is archived."""

    min_bytes: int = 0
    index_files: int = 4096
    file_bytes: int = 256 << 20
    lines: int = 512
    level: int = 3


def open_folder(uri: str) -> tuple[pa.fs.FileSystem, str]:
    fs, path = pa.fs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    return fs, path


def member(raw: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response or, with refers_to, a revisit, whose HTTP header still tells the payload's length."""
    http = HTTP.format(len(payload)).encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    head += [f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda b: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in b.decode().split("\r\n")[1:])}
    warc = fields(head)
    body = rest[: int(warc["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def url_key(url: Column) -> Column:
    """Host labels reversed, then path and query: com,example,www)/path?query. Scheme, user, port and fragment don't count."""
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.$", "")
    rest = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    known = u.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://")
    return F.when(known, F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)).otherwise(u)


def with_revisits(pages: DataFrame, w: Warc) -> DataFrame:
    """page_id, url, html, refers_to. Of rows with equal payloads those of the largest page_id are responses; null page_ids are always."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    slim = rows.where(F.octet_length("html") >= w.min_bytes).select("page_id", digest.alias("digest"))
    last = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to")
    revisits = slim.join(last, "digest").where("page_id < refers_to").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to").distinct()
    revisits = cut(revisits)
    if revisits.count() <= FEW_REVISITS:  # then payloads needn't be shuffled
        revisits = F.broadcast(revisits)
    keyed = rows.withColumn("digest", digest)
    return keyed.join(revisits, (keyed["page_id"] == F.col("p")) & (keyed["digest"] == F.col("d")), "left").select("page_id", "url", "html", "refers_to")


def _write(folder: str, w: Warc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        name, out, at = "", None, 0
        try:
            for batch in batches:
                names, starts, sizes = [], [], []
                for page_id, url, html, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                    if out is None or at >= w.file_bytes:
                        if out is not None:
                            out.close()
                        # a retried task writes other files; only those of finished tasks are in the index
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    payload = html.as_py().encode()
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    url = (url.as_py() or "").replace("\r", "%0D").replace("\n", "%0A")
                    raw = member(record(page_id.as_py(), url, payload, digest, refers_to.as_py()), w.level)
                    out.write(raw)
                    names.append(name)
                    starts.append(at)
                    sizes.append(len(raw))
                    at += len(raw)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(names, pa.string()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
                    names=["page_id", "url", "file", "start", "size"],
                )
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str, w: Warc = Warc()) -> DataFrame:
    """Writes a record per row of pages into files in folder; (key, page_id, file, start, size) of each."""
    made = with_revisits(pages, w).mapInArrow(_write(folder, w), "page_id bigint, url string, file string, start bigint, size bigint")
    return stage(made.select(url_key(F.col("url")).alias("key"), "page_id", "file", "start", "size"), "captures")


def _index(folder: str, w: Warc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One file of this task's sorted lines, and one row that says where its directory stands and what keys it spans."""
        fs, path = open_folder(folder)
        name, out, at, directory, block, last = f"index-{uuid.uuid4().hex}.cdx", None, 0, [], [], ""

        def flush() -> None:
            nonlocal at, out
            if block:
                if out is None:
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                raw = zlib.compress("\n".join(json.dumps(x) for x in block).encode(), w.level)
                directory.append((block[0][0], at, len(raw)))
                out.write(raw)
                at += len(raw)
                block.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "file", "start", "size"))):
                block.append(row)
                last = row[0]
                if len(block) >= w.lines:
                    flush()
        flush()
        if out is not None:
            raw = zlib.compress(json.dumps(directory).encode(), w.level)
            out.write(raw)
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "low": directory[0][0], "high": last, "start": at, "size": len(raw)}], schema=pa.schema([("file", pa.string()), ("low", pa.string()), ("high", pa.string()), ("start", pa.int64()), ("size", pa.int64())]))

    return run


def build_index(captures: DataFrame, folder: str, w: Warc = Warc()) -> DataFrame:
    """Writes the captures' index into folder; (file, low, high, start, size): one row for each of its files."""
    n = min(partitions_for(captures, 8 << 20), w.index_files)
    tasks = captures.repartitionByRange(n, F.col("key"), F.col("page_id"), F.col("file"), F.col("start")).sortWithinPartitions("key", "page_id", "file", "start")
    return stage(tasks.mapInArrow(_index(folder, w), "file string, low string, high string, start bigint, size bigint"), "index")


def _route(files: list[tuple[str, str, str]]):
    """The index files whose key range holds a key, by binary search: files are sorted by range."""
    highs = [f[2] for f in files]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, to = [], []
            for key in batch.column("key").to_pylist():
                i = bisect.bisect_left(highs, key)
                while i < len(files) and files[i][1] <= key:
                    keys.append(key)
                    to.append(files[i][0])
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(to, pa.string())], names=["key", "index"])

    return run


def _search(folder: str, places: dict[str, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted keys by index file: each file's directory is read once, and a block once for neighbouring keys."""
        fs, path = open_folder(folder)
        name, source, directory, firsts, held, lines, keys = "", None, [], [], -1, [], []
        for batch in batches:
            found = []
            for key, index in zip(batch.column("key").to_pylist(), batch.column("index").to_pylist()):
                if index != name:
                    if source is not None:
                        source.close()
                    name, source, held = index, fs.open_input_file(f"{path}/{index}"), -1
                    start, size = places[index]
                    directory = json.loads(zlib.decompress(source.read_at(size, start)))
                    firsts = [d[0] for d in directory]
                k = max(0, bisect.bisect_left(firsts, key) - 1)  # captures of a key may begin in the block before
                while k < len(directory) and directory[k][0] <= key:
                    if k != held:
                        lines = [json.loads(x) for x in zlib.decompress(source.read_at(directory[k][2], directory[k][1])).split(b"\n")]
                        keys, held = [x[0] for x in lines], k
                    found += lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
                    k += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                names=["key", "page_id", "file", "start", "size"],
            )
        if source is not None:
            source.close()

    return run


def look_up(keys: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """Captures of distinct keys (key). What the driver reads and sends is one row for each index file, of which there are few (Warc.index_files)."""
    files = sorted((r.low, r.high, r.file, r.start, r.size) for r in index.collect())
    ranges = [(f, low, high) for low, high, f, _, _ in files]
    places = {f: (start, size) for _, _, f, start, size in files}
    routed = keys.mapInArrow(_route(ranges), "key string, index string")
    n = max(len(files), 1)
    tasks = routed.repartition(n, "index").sortWithinPartitions("index", "key")
    return tasks.mapInArrow(_search(folder, places), "key string, page_id bigint, file string, start bigint, size bigint")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_folder(folder)
        name, source = "", None
        number = lambda v: int(v[10:-1]) if v and v[10:-1] else None  # noqa: E731  <urn:page:..>
        for batch in batches:
            out = []
            for file, start, size in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "size"))):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, fs.open_input_file(f"{path}/{file}")
                warc, http, payload = parse(zlib.decompress(source.read_at(size, start), 31))
                digest = warc["warc-payload-digest"].removeprefix("sha1:")
                if warc["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{file} at {start}: the payload doesn't have its digest")
                out.append((number(warc["warc-record-id"]), warc["warc-target-uri"], int(http["content-length"]), digest, warc["warc-type"], number(warc.get("warc-refers-to", "")), payload))
            c = list(zip(*out)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(c, kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            )
        if source is not None:
            source.close()

    return run


READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_records(captures: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records at (file, start, size), read by ranges in order of place. A revisit's payload is empty."""
    n = partitions_for(captures, 4 << 20)
    tasks = captures.select("file", "start", "size").repartition(n, F.col("file"), (F.col("start") / (8 << 20)).cast("long")).sortWithinPartitions("file", "start")
    read = _read(folder)
    if payloads:
        return tasks.mapInArrow(read, READ + ", payload binary")

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read(batches):
            yield batch.drop_columns(["payload"])

    return tasks.mapInArrow(slim, READ)


def archive_and_read(pages: DataFrame, w: Warc = Warc(), payloads: bool = False, folder: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) to archives in folder (by default a new one in the shared folder), indexes them, looks every url up and reads its records back.

    One row per row of pages: page_id, url, payload_bytes, payload_digest, record_type, refers_to. A null html is an empty payload and a
    null url an empty one. Of equal payloads of min_bytes or more, rows of the largest page_id are responses (all of them, if it repeats)
    and the others revisits; rows with a null page_id are responses, to which none refers. Extra columns are ignored; no rows give no rows.
    """
    folder = folder or new_path(pages.sparkSession, "warc")
    captures = write_archives(pages, folder, w)
    index = build_index(captures, folder, w)
    found = look_up(captures.select("key").distinct(), index, folder)
    return read_records(found, folder, payloads)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as read back; the archives themselves are deleted once this table is written."""
    folder = new_path(spark, "warc")
    out = stage(archive_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder=folder).drop("url"), "records")
    remove(spark, folder)
    return out
