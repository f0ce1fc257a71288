"""WARC archives with a two-level capture index.

Writing: every page becomes one gzip member of a ``.warc.gz`` file; of equal payloads
the smallest id is a response and the others are revisits of it. Tasks write files of
their own in the shared folder, named by task attempt, so a repeated task leaves only
files that no index entry names.

Index: captures sorted by reversed-host URL key, cut into zstd-compressed blocks. Each
shard (a range of keys) has a sparse directory, the first key of each of its blocks.
A lookup finds the shard by binary search over the shards' first keys, the block by
binary search over that shard's directory, the capture by binary search in the block,
and reads just the capture's range of bytes. Only the shards' first keys (one for each
index partition) are ever held in one place.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, only, parallelism, table, written

LEAST_REVISIT, BLOCK, FILE_BYTES = 100, 256, 256 << 20
SHARD_BLOCKS, READ_BYTES = 4096, 16 << 20
INDEX = "key string, page_id long, file string, offset long, length long"


def surt(url: str | None) -> str:
    """The URL with its host's labels reversed, as in ``com,example,www)/path?query``."""
    try:
        parts = urlsplit(url or "")
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url or ""
    if not host:
        return url or ""
    at = ",".join(reversed(host.split(".")))
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        at += f":{port}"
    return f"{at}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit carries the response's HTTP head and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = "".join(c for c in url or "" if c >= " ")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """page_id, url, record_type, refers_to, digest, n_bytes and payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: None if x is None or (y := x[len("<urn:page:") : -1]) == "None" else int(y)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    whole = fields["WARC-Type"] == "response"
    if whole and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "digest": digest, "n_bytes": size, "payload": payload if whole else None}


def _archive(folder: str, file_bytes: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        stem, out, name, at, n_files = f"{task.partitionId():06d}-{task.taskAttemptId()}", None, "", 0, 0
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("key", "page_id", "file", "offset", "length")}
            for page_id, url, html, digest, refers_to in zip(*(batch[k] for k in ("id", "url", "html", "digest", "refers_to")), strict=True):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = squeeze.compress(record(page_id.as_py(), url.as_py(), payload, digest.as_py(), refers_to.as_py())) + squeeze.flush()
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    name, at, n_files = f"{stem}-{n_files:04d}.warc.gz", 0, n_files + 1
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                out.write(member)
                for k, v in zip(rows, (surt(url.as_py()), page_id.as_py(), name, at, len(member)), strict=True):
                    rows[k].append(v)
                at += len(member)
            yield pa.record_batch([pa.array(rows["key"], pa.string()), pa.array(rows["page_id"], pa.int64()), pa.array(rows["file"], pa.string()), pa.array(rows["offset"], pa.int64()), pa.array(rows["length"], pa.int64())], names=list(rows))
        if out is not None:
            out.close()

    return scan


def _blocks(block: int):
    """Cuts a sorted partition into blocks: (shard, block, first, n, data)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, rows = TaskContext.get().partitionId(), 0, []
        pack = zstandard.ZstdCompressor(level=3)

        def made(rows: list) -> pa.RecordBatch:
            data = pack.compress("\n".join(json.dumps(r, ensure_ascii=False) for r in rows).encode())
            return pa.record_batch({"shard": pa.array([shard], pa.int32()), "block": pa.array([number], pa.int32()), "first": pa.array([rows[0][0]], pa.string()), "n": pa.array([len(rows)], pa.int32()), "data": pa.array([data], pa.binary())})

        for batch in batches:
            rows += [list(r.values()) for r in batch.to_pylist()]
            while len(rows) >= block:
                yield made(rows[:block])
                rows, number = rows[block:], number + 1
        if rows:
            yield made(rows)

    return scan


def block_rows(data: bytes) -> list[list]:
    return [json.loads(x) for x in zstandard.ZstdDecompressor().decompress(data).decode().split("\n")]


@dataclass
class Archive:
    folder: str
    blocks: DataFrame  # shard, block, first, n, data
    directory: DataFrame  # shard, firsts: the sparse directory, one row for each shard
    n_bytes: int  # of all captures


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = LEAST_REVISIT, block: int = BLOCK, file_bytes: int = FILE_BYTES) -> Archive:
    """Archives every row of ``pages`` and builds the index.

    A null html counts as empty, a null url as the empty URL. Rows without an id are
    archived as responses. Rows that repeat an id are one capture each, whatever their
    payloads; of equal payloads the first id's rows are all responses. Other columns are
    not read.
    """
    spark = pages.sparkSession
    rows = only(pages, id=id_col, url=url_col, html=html_col).select(F.col("id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    # Digests only are grouped, and combine before the shuffle, however many copies there are.
    # A capture is known by id and digest: rows that repeat an id may differ in payload.
    firsts = rows.filter((F.octet_length("html") >= least_revisit) & F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    revisits = rows.filter(F.octet_length("html") >= least_revisit).select("id", "digest").join(firsts, "digest").filter("id > first").select("id", "digest", F.col("first").alias("refers_to")).distinct()
    joined = rows.join(revisits, ["id", "digest"], "left")
    folder = fresh_path(spark, "warc")
    captures = written(joined.select("id", "url", "html", "digest", "refers_to").mapInArrow(_archive(folder, file_bytes), INDEX), "warc-captures")
    n_rows, n_bytes = captures.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    # As many as there are tasks for, unless a directory would grow beyond SHARD_BLOCKS keys.
    shards = max(min(parallelism(spark), n_rows // (4 * block) + 1), n_rows // (SHARD_BLOCKS * block) + 1)
    # The id and offset break ties, so a hot URL is dealt over several shards.
    ordered = captures.repartitionByRange(shards, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    blocks = written(ordered.mapInArrow(_blocks(block), "shard int, block int, first string, n int, data binary"), "warc-blocks")
    directory = blocks.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("block", "first"))).alias("d")).select("shard", F.col("d.first").alias("firsts"))
    return Archive(folder, blocks, directory, n_bytes)


def _route(edges: list[str]):
    """All (shard) numbers whose range of keys can hold the key: equal keys may span shards."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers = [], []
            for url in batch["url"].to_pylist():
                key = surt(url)
                for s in range(max(0, bisect.bisect_left(edges, key) - 1), bisect.bisect_right(edges, key)):
                    keys.append(key)
                    numbers.append(s)
            yield pa.record_batch({"key": pa.array(keys, pa.string()), "at": pa.array(numbers, pa.int32())})

    return scan


def _block_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by shard, its directory first: (shard, block, key) for each key's blocks."""
    now, firsts = None, []
    for batch in batches:
        keys, shards, numbers = [], [], []
        for shard, key, own in zip(*(batch[k].to_pylist() for k in ("shard", "key", "firsts")), strict=True):
            if own is not None:
                now, firsts = shard, own
            elif shard == now:
                for b in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
                    keys.append(key)
                    shards.append(shard)
                    numbers.append(b)
        yield pa.record_batch({"key": pa.array(keys, pa.string()), "shard": pa.array(shards, pa.int32()), "block": pa.array(numbers, pa.int32())})


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by block, its data first: the captures of each key that follows."""
    now, rows, keys = None, [], []
    for batch in batches:
        found = []
        for shard, block, key, data in zip(batch["shard"].to_pylist(), batch["block"].to_pylist(), batch["key"].to_pylist(), batch["data"], strict=True):
            if data.is_valid:
                now, rows, keys = (shard, block), data.as_py(), None
            elif (shard, block) == now:
                if keys is None:  # a block that no key asks for stays packed
                    rows = block_rows(rows)
                    keys = [r[0] for r in rows]
                found += rows[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
        cols = list(zip(*found, strict=True)) or [[]] * 5
        yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["key", "page_id", "file", "offset", "length"])


def _read(folder: str, payloads: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            out = []
            for want, offset, length in zip(batch["file"].to_pylist(), batch["offset"].to_pylist(), batch["length"].to_pylist(), strict=True):
                if want != name:
                    if file is not None:
                        file.close()
                    name, file = want, store.open_input_file(f"{root}/{want}")
                out.append(parsed(zlib.decompress(file.read_at(length, offset), 31)))
            kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "digest": pa.string(), "n_bytes": pa.int64()} | ({"payload": pa.binary()} if payloads else {})
            yield pa.record_batch({k: pa.array([x[k] for x in out], t) for k, t in kinds.items()})
        if file is not None:
            file.close()

    return scan


def lookup(archive: Archive, urls: DataFrame, url_col: str = "url", payloads: bool = True) -> DataFrame:
    """The captures of the given URLs, read from the archives: page_id, url, record_type,
    refers_to, digest, n_bytes and, if asked for, payload (null for a revisit).

    URLs that were never captured have no row; a null URL means the empty one; a URL
    given twice is looked up once. URLs that share a key share their captures.
    """
    spark = urls.sparkSession
    edges = sorted((r.first, r.shard) for r in archive.directory.select(F.element_at("firsts", 1).alias("first"), "shard").collect())
    order = spark.createDataFrame([(i, s) for i, (_, s) in enumerate(edges)], "at int, shard int") if edges else spark.createDataFrame([], "at int, shard int")
    keys = only(urls, url=url_col).mapInArrow(_route([x for x, _ in edges]), "key string, at int").distinct()
    # A directory, and a block, comes to its keys once: they meet in sorted partitions.
    none = F.lit(None).cast
    wanted = keys.join(F.broadcast(order), "at").select("shard", F.lit(1).alias("turn"), "key", none("array<string>").alias("firsts"))
    first = archive.directory.select("shard", F.lit(0).alias("turn"), none("string").alias("key"), "firsts")
    tasks = parallelism(spark)
    located = first.unionByName(wanted).repartition(tasks, "shard").sortWithinPartitions("shard", "turn").select("shard", "key", "firsts").mapInArrow(_block_of, "key string, shard int, block int")
    asked = located.select("shard", "block", F.lit(1).alias("turn"), "key", none("binary").alias("data"))
    blocks = archive.blocks.select("shard", "block", F.lit(0).alias("turn"), none("string").alias("key"), "data")
    met = blocks.unionByName(asked).repartition(tasks, "shard", "block").sortWithinPartitions("shard", "block", "turn")
    captures = met.select("shard", "block", "key", "data").mapInArrow(_captures, INDEX)
    # Ranges of READ_BYTES of a file are read by one task, in order.
    ordered = captures.withColumn("stretch", F.floor(F.col("offset") / READ_BYTES)).repartition(max(tasks, archive.n_bytes // (4 * READ_BYTES)), "file", "stretch").sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, record_type string, refers_to long, digest string, n_bytes long" + (", payload binary" if payloads else "")
    return ordered.select("file", "offset", "length").mapInArrow(_read(archive.folder, payloads), schema)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = lookup(write_archive(pages), pages, payloads=False)
    return found.select("page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS lead FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, payload_bytes, payload_digest,
       CASE WHEN lead < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN lead < p.page_id THEN lead END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
