"""Line deduplication over levelled sorted runs of line hashes.

``LineRuns`` keeps, for every line key seen so far, a 128-bit hash with the number of
documents that hold it and the largest id among them. Runs are dealt into buckets by
hash and sorted in each, so two runs meet bucket by bucket without a shuffle.

* Each batch of documents is merge-anti-joined to the runs there are. What no run has
  becomes a run of its own, so a key is in one run only; what some run has already goes
  to the updates, which hold just keys that more than one batch has.
* Runs are compacted periodically: ``fan`` runs of a level are merged into one run of the
  next, so n batches leave O(fan * log n) runs and a key is rewritten O(log n) times.

The keys to drop follow from the runs and the updates: a key that only one batch had is
never looked at again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import lean
from .common import fresh_path, only, remove, table, written

SPACES = b" \t\n\x0b\x0c\r"
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Keys of a batch in a bucket of a run; Spark has no more buckets than MOST_BUCKETS.
BUCKET_KEYS, MOST_BUCKETS = 1 << 20, 100_000


def line_key(line: bytes, least: int = LEAST_CHARS) -> bytes | None:
    """Hash of the stripped, A-Z lower-cased line; None when it has under ``least`` code points."""
    key = line.strip(SPACES).lower()
    if len(key) < least or (not key.isascii() and len(key.decode("utf-8", "replace")) < least):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def _keys(least: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = [], []
            for i, text in zip(batch["id"].to_pylist(), batch["t"], strict=True):
                own = {line_key(x, least) for x in (text.as_buffer().to_pybytes() if text.is_valid else b"").split(b"\n")} - {None}
                ids += [i] * len(own)
                hashes += own
                if len(ids) > 100_000:
                    yield pa.record_batch({"h": pa.array(hashes, pa.binary()), "id": pa.array(ids, pa.int64())})
                    ids, hashes = [], []
            yield pa.record_batch({"h": pa.array(hashes, pa.binary()), "id": pa.array(ids, pa.int64())})

    return scan


class LineRuns:
    """levels[i] lists level i's runs, and ``updates`` the batches' known keys: (table, path) each."""

    def __init__(self, spark, buckets: int = 8, fan: int = 2):
        self.spark, self.buckets, self.fan = spark, buckets, fan
        self.levels: list[list[tuple[str, str]]] = []
        self.updates: list[tuple[str, str]] = []

    def runs(self) -> list[DataFrame]:
        return [self._read(x) for level in self.levels for x in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows (h, n, keep) of a batch whose keys no run has: the merge-anti-join."""
        for run in self.runs():
            batch = batch.join(run.select("h").hint("merge"), "h", "left_anti")
        return batch

    def add(self, keys: DataFrame) -> None:
        """Takes a batch's (h, id), once for each document and key."""
        grouped = keys.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep"))
        batch = self._put(grouped.repartition(self.buckets, "h"), "line-batch")
        if self.levels:
            fresh = self._put(self.unseen(self._read(batch)), "line-run")
            known = self._read(batch).join(self._read(fresh).select("h").hint("merge"), "h", "left_anti")
            self.updates.append(self._put(known, "line-update"))
            self._drop(batch)
        else:
            fresh = batch
        self._level(fresh, 0)

    def _level(self, run: tuple[str, str], level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(full := self.levels[level]) >= self.fan:
            self.levels[level] = []
            self._level(self._put(self._merged(full), "line-run"), level + 1)
            for old in full:
                self._drop(old)

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        """Sorted runs as one; a key of several has its numbers added up."""
        out = self._read(runs[0])
        for run in runs[1:]:
            other = self._read(run).toDF("h", "m", "last").hint("merge")
            out = out.join(other, "h", "full").select("h", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), F.greatest("keep", "last").alias("keep"))
        return out

    def repeated(self, least_docs: int = LEAST_DOCS) -> DataFrame:
        """(h, keep) of the keys in ``least_docs`` documents or more."""
        found = None
        more = self._merged(self.updates).toDF("h", "m", "last") if self.updates else None
        for run in self.runs():
            if more is not None:
                run = run.join(more.hint("merge"), "h", "left").select("h", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), F.greatest("keep", "last").alias("keep"))
            run = run.filter(F.col("n") >= least_docs).select("h", "keep")
            found = run if found is None else found.unionByName(run)
        return self.spark.createDataFrame([], "h binary, keep long") if found is None else found

    def close(self) -> None:
        for run in [x for level in self.levels for x in level] + self.updates:
            self._drop(run)
        self.levels, self.updates = [], []

    def _put(self, rows: DataFrame, name: str) -> tuple[str, str]:
        path, table_name = fresh_path(self.spark, name), f"meridia_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(self.buckets, "h").sortBy("h").saveAsTable(table_name)
        return table_name, path

    def _read(self, run: tuple[str, str]) -> DataFrame:
        return self.spark.table(run[0])

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE {run[0]}")
        remove(self.spark, run[1])


def line_keys(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(h, id), once for each row of (id, t) and key."""
    return docs.mapInArrow(lean(_keys(least)), "h binary, id long")


def _batch(docs: DataFrame, n: int) -> Column:
    """Which of ``n`` ranges of ids of about equal size an id is in; a row without one is in the first."""
    cuts = sorted(set(docs.select(F.col("id").cast("double").alias("id")).approxQuantile("id", [k / n for k in range(1, n)], 0.01))) if n > 1 else []
    number = F.lit(0)
    for cut in cuts:
        number = number + F.coalesce((F.col("id") >= cut).cast("int"), F.lit(0))
    return number


def _rewrite(least: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, sha, kept_text = [], [], [], []
            for text, drop in zip(batch["t"], batch["drops"], strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                lines = raw.split(b"\n")
                gone = set(drop.as_py()) if drop.is_valid else ()
                kept = [x for x in lines if line_key(x, least) not in gone] if gone else lines
                whole = b"\n".join(kept) if gone else raw
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
                sha.append(hashlib.sha256(whole).hexdigest())
                kept_text.append(whole)
            yield pa.record_batch({"id": batch["id"], "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept": pa.array(kept_text, pa.binary()).cast(pa.string()), "sha": pa.array(sha, pa.string())})

    return scan


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
    batches: int = 4,
    fan: int = 2,
) -> DataFrame:
    r"""One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_text, kept_sha256.

    Texts are split at \n (null or empty: one empty line). Keys of ``least_chars`` code
    points or more that ``least_docs`` rows hold lose their lines in every document but
    the one with the largest id. Rows that repeat an id count as documents of their
    own and are treated alike. Rows without an id count as holders; their repeated
    lines all go, as a null is never the largest id, unless no holder has one: then
    the lines stay. Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = only(docs, id=id_col, t=text_col).select(F.col("id").cast("long").alias("id"), F.col("t").cast("string").alias("t"))
    path = fresh_path(spark, "line-keys")
    line_keys(rows, least_chars).withColumn("batch", _batch(rows, batches)).write.option("compression", "zstd").partitionBy("batch").parquet(path)
    keys = spark.read.schema("h binary, id long, batch int").parquet(path)
    sizes = {r.batch: r.n for r in keys.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = LineRuns(spark, min(MOST_BUCKETS, 1 + max(sizes.values(), default=0) // BUCKET_KEYS), fan)
    for batch in sorted(sizes):
        runs.add(keys.filter(F.col("batch") == batch).select("h", "id"))
    repeated = written(runs.repeated(least_docs).filter("keep is not null"), "repeated-lines")
    runs.close()
    # The keys of a document meet the repeated keys; a hot key is a skewed join, which
    # is split at run time, and the other side has one row for each key.
    gone = keys.join(repeated, "h").filter(~F.col("id").eqNullSafe(F.col("keep")))
    drops = gone.groupBy("id").agg(F.collect_set("h").alias("drops"))
    joined = rows.join(drops, rows["id"].eqNullSafe(drops["id"]), "left").select(rows["id"], "t", "drops")
    out = joined.mapInArrow(lean(_rewrite(least_chars)), "id long, n_lines long, n_dropped long, kept string, sha string")
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.col("kept").alias("kept_text"), F.col("sha").alias("kept_sha256"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d
), k AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND r.keep <> k.doc_id AS gone FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
