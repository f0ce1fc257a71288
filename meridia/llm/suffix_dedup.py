"""Removal of repeated byte strings by bucket-pointer refinement.

Every string of ``SPAN`` bytes (a window) has an anchor, the least of its ``GRAM``-byte
grams in a fixed scrambled order, so equal windows have equal anchors at equal places.
The anchors of all texts are dealt into buckets by their gram; the windows of an anchor
form one stretch of text, its context.

* A bucket settles most anchors by hashes: a context that a smaller document has too is
  removed whole, and one of whose gram, with the 17 bytes before or after it, no smaller
  document knows stays.
* What is left, contexts that overlap others in part, goes through the refinement: the
  buckets of all 8-byte strings are refined to 16 bytes by sorting on bucket pointers (of
  a position and of the one 8 further), these to 32 and these to 50, each level reading
  the pointers as the levels before have updated them. Positions alone in their bucket
  are not sorted again. What shares a last bucket is equal, byte for byte.

A task combines equal contexts before they leave it: only the smallest document's goes
on. Just one context of every kind is refined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import buffers, lean, mix, pieces, prefix_hash, span_hash
from .common import dropped, only, parallelism, release, table, written

SPAN, GRAM = 50, 16
SIDE = (SPAN - GRAM) // 2
FLUSH, BUCKET = 2_000_000, 32 << 20
PLACE = np.uint64((1 << 32) - 1)  # a string of Arrow is shorter
#: Bytes kept of a gram's hash, beside those that its bucket tells; grams that agree by
#: chance are compared with each other, no more.
KEY = 5


def anchors(raw: np.ndarray, at: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(place, first, last, text) of every anchor: its gram's place, the first and last
    start of its windows, and the number of its text. In order of places."""
    n, width = len(raw), span - gram + 1
    none = np.zeros(0, np.int64)
    if n < span:
        return none, none, none, none
    sums = prefix_hash(raw)
    starts = np.arange(n - gram + 1)
    hashes = span_hash(sums, starts, starts + gram)
    # Ties go to the leftmost. The order of grams must not depend on what else is read at once.
    least = (hashes & ~PLACE) | starts.astype(np.uint64)
    done = 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < width:
        least = np.minimum(least[: len(least) - (width - done)], least[width - done :])
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + span <= at[1:][text])
    place, text = (least[start] & PLACE).astype(np.int64), text[start]
    fresh = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1]))) if len(start) else none
    stop = np.append(fresh[1:], len(start)) - 1 if len(start) else none
    return place[fresh], start[fresh], start[stop], text[fresh]


def _sides(raw: np.ndarray, sums: np.ndarray, at: np.ndarray, place: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit hashes of the gram with the ``SIDE`` bytes before it, and after it."""
    lo = np.maximum(place - SIDE, at[text])
    hi = np.minimum(place + GRAM + SIDE, at[text + 1])
    return (span_hash(sums, lo, place + GRAM) >> np.uint64(40)).astype(np.uint16), (span_hash(sums, place, hi) >> np.uint64(40)).astype(np.uint16)


ENTRY = np.dtype([("key", "<u8"), ("whole", "<u8"), ("left", "<u2"), ("right", "<u2"), ("doc", "<i8"), ("row", "<i8"), ("number", "<u4"), ("use", "u1")])


def _squeezed(e: np.ndarray) -> bytes:
    """Columns end to end, in order of documents and numbers, of which only the steps are
    kept: they are small, so the shuffle's compression shortens them. ``row`` is left out
    where it is 0 throughout."""
    e = e[np.lexsort((e["number"], e["doc"]))]
    key = np.ascontiguousarray(e["key"]).view(np.uint8).reshape(-1, 8)[:, :KEY]
    doc, number = (np.diff(e[k].astype(np.int64), prepend=0) for k in ("doc", "number"))
    repeats = bool(e["row"].any())
    first = int(e["doc"][0]) if len(e) else 0
    doc[:1] = 0
    small, short = (bool(x.min(initial=0) > -(1 << bits) and x.max(initial=0) < 1 << bits) for x, bits in ((doc, 31), (number, 15)))
    parts = [np.array([len(e), small, short, repeats, first], "<i8"), key, e["whole"], e["left"], e["right"], doc.astype("<i4" if small else "<i8"), number.astype("<i2" if short else "<i8"), e["use"]]
    return b"".join(np.ascontiguousarray(p).tobytes() for p in (*parts, *([e["row"]] if repeats else [])))


def _spread(blob: bytes) -> np.ndarray:
    n, small, short, repeats, first = np.frombuffer(blob, "<i8", 5).tolist()
    out, pos = np.zeros(n, ENTRY), 40
    key = np.zeros((n, 8), np.uint8)
    key[:, :KEY] = np.frombuffer(blob, np.uint8, KEY * n, pos).reshape(-1, KEY)
    out["key"], pos = key.view("<u8").ravel(), pos + KEY * n
    for name, kind in (("whole", "<u8"), ("left", "<u2"), ("right", "<u2"), ("doc", "<i4" if small else "<i8"), ("number", "<i2" if short else "<i8"), ("use", "u1"), *([("row", "<i8")] if repeats else [])):
        column = np.frombuffer(blob, kind, n, pos)
        pos += column.nbytes
        out[name] = first + np.cumsum(column, dtype=np.int64) if name == "doc" else np.cumsum(column, dtype=np.int64) if name == "number" else column
    return out


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins, in sorted columns."""
    change = np.zeros(len(columns[0]), bool)
    if len(change):
        change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _least(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row the least value of its run."""
    return np.repeat(np.minimum.reduceat(values, first), np.diff(np.append(first, len(values)))) if len(values) else values


def _row(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What tells apart the rows of one id: a hash of the text."""
    return span_hash(prefix_hash(raw), at[:-1], at[1:]).view(np.int64)


def _deal(buckets: int, flush: int, repeats: bool):
    """Rows (bucket, blob) of entries; with ``repeats`` an entry knows its row by more than the id."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def dealt() -> pa.RecordBatch:
            e = np.concatenate(held)
            e = e[np.lexsort((e["doc"], e["whole"], e["key"]))]
            first = _firsts(e["key"], e["whole"], e["left"], e["right"])
            repeat = e["doc"] > _least(first, e["doc"])
            gone, e = e[repeat], e[~repeat]
            bucket = ((e["key"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            e, bucket = e[order], bucket[order]
            at, first = np.unique(bucket, return_index=True)
            edges = [*first.tolist(), len(e)]
            blobs = [_squeezed(e[i:j]) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            rows = at.tolist()
            if len(gone):
                # Settled already: they pass through any bucket with a mark of their own.
                gone["use"] |= 128
                rows.append(int(gone["doc"][0]) % buckets)
                blobs.append(_squeezed(gone))
            return pa.record_batch({"bucket": pa.array(rows, pa.int64()), "blob": pa.array(blobs, pa.binary())})

        for batch in pieces(batches, "t"):
            ids = np.array([-1 if x is None else x for x in batch["id"].to_pylist()], np.int64)
            known = np.array([x is not None for x in batch["id"].to_pylist()], bool)
            raw, at = buffers(batch.column(batch.schema.get_field_index("t")))
            place, lo, hi, text = anchors(raw, at)
            if not len(place):
                continue
            sums = prefix_hash(raw)
            e = np.zeros(len(place), ENTRY)
            e["key"] = mix(span_hash(sums, place, place + GRAM))
            e["whole"] = span_hash(sums, lo, hi + SPAN)  # all 64 bits: kinds around one hot passage differ by it alone
            e["left"], e["right"] = _sides(raw, sums, at, place, text)
            e["doc"] = ids[text]
            if repeats:
                e["row"] = _row(raw, at)[text]
            e["number"] = np.arange(len(text)) - np.searchsorted(text, text)
            # Whether windows need the bytes before (1) and after (2) the gram.
            e["use"] = (place - lo >= SIDE) * 1 + (place - hi <= SIDE) * 2
            held.append(e[known[text]])
            n += len(held[-1])
            if n >= flush:
                yield dealt()
                held, n = [], 0
        if n:
            yield dealt()

    return scan


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, row, number, g): contexts to remove whole (g null), and contexts to refine in group g."""

    def settled(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        e = np.concatenate([_spread(b) for b in blobs])
        gone, e = e[e["use"] >= 128], e[e["use"] < 128]
        e = e[np.lexsort((e["doc"], e["right"], e["left"], e["whole"], e["key"]))]
        same = _firsts(e["key"], e["whole"], e["left"], e["right"])
        repeat = e["doc"] > _least(same, e["doc"])
        gone, e = np.concatenate([gone, e[repeat]]), e[~repeat]
        # Of each kind of context the smallest document's is left. It needs a look if a
        # smaller document, or another kind that looks itself, shares one of its sides.
        doubt = np.zeros(len(e), bool)
        for side, bit in (("left", 1), ("right", 2)):
            order = np.lexsort((e["doc"], e[side], e["key"]))
            s = e[order]
            first = _firsts(s["key"], s[side])
            least = _least(first, s["doc"])
            size = np.diff(np.append(first, len(s)))
            differs = _least(first, -s["doc"].astype(np.int64)) != -least  # more than one document
            needs = np.logical_or.reduceat((s["use"] & bit > 0) & (s["doc"] > least), first) if len(first) else np.zeros(0, bool)
            doubt[order] |= differs & np.repeat(needs, size)
        ask = e[doubt]
        docs, rows, numbers = (np.concatenate([gone[k], ask[k]]).astype(np.int64) for k in ("doc", "row", "number"))
        group = pa.array([None] * len(gone), pa.int64()) if not len(ask) else pa.concat_arrays([pa.nulls(len(gone), pa.int64()), pa.array(ask["key"].view(np.int64))])
        for k in range(0, len(docs), 1 << 18):
            cut = slice(k, k + (1 << 18))
            yield pa.record_batch([pa.array(docs[cut]), pa.array(rows[cut]), pa.array(numbers[cut]), group[cut]], names=["doc", "row", "number", "g"])

    now, blobs = None, []
    for batch in batches:
        for bucket, blob in zip(batch["bucket"].to_pylist(), batch["blob"], strict=True):
            if bucket != now and blobs:
                yield from settled(blobs)
                blobs = []
            now = bucket
            blobs.append(blob.as_py())
    if blobs:
        yield from settled(blobs)


def _packed(repeats: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches, "t"):
            raw, at = buffers(batch["t"])
            row = _row(raw, at) if repeats else np.zeros(batch.num_rows, np.int64)
            packed = [pack.compress(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([batch["id"], pa.array(row), pa.array(packed, pa.binary())], names=["id", "row", "z"])

    return scan


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text a row (id, row, z, spans) with the stretches to remove so far, and rows
    (id, row, g, lo, context) of what is to be refined."""
    unpack = zstandard.ZstdDecompressor()
    empty = np.zeros(0, "<i8").tobytes()
    for batch in batches:
        rows: list[tuple] = []
        for i, own, z, numbers, asked in zip(batch["id"].to_pylist(), batch["row"].to_pylist(), batch["z"], batch["numbers"].to_pylist(), batch["asked"].to_pylist(), strict=True):
            spans, z = empty, z.as_py()
            if numbers or asked:
                raw = np.frombuffer(unpack.decompress(z), np.uint8)
                _, lo, hi, _ = anchors(raw, np.array([0, len(raw)]))
                whole = np.array(numbers or [], np.int64)
                spans = np.stack([lo[whole], hi[whole] + SPAN], 1).astype("<i8").tobytes()
                whole_text = raw.tobytes()
                for ask in asked or []:
                    k = ask["number"]
                    rows.append((i, own, None, None, ask["g"], int(lo[k]), whole_text[lo[k] : hi[k] + SPAN]))
            rows.append((i, own, z, spans, None, None, None))
            if len(rows) > 5000:
                yield _rows(rows)
                rows = []
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"id": pa.int64(), "row": pa.int64(), "z": pa.binary(), "spans": pa.binary(), "g": pa.int64(), "lo": pa.int64(), "context": pa.binary()}
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))


def refined(raw: np.ndarray, position: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Bucket-pointer refinement: of the given positions those whose ``span`` bytes (32 to 64)
    occur at another one too, with the number of their bucket.

    A level sorts only the positions that share a bucket with others, by their pointers and
    the pointers one depth further, and writes the new pointers in place: the next level
    reads them at its own, later offset. A position alone in its bucket keeps its pointer
    from then on, and is never sorted again.
    """
    wide = np.lib.stride_tricks.sliding_window_view(np.append(raw, np.zeros(8, np.uint8)), 8)
    gram = np.ascontiguousarray(wide).view("<u8").ravel()
    pointer, size = np.unique(gram, return_inverse=True, return_counts=True)[1:]
    pointer, shared = pointer.astype(np.int64), size[pointer] > 1
    top, depth = len(size), 8
    while depth < span:
        step = min(depth, span - depth)
        # The last level is asked of the given positions only; others' pointers serve as offsets.
        live = np.flatnonzero(shared) if depth + step < span else position[shared[position]]
        pair = pointer[live] * (top + len(live) + 1) + pointer[np.minimum(live + step, len(pointer) - 1)]
        fresh, size = np.unique(pair, return_inverse=True, return_counts=True)[1:]
        shared = np.zeros(len(pointer), bool)
        shared[live] = size[fresh] > 1
        pointer[live] = top + fresh
        top += len(size)
        depth += step
    alive = position[shared[position]]
    return alive, pointer[alive]


def _refine(limit: int):
    """(id, row, start, stop) to remove, from contexts that arrive by groups (whole groups at a time)."""

    def found(ids: list, own: list, los: list, contexts: list) -> pa.RecordBatch:
        raw = np.frombuffer(b"".join(contexts), np.uint8)
        size = np.array([len(c) for c in contexts], np.int64)
        begin = np.append(0, np.cumsum(size))[:-1]
        windows = size - SPAN + 1
        owner = np.repeat(np.arange(len(size)), windows)
        position = begin[owner] + np.arange(len(owner)) - np.repeat(np.append(0, np.cumsum(windows))[:-1], windows)
        kept, bucket = refined(raw, position)
        owner = np.searchsorted(begin, kept, "right") - 1
        doc = np.array(ids, np.int64)[owner]
        order = np.lexsort((doc, bucket))
        first = _firsts(bucket[order])
        later = np.zeros(len(order), bool)
        later[order] = doc[order] > _least(first, doc[order])
        kept, owner = kept[later], owner[later]
        start = np.array(los, np.int64)[owner] + kept - begin[owner]
        run = np.flatnonzero(np.append(True, (np.diff(start) != 1) | (np.diff(owner) != 0))) if len(start) else np.zeros(0, np.int64)
        stop = (start[np.append(run[1:], len(start)) - 1] if len(start) else start) + SPAN
        return pa.record_batch([pa.array(np.array(ids, np.int64)[owner[run]]), pa.array(np.array(own, np.int64)[owner[run]]), pa.array(start[run]), pa.array(stop)], names=["id", "row", "start", "stop"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids, own, los, contexts = None, 0, [], [], [], []
        for batch in batches:
            for g, i, row, lo, c in zip(*(batch[k].to_pylist() for k in ("g", "id", "row", "lo", "context")), strict=True):
                if g != now and held > limit:
                    yield found(ids, own, los, contexts)
                    held, ids, own, los, contexts = 0, [], [], [], []
                now = g
                held += len(c)
                ids.append(i)
                own.append(row)
                los.append(lo)
                contexts.append(c)
        if ids:
            yield found(ids, own, los, contexts)

    return scan


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept", "sha")}
        for z, spans, more in zip(batch["z"], batch["spans"], batch["more"].to_pylist(), strict=True):
            raw = unpack.decompress(z.as_py())
            cut = np.frombuffer(spans.as_py(), "<i8").reshape(-1, 2)
            if more:
                cut = np.concatenate([cut, np.array([(m["start"], m["stop"]) for m in more], np.int64)])
            kept, n_spans = raw, 0
            if len(cut):
                depth = np.zeros(len(raw) + 1, np.int64)
                np.add.at(depth, cut[:, 0], 1)
                np.add.at(depth, cut[:, 1], -1)
                gone = np.cumsum(depth[:-1]) > 0
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            for k, v in zip(out, (len(raw), len(raw) - len(kept), n_spans, kept, hashlib.sha256(kept).hexdigest()), strict=True):
                out[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        yield pa.record_batch([batch["id"], *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=["id", *out])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (the bytes
    left, which may split a character), kept_sha256.

    Texts are UTF-8 bytes, a null text is empty. Every byte goes that is in a string of
    50 bytes which also starts in a row with a smaller id, judged on the input as it is.
    Ids are integers; rows that repeat an id, whether their texts are equal or not, remove
    nothing from each other, and each has its own result. A row without an id neither
    removes nor loses anything. Other columns are not read; an empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    rows = only(docs, id=id_col, t=text_col).select(F.col("id").cast("long").alias("id"), F.col("t").cast("string").alias("t"))
    repeats = not rows.filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    # An anchor comes every 18 bytes or so and takes 24; a task holds one bucket at a time.
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    tasks = parallelism(spark)
    buckets = max(4 * tasks, n_bytes * 4 // 3 // BUCKET)
    dealt = rows.mapInArrow(lean(_deal(buckets, FLUSH, repeats)), "bucket long, blob binary").repartition(max(tasks, buckets // 4), "bucket").sortWithinPartitions("bucket")
    settled = written(dealt.mapInArrow(lean(_settle), "doc long, row long, number long, g long"), "settled")
    release(spark)
    # A row's verdicts are no more than its anchors.
    verdicts = settled.groupBy(F.col("doc"), F.col("row").alias("own")).agg(F.collect_set(F.when(F.col("g").isNull(), F.col("number"))).alias("numbers"), F.collect_set(F.when(F.col("g").isNotNull(), F.struct("number", "g"))).alias("asked"))
    packed = rows.mapInArrow(lean(_packed(repeats)), "id long, row long, z binary")
    joined = packed.join(verdicts, (F.col("id") == F.col("doc")) & (F.col("row") == F.col("own")), "left").select("id", "row", "z", "numbers", "asked")
    located = written(joined.mapInArrow(lean(_located), "id long, row long, z binary, spans binary, g long, lo long, context binary"), "located")
    dropped(settled)
    release(spark)
    asked = located.filter("g is not null").select("g", "id", "row", "lo", "context").repartition(tasks, "g").sortWithinPartitions("g")
    cuts = written(asked.mapInArrow(lean(_refine(1 << 20)), "id long, row long, start long, stop long").distinct(), "refined")
    more = cuts.groupBy(F.col("id").alias("doc"), F.col("row").alias("own")).agg(F.collect_list(F.struct("start", "stop")).alias("more"))
    whole = located.filter("z is not null").select("id", "row", "z", "spans").join(more, (F.col("id") == F.col("doc")) & (F.col("row") == F.col("own")), "left").select("id", "z", "spans", "more")
    out = whole.mapInArrow(lean(_removed), "id long, n_bytes long, n_removed long, n_spans long, kept binary, sha string")
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", F.col("sha").alias("kept_sha256"))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), b AS (SELECT doc_id, h, length(h) // 2 AS n FROM d
), w AS (SELECT doc_id, unnest(range(n - 49)) AS i, h FROM b WHERE n >= 50
), v AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS g FROM w
), f AS (SELECT g, min(doc_id) AS lead FROM v GROUP BY g
), c AS (SELECT v.doc_id, v.i FROM v JOIN f USING (g) WHERE f.lead < v.doc_id
), o AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50 AS reach FROM c
), s AS (SELECT doc_id, i, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM o
), r AS (SELECT doc_id, k, min(i) AS lo, max(i) + 50 AS hi FROM s GROUP BY doc_id, k
), p AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS prior FROM r
), q AS (
  SELECT p.doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last,
         string_agg(substr(b.h, 2 * prior + 1, 2 * (lo - prior)), '' ORDER BY lo) AS kept
  FROM p JOIN b USING (doc_id) GROUP BY p.doc_id)
SELECT b.doc_id, b.n AS n_bytes, coalesce(q.n_removed, 0) AS n_removed, coalesce(q.n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN q.doc_id IS NULL THEN b.h ELSE q.kept || substr(b.h, 2 * q.last + 1) END)) AS kept_sha256
FROM b LEFT JOIN q USING (doc_id)
"""
