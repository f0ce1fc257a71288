"""Mixture-controlled packing of documents into sequences by deficit round robin.

Every source is a queue. In each round a queue is owed its target share of ``length``
tokens; it sends the whole tokens it is owed and carries the fraction, its deficit, to
the next round. The rounds laid end to end are the stream that is cut into sequences,
so every sequence has the target mixture to within a token or two per queue, and only
the last has fewer than ``length`` tokens. When a queue runs dry the shares are dealt
anew among the others: a new *phase*. With more than ``length`` / ``QUANTUM`` queues a round
is as many sequences long as give a queue ``QUANTUM`` tokens on average; the mixture holds
over that many sequences then.

What a queue has sent after r rounds of a phase is floor(share * length * r), so the
place of any token follows from its number in its queue alone, and no round has to wait
for another. A queue's tokens are numbered over all input partitions: each task counts
its own, and running sums over the tasks' totals give where it begins, which is how
deficits pass from partition to partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytescan import buffers, lean, pieces
from .common import only, table, written
from .transducer import VOCABULARY, compiled

LENGTH, END, MAX_QUEUES, QUANTUM = 2048, 1, 1 << 14, 64
#: Shares are multiples of 1/DEN, so that products with any round's number fit 64 bits.
DEN = 1 << 28
BROADCAST_ROWS, ROUND_CELLS = 1_000_000, 1 << 19


@dataclass
class Phase:
    base: int  # the stream's tokens before this phase
    rounds: int
    sent: np.ndarray  # each queue's tokens before this phase
    left: np.ndarray  # and those it may still send
    whole: np.ndarray  # share * round * DEN = whole * DEN + part
    part: np.ndarray

    def owed(self, r: np.ndarray) -> np.ndarray:
        """Tokens that each queue (columns) has sent after each of r rounds (rows)."""
        r = r[:, None]
        return np.minimum(self.whole * r + self.part * r // DEN, self.left)


def shares(weights: list[Fraction]) -> list[int]:
    """Multiples of 1/DEN that sum to DEN, by largest remainder."""
    total = sum(weights)
    exact = [w * DEN / total for w in weights]
    low = [int(x) for x in exact]
    order = sorted(range(len(exact)), key=lambda k: (low[k] - exact[k], k))
    for k in order[: DEN - sum(low)]:
        low[k] += 1
    return low


def schedule(totals: list[int], targets: list[Fraction] | None, length: int) -> list[Phase]:
    """The phases for queues of the given sizes and rounds of ``length`` tokens; there are no
    more than queues, plus one."""
    left, base, sent, out = list(totals), 0, [0] * len(totals), []
    while any(left):
        weights = [(targets[k] if targets else Fraction(totals[k])) if left[k] else Fraction(0) for k in range(len(left))]
        if not any(weights):
            weights = [Fraction(x) for x in left]
        share = shares(weights)
        if not any(share[k] for k in range(len(left)) if left[k]):
            raise ValueError("no queue with tokens has a share")
        rounds = min(-(-left[k] * DEN // (share[k] * length)) for k in range(len(left)) if left[k] and share[k])
        phase = Phase(base, rounds, np.array(sent, np.int64), np.array(left, np.int64), np.array([s * length // DEN for s in share], np.int64), np.array([s * length % DEN for s in share], np.int64))
        out.append(phase)
        got = phase.owed(np.array([rounds], np.int64))[0].tolist()
        base += sum(got)
        sent = [a + b for a, b in zip(sent, got, strict=True)]
        left = [a - b for a, b in zip(left, got, strict=True)]
    return out


def edges_after(total: int, length: int) -> list[int]:
    """Where sequences begin after the last full one: the rest of the stream in powers of two."""
    at, rest, out = total - total % length, total % length, []
    while rest:
        size = 1 << (rest.bit_length() - 1)
        out.append(at)
        at, rest = at + size, rest - size
    return out


def placed(phases: list[Phase], queue: int, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts a stretch of a queue (given by sorted positions, first to last) at its rounds:
    the beginnings of all pieces in the queue, and their places in the stream."""
    starts, places = [], []
    for p in phases:
        lo, hi = int(p.sent[queue]), int(p.sent[queue] + min(p.left[queue], p.owed(np.array([p.rounds]))[0, queue]))
        a, b = max(lo, int(cuts[0])) - lo, min(hi, int(cuts[-1])) - lo
        if a >= b:
            continue
        share = int(p.whole[queue]) * DEN + int(p.part[queue])
        first, last = -(-(a + 1) * DEN // share) - 1, -(-b * DEN // share) - 1
        step = max(1, ROUND_CELLS // len(p.sent))  # bounded, however long the stretch and however many queues
        for r0 in range(first, last + 1, step):
            r = np.arange(r0, min(last + 1, r0 + step) + 1, dtype=np.int64)
            owed = p.owed(r)
            mine = owed[:, queue]
            begin = np.maximum(mine[:-1], a)
            end = np.minimum(mine[1:], b)
            inner = cuts[(cuts - lo > begin[0]) & (cuts - lo < end[-1])] - lo
            at = np.union1d(begin[begin < end], inner)
            row = np.searchsorted(mine, at, "right") - 1
            before = p.base + owed.sum(1)[row] + (owed[row + 1, :queue] - owed[row, :queue]).sum(1)
            starts.append(at + lo)
            places.append(before + at - mine[row])
    return (np.concatenate(starts), np.concatenate(places)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _tokenised(names: dict, buckets: int, vocabulary: str, end: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, block = compiled(vocabulary), TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        last = np.array([end], automaton.kind).tobytes()
        for part in pieces(batches, "t"):
            flat, edge = automaton.tokens(*buffers(part["t"]))
            queues, starts, sizes, blobs = [], [], [], []
            for source, hashed, a, b in zip(part["source"].to_pylist(), part["hash"].to_pylist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                queue = hashed % buckets if buckets else names[source]
                queues.append(queue)
                starts.append(seen.get(queue, 0))
                sizes.append(b - a + 1)
                seen[queue] = starts[-1] + sizes[-1]
                blobs.append(flat[a:b].tobytes() + last)
            yield pa.record_batch([part["id"], pa.array(queues, pa.int32()), pa.array([block] * len(queues), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], names=["id", "queue", "block", "start", "n", "ids"])

    return scan


def _cut(phases: list[Phase], total: int, length: int, narrow: bool):
    tail = edges_after(total, length)
    full = total // length

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield from cut(batch.slice(at, 512))

    def cut(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        queues = part["queue"].to_numpy()
        begins = part["begin"].to_numpy()
        sizes = part["n"].to_numpy()
        rows, starts, seqs, offsets, lengths = [], [], [], [], []
        for q in np.unique(queues).tolist():
            mine = np.flatnonzero(queues == q)
            mine = mine[np.argsort(begins[mine], kind="stable")]
            lo, hi = begins[mine], begins[mine] + sizes[mine]
            breaks = np.flatnonzero(lo[1:] != hi[:-1]) + 1  # a stretch is a run of documents without a gap
            for run in np.split(np.arange(len(mine)), breaks):
                cuts = np.append(lo[run], hi[run[-1]])
                begin, place = placed(phases, q, cuts)
                # Sequences' edges are the last cuts: between two of them a piece can cross many only in the tail.
                end = np.append(begin[1:], cuts[-1])
                size = end - begin
                first, final = place // length, (place + size - 1) // length
                cross = (first != final) | (final >= full)
                pieces = [np.stack([begin[~cross], place[~cross], size[~cross]], 1)]
                for b, g, n in zip(begin[cross].tolist(), place[cross].tolist(), size[cross].tolist(), strict=True):
                    marks = [x for x in (*range((g // length + 1) * length, min(g + n, full * length + 1), length), *tail) if g < x < g + n]
                    bounds = [g, *sorted(set(marks)), g + n]
                    pieces.append(np.array([[b + x - g, x, y - x] for x, y in zip(bounds[:-1], bounds[1:], strict=True)], np.int64))
                b, g, n = np.concatenate(pieces).T
                if tail:
                    k = np.searchsorted(np.array(tail), g, "right")
                    seq = np.where(g < full * length, g // length, full + k - 1)
                    off = np.where(g < full * length, g % length, g - np.array(tail)[np.maximum(k - 1, 0)])
                else:
                    seq, off = g // length, g % length
                owner = run[np.searchsorted(lo[run], b, "right") - 1]
                rows.append(mine[owner])
                starts.append(b - lo[owner])
                seqs.append(seq)
                offsets.append(off)
                lengths.append(n)
        row, start, size = np.concatenate(rows), np.concatenate(starts), np.concatenate(lengths)
        order = np.lexsort((start, row))
        row, start, size = row[order], start[order], size[order]
        wide = [np.frombuffer(x.as_buffer(), "<u2").astype("<u4").tobytes() if narrow else x.as_py() for x in part["ids"]]
        ids = [wide[r][4 * s : 4 * (s + n)] for r, s, n in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
        step = 1 << 16
        owners = part["id"].take(pa.array(row))
        seq, off = np.concatenate(seqs)[order], np.concatenate(offsets)[order]
        for k in range(0, len(ids), step):
            cut = slice(k, k + step)
            yield pa.record_batch([owners[cut], pa.array(start[cut], pa.int64()), pa.array(size[cut], pa.int64()), pa.array(sizes[row[cut]], pa.int64()), pa.array(seq[cut], pa.int64()), pa.array(off[cut], pa.int64()), pa.array(ids[cut], pa.binary())], names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return scan


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    targets: dict | None = None,
    length: int = LENGTH,
    vocabulary: str = VOCABULARY,
    end: int = END,
    max_queues: int = MAX_QUEUES,
) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids
    (little-endian uint32).

    A document is its token ids and then ``end``; a null or empty text is ``end`` alone.
    ``targets`` gives each source's weight (others and zeros are served last); without
    it the targets are the sources' own shares of all tokens. A null source is a queue of
    its own. Beyond ``max_queues`` sources, sources share queues by hash and ``targets``
    isn't possible. The rest of the stream, under ``length`` tokens, becomes sequences
    whose lengths are powers of two, so nothing is padded. Rows with null or repeated
    ids are packed each; other columns are not read; an empty table has no pieces.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = only(docs, id=id_col, t=text_col, source=source_col).select("id", F.col("t").cast("string").alias("t"), F.col("source").cast("string").alias("source"))
    found = [r.source for r in rows.select("source").distinct().limit(max_queues + 1).collect()]
    buckets = max_queues if len(found) > max_queues else 0
    if buckets and targets:
        raise ValueError(f"targets need no more than {max_queues} sources")
    order = sorted(found, key=lambda x: (x is None, x))
    names = {} if buckets else {s: k for k, s in enumerate(order)}
    tokens = written(
        rows.select("id", "t", "source", F.pmod(F.xxhash64("source"), F.lit(1 << 31)).alias("hash")).mapInArrow(lean(_tokenised(names, buckets, vocabulary, end)), f"id {id_type}, queue int, block int, start long, n long, ids binary"),
        "tokens",
    )
    # One row for each task and queue, which is all that running sums are needed of.
    totals = written(tokens.groupBy("queue", "block").agg(F.sum("n").alias("n")), "queue-totals")
    sizes = {r.queue: r.n for r in totals.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    n_queues = buckets or len(order)
    weights = [Fraction(str(targets.get(s, 0))) for s in order] if targets else None
    per_queue = [sizes.get(k, 0) for k in range(n_queues)]
    phases = schedule(per_queue, weights, length * max(1, -(-QUANTUM * n_queues // length)))
    before = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("queue", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if totals.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    numbered = tokens.join(bases, ["queue", "block"]).select("id", "queue", (F.col("base") + F.col("start")).alias("begin"), "n", "ids")
    pieces = numbered.mapInArrow(lean(_cut(phases, sum(per_queue), length, compiled(vocabulary).narrow)), f"id {id_type}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    return pieces.withColumnRenamed("id", "doc_id")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences; a group holds one sequence and no more."""
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.expr("aggregate(p.ids, cast('' as binary), (a, x) -> a || x)").alias("ids"))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return digest(pack(table(spark, sf_dir, "documents")))
