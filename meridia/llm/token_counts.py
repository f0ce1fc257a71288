"""Token counts by a compiled finite-state tokenizer.

``transducer`` compiles a tokenizer file: a splitter over characters, and a deterministic
transducer of the byte-pair merges whose transitions carry the counts of tokens emitted.

Texts of up to ``CHUNK`` bytes are read whole. A longer one is cut into chunks. Where a
chunk begins, its state is unknown, so a chunk is read as a *state map*: up to its first
reset (a position that no pre-token and no special string spans, whatever came before)
it keeps the characters, since what they emit depends on the state that comes in; after
its last reset it keeps the characters that name the state it leaves; between the two it
has a plain number. Two maps compose into one of the same kind, and composition is
associative, so the maps of a text are composed by pairs, round after round: the up-sweep
of a parallel prefix scan, whose root is the text's count. A row is never divided among
tasks, so the rounds are one task's work. A chunk without a reset stays characters only:
the longest run without white space, not the text, bounds what a map holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import buffers, lean, pieces
from .common import only, table
from .transducer import VOCABULARY, Words, compiled

CHUNK, LIMIT = 1 << 16, 2048

#: A place between two ASCII characters of which the first is white space and the second
#: is not: pre-tokens hold no white space, and normalisation moves nothing across it.
RESET = regex.compile(r"(?<=[\x20\x09-\x0D])(?=[!-~])")
StateMap = tuple[str, int, str | None]


def state_map(chunk: str, automaton: Words) -> StateMap:
    """(head, emitted, tail) of a chunk; tail None: no reset, and all of it is head."""
    first = RESET.search(chunk)
    if first is None:
        return chunk, 0, None
    at = max(chunk.rfind(x) for x in (" ", "\n", "\t", "\r", "\v", "\f"))
    last = first.start()
    while at > last:  # from the end back to the last reset
        if RESET.match(chunk, at + 1):
            last = at + 1
            break
        at = max(chunk.rfind(x, 0, at) for x in (" ", "\n", "\t", "\r", "\v", "\f"))
    return chunk[: first.start()], automaton.count(chunk[first.start() : last]), chunk[last:]


def composed(left: StateMap, right: StateMap, automaton: Words) -> StateMap:
    """The map of reading left, then right. What lies between the last reset of one and
    the first of the other is read as soon as both are known. A reset on the seam
    itself needs no care: joining characters over it changes nothing."""
    if left[2] is None:
        return left[0] + right[0], right[1], right[2]
    if right[2] is None:
        return left[0], left[1], left[2] + right[0]
    return left[0], left[1] + automaton.count(left[2] + right[0]) + right[1], right[2]


def closed(whole: StateMap, automaton: Words) -> int:
    head, emitted, tail = whole
    return automaton.count(head) + emitted + (automaton.count(tail) if tail else 0)


def chunks(text: str, size: int) -> list[str]:
    return [text[k : k + size] for k in range(0, len(text), size)] or [""]


def scanned(maps: list[StateMap], automaton: Words) -> StateMap:
    """The composition of all maps by pairing neighbours, round after round."""
    while len(maps) > 1:
        maps = [composed(*pair, automaton) if len(pair) == 2 else pair[0] for pair in (maps[k : k + 2] for k in range(0, len(maps), 2))]
    return maps[0]


def text_count(text: str, automaton: Words, chunk: int = CHUNK) -> int:
    return closed(scanned([state_map(c, automaton) for c in chunks(text, chunk)], automaton), automaton)


def _count(name: str, chunk: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(name)
        for batch in pieces(batches, "t"):
            raw, at = buffers(batch["t"])
            sizes = np.diff(at)
            long = np.flatnonzero(sizes > chunk)
            if len(long):
                counts = np.zeros(len(sizes), np.int64)
                for t in range(len(sizes)):
                    own = raw[at[t] : at[t + 1]]
                    counts[t] = text_count(own.tobytes().decode(), automaton, chunk) if sizes[t] > chunk else automaton.counts(own, np.array([0, len(own)]))[0]
            else:
                counts = automaton.counts(raw, at)
            yield pa.record_batch({"id": batch["id"], "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})

    return scan


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, chunk: int = CHUNK, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty and has no tokens; a null id stays null; repeated rows
    are counted each; other columns are not read; an empty table gives an empty result.
    No special tokens are added; their strings inside texts are read as the library
    reads them by default. Nothing is shuffled.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = only(docs, id=id_col, t=text_col).select("id", F.col("t").cast("string").alias("t"))
    out = rows.mapInArrow(lean(_count(vocabulary, chunk)), f"id {id_type}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))

