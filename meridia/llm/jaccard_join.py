"""Exact Jaccard join of word-shingle sets by partitioning the universe of tokens.

A set's tokens are hashed into the segments of its size band. Two sets that differ in
no more than U tokens differ in no more than U segments, so among the first U + 1
segments that are not empty (in a fixed order) there is one that both share, and those
U + 1 are all that a set has to index: the segment subset. The bound on U follows from
the sizes, and a set also indexes for the next bands that its larger partners can be
in. Bands for which that would leave too many chance candidates use segments of twice
the size and index each with its one-deletion neighbourhood instead: of U // 2 + 1 such
segments one differs in a single token at most. ``allocation`` weighs the two by the
number of keys and the chance candidates among the band's sets. A set whose tokens fall
into too few segments for the argument indexes a prefix of its tokens besides; only two
such sets can miss each other otherwise.

Candidates are never listed pair by pair. Sets with a key form a group, and every set is
first compared with one member of its groups; the links contract to components. Of
what is left, each group gives a forest of the pairs across components that sizes and
parity bitmaps (whose Hamming distance never exceeds the symmetric difference) permit.
The forests' components are families: any two sets that could still link are in one.
A family's sets are compared on their tokens, and only links that join components are
given out, so every stage makes rows in proportion to those it reads. Groups and
families beyond ``TILE`` tokens are compared by pairs of blocks, one tile at a time.
What the components need is complete then; links inside a component aren't listed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import buffers, lean, mix, pieces, shingle_hashes
from .common import only, parallelism, release, table, written
from .graph import components

WIDTH, PERCENT = 5, 80
FLUSH_KEYS, SALTS = 300_000, 64
#: Bytes of keys in a bucket, and tokens in a block of a group that is compared by tiles.
BUCKET, TILE = 32 << 20, 1 << 20


def band_edges(limit: int = 1 << 31) -> list[int]:
    """Sizes at which bands begin, a quarter apart."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return out


EDGES = np.array(band_edges(), np.int64)


def difference(a: int, b: int, percent: int) -> int:
    """The most tokens in which sets of sizes a and b with that Jaccard similarity differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def segments(band: int, percent: int, deletion: bool) -> int:
    """How many segments the band has: one more than the bound needs, and some for chance."""
    top = int(EDGES[band + 1]) - 1
    need = difference(top, top, percent) + 1
    if deletion:
        return (need - 1) // 2 + 1
    return need + math.ceil(0.012 * need + 4 * math.sqrt(0.012 * need))


def allocation(counts: dict[int, int], percent: int = PERCENT, shared: float = 0.1, family: float = 0.05) -> dict[int, bool]:
    """For each band with sets whether it uses one-deletion neighbourhoods.

    Cost: a unit for each key, and a tenth for each chance candidate. Chance candidates:
    pairs among the ``family`` share of a band's sets that have ``shared`` of their tokens
    in common (a passage that many texts share), whose segments then agree by chance.
    """
    out = {}
    for band, n in counts.items():
        size = float(EDGES[band])
        pairs = (n * family) ** 2 / 2
        costs = []
        for deletion in (False, True):
            m = segments(band, percent, deletion)
            per = 2 * size / m / (1 + shared)  # tokens of either set in a segment
            apart = per * (1 - shared)
            agree = math.exp(-apart) * (1 + apart if deletion else 1) - math.exp(-per)
            keys = n * m * (1 + size / m if deletion else 1)
            costs.append(keys + 0.1 * pairs * min(1.0, m * max(0.0, agree)))
        out[band] = costs[1] < costs[0]
    return out


def key_bytes(counts: dict[int, int], percent: int, deletions: dict[int, bool]) -> int:
    """About what the keys of all sets take, 14 bytes for each of two bands' worth."""
    out = 0.0
    for band, n in counts.items():
        m = segments(band, percent, deletions[band])
        out += 28 * n * m * (1 + float(EDGES[band]) / m if deletions[band] else 1)
    return int(out)


def band_of(size: int) -> int:
    return int(np.searchsorted(EDGES, size, "right")) - 1


def index_keys(tokens: np.ndarray, percent: int, deletions: dict[int, bool]) -> np.ndarray:
    """All keys of a set (sorted distinct 64-bit tokens)."""
    size = len(tokens)
    if not size:
        return np.zeros(0, np.uint64)
    most = size * 100 // percent
    out, poor = [], False
    for band in range(band_of(size), band_of(most) + 1):
        top = min(int(EDGES[band + 1]) - 1, most)
        need = difference(size, top, percent) + 1
        deletion = deletions.get(band, False)
        m = segments(band, percent, deletion)
        salt = np.uint64((band * 2 + deletion) * 0x9E3779B97F4A7C15 % 2**64)
        spread = mix(tokens ^ salt)
        at = ((spread >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        weight = mix(spread)
        order = np.argsort(at, kind="stable")
        where, first, held = np.unique(at[order], return_index=True, return_counts=True)
        sums = np.add.reduceat(weight[order], first)
        if not deletion:
            out.append(mix(sums[:need] + salt + where[:need].astype(np.uint64)))
            poor |= len(where) < need
        else:
            need = (need - 1) // 2 + 1
            out.append(mix(sums + salt + where.astype(np.uint64)))
            own = np.repeat(np.arange(len(where)), held)
            more = held[own] > 1
            out.append(mix(sums[own[more]] - weight[order][more] + salt + where[own[more]].astype(np.uint64)))
            poor |= int((held > 1).sum()) < need
    if poor:
        out.append(mix(tokens[: size - -(-size * percent // 100) + 1] ^ np.uint64(0x5851F42D4C957F2D)))
    return np.unique(np.concatenate(out))


def parity(tokens: np.ndarray, each: int = 2) -> bytes:
    """Bitmap of the parities of the tokens' low bits, about ``each`` bits for each token."""
    bits = max(6, (each * len(tokens) - 1).bit_length() if len(tokens) else 6)
    return np.packbits(np.bincount((tokens & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits) & 1, bitorder="little").tobytes()


def folded(raw: np.ndarray, n: int) -> np.ndarray:
    """The bitmap halved (by xor) to n bytes."""
    return np.bitwise_xor.reduce(raw.reshape(-1, n), 0) if len(raw) > n else raw


def apart(a: bytes, b: bytes) -> int:
    """A lower bound on the symmetric difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    n = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, n) ^ folded(y, n)).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    at = np.minimum(b.searchsorted(a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    return shingle_hashes(*buffers(batch.column(batch.schema.get_field_index("t"))), width)


def _signatures(width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            n, cls, bits = [], [], []
            for tokens in _sets(batch, width):
                n.append(len(tokens))
                cls.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                bits.append(parity(tokens))
            yield pa.record_batch([batch["id"], pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(bits, pa.binary())], names=["id", "n", "cls", "bits"])

    return scan


def _key_blobs(width: int, percent: int, deletions: dict[int, bool], buckets: int, flush: int):
    """(bucket, blob): keys (6 bytes) and ids (8 bytes) of many sets, column by column.
    A set that the task has met before is not indexed again."""

    def blobs(keys: list, ids: list) -> pa.RecordBatch:
        key, owner = np.concatenate(keys), np.repeat(np.array(ids, np.int64), [len(k) for k in keys])
        bucket = ((key >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        key, owner, bucket = key[order], owner[order], bucket[order]
        at, first = np.unique(bucket, return_index=True)
        edges = [*first.tolist(), len(key)]
        cut = [key[i:j].view(np.uint8).reshape(-1, 8)[:, :6].tobytes() + owner[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]
        return pa.record_batch({"bucket": pa.array(at, pa.int64()), "blob": pa.array(cut, pa.binary())})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, keys, ids, held = set(), [], [], 0
        for batch in pieces(batches, "t"):
            for i, tokens in zip(batch["id"].to_pylist(), _sets(batch, width), strict=True):
                own = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                if i is None or not len(tokens) or own in met:
                    continue
                met.add(own)
                keys.append(index_keys(tokens, percent, deletions))
                ids.append(i)
                held += len(keys[-1])
                if held >= flush:
                    yield blobs(keys, ids)
                    keys, ids, held = [], [], 0
        if keys:
            yield blobs(keys, ids)

    return scan


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The groups of each bucket as (g, lead, id), one row for each member but the lead.
    Groups with the same members get the same number g, a hash of them, and come once."""

    def found(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        counts = [len(b) // 14 for b in blobs]
        key = np.zeros((sum(counts), 8), np.uint8)
        key[:, :6] = np.concatenate([np.frombuffer(b, np.uint8, 6 * n).reshape(-1, 6) for b, n in zip(blobs, counts, strict=True)])
        key = key.view(np.uint64).ravel()
        ids = np.concatenate([np.frombuffer(b, np.int64, n, 6 * n) for b, n in zip(blobs, counts, strict=True)])
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        fresh = np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]))
        key, ids = key[fresh], ids[fresh]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        held = np.diff(np.append(first, len(key)))
        many = held > 1
        first, held = first[many], held[many]
        if not len(first):
            return
        weight = mix(ids.astype(np.uint64))
        sums = np.append(np.uint64(0), np.cumsum(weight, dtype=np.uint64))
        group = mix(sums[first + held] - sums[first] + held.astype(np.uint64))
        group, where = np.unique(group, return_index=True)
        first, held = first[where], held[where]
        rows = np.repeat(first + 1 - np.append(0, np.cumsum(held - 1)[:-1]), held - 1) + np.arange(int((held - 1).sum()))
        out = [np.repeat(group.view(np.int64), held - 1), np.repeat(ids[first], held - 1), ids[rows]]
        for k in range(0, len(rows), 1 << 18):
            yield pa.record_batch([pa.array(x[k : k + (1 << 18)]) for x in out], names=["g", "lead", "id"])

    now, blobs = None, []
    for batch in batches:
        for bucket, blob in zip(batch["bucket"].to_pylist(), batch["blob"], strict=True):
            if bucket != now and blobs:
                yield from found(blobs)
                blobs = []
            now = bucket
            blobs.append(blob.as_py())
    if blobs:
        yield from found(blobs)


def _near(percent: int):
    """Keeps the pairs whose sizes and bitmaps permit a link, with the bound on their difference."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, far = [], []
            for k, (m, n, x, y) in enumerate(zip(batch["n_a"].to_pylist(), batch["n_b"].to_pylist(), batch["bits_a"].to_pylist(), batch["bits_b"].to_pylist(), strict=True)):
                if 100 * min(m, n) >= percent * max(m, n) and (d := apart(x, y)) <= difference(m, n, percent):
                    keep.append(k)
                    far.append(d)
            at = pa.array(keep, pa.int64())
            yield pa.record_batch([batch["a"].take(at), batch["b"].take(at), pa.array(far, pa.int64())], names=["a", "b", "far"])

    return scan


def _tiled(rows: DataFrame, by: str, most: int) -> DataFrame:
    """``rows`` (rep, n, ...) with their group's tile (lo, hi) and their own block in it.

    A group whose ``n`` (a small set counts for ``most`` / 4096) add up to ``most`` or less
    is one tile. A larger one is dealt over blocks by ``rep``, and each two blocks are a
    tile, so no task holds more than two.
    """
    blocks = rows.groupBy(by).agg(F.ceil(F.sum(F.greatest("n", F.lit(most // 4096))) / most).cast("int").alias("blocks")).filter("blocks > 1")
    dealt = rows.join(blocks, by, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("blocks", "other")
    return dealt


def _by_tile(rows: DataFrame, by: str) -> DataFrame:
    return rows.repartition(by, "lo", "hi").sortWithinPartitions(by, "lo", "hi")


def _runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """The rows of each tile, without the group's number."""
    now, rows = None, []
    for batch in batches:
        for key, row in zip(zip(*(batch[k].to_pylist() for k in (batch.schema.names[0], "lo", "hi")), strict=True), zip(*(batch[k].to_pylist() for k in columns), strict=True), strict=True):
            if key != now and rows:
                yield rows
                rows = []
            now = key
            rows.append(row)
    if rows:
        yield rows


def _joining(rows: list[tuple], bits: list[bytes], apart: np.ndarray, percent: int, test=None) -> list[tuple[int, int]]:
    """Pairs (of places in ``rows``: rep, own block, size; in order of size) that sizes,
    bitmaps and ``test`` permit, of different ``apart`` and not joined by earlier pairs:
    a forest, so no more than rows. Bitmaps grow with sizes, so equal widths are runs."""
    size, own = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    width = np.array([len(x) for x in bits])
    whole = own.min() == own.max()
    label = np.arange(len(rows)) if test is None else apart.copy()
    tables = {w: (int(np.searchsorted(width, w)), np.frombuffer(b"".join(bits[int(np.searchsorted(width, w)) : int(np.searchsorted(width, w, "right"))]), np.uint8).reshape(-1, w)) for w in np.unique(width).tolist()}
    out = []
    for k in range(len(rows) - 1):
        stop = int(np.searchsorted(size, size[k] * 100 // percent, "right"))
        good = (label[k + 1 : stop] != label[k]) & (apart[k + 1 : stop] != apart[k])
        if not whole:
            good &= own[k + 1 : stop] != own[k]
        other = np.flatnonzero(good) + k + 1
        low = int(width[k])
        mine = np.frombuffer(bits[k], np.uint8)
        for w in np.unique(width[other]).tolist():
            start, held = tables[w]
            some = other[width[other] == w]
            theirs = held[some - start]
            if w > low:
                theirs = np.bitwise_xor.reduce(theirs.reshape(len(some), -1, low), 1)
            far = np.bitwise_count(theirs ^ mine).sum(1)
            fine = far <= (size[k] + size[some]) * (100 - percent) // (100 + percent)
            for j in some[fine][np.argsort(far[fine], kind="stable")].tolist():
                if label[j] != label[k] and (test is None or test(k, j)):
                    out.append((k, j))
                    label[label == label[j]] = label[k]
    return out


def _candidates(percent: int):
    """A forest of the pairs, across components, that sizes and bitmaps permit in each tile."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("rep", "own", "n", "component", "bits")):
            rows = sorted({r[0]: r for r in rows}.values(), key=lambda r: r[2])
            if len({r[3] for r in rows}) > 1:
                made = _joining(rows, [r[4] for r in rows], np.array([r[3] for r in rows]), percent)
                yield pa.record_batch({"a": pa.array([rows[x][0] for x, _ in made], pa.int64()), "b": pa.array([rows[y][0] for _, y in made], pa.int64())})

    return scan


def _links(width: int, percent: int):
    """The links, verified on the sets, that join components within each tile of a family."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, ("rep", "own", "n", "component", "z")):
            rows = sorted({r[0]: r for r in rows}.values(), key=lambda r: r[2])
            if len({r[3] for r in rows}) < 2:
                continue
            sets = [_tokens(r[4], width) for r in rows]
            rows = [r[:4] for r in rows]
            made = _joining(rows, [parity(x, 16) for x in sets], np.unique([r[3] for r in rows], return_inverse=True)[1], percent, lambda x, y, sets=sets: linked(sets[x], sets[y], percent))
            yield pa.record_batch({"a": pa.array([rows[x][0] for x, _ in made], pa.int64()), "b": pa.array([rows[y][0] for _, y in made], pa.int64())})

    return scan


def _tokens(z: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)
    return next(shingle_hashes(raw, np.array([0, len(raw)]), width))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in pieces(batches, "t"):
        yield pa.record_batch([batch["id"], pa.array([pack.compress(x.as_buffer() if x.is_valid else b"") for x in batch["t"]], pa.binary())], names=["id", "z"])


def _verified(width: int, percent: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, own = [], None, None
            for k, (a, x, y) in enumerate(zip(batch["a"].to_pylist(), batch["z_a"], batch["z_b"], strict=True)):
                if a != last:
                    last, own = a, _tokens(x.as_py(), width)
                if linked(own, _tokens(y.as_py(), width), percent):
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.record_batch([batch["a"].take(at), batch["b"].take(at)], names=["a", "b"])

    return scan


def _verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    one = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("z").alias("z_a")), "a")
    two = one.join(texts.select(F.col("id").alias("b"), F.col("z").alias("z_b")), "b")
    return two.select("a", "b", "z_a", "z_b").mapInArrow(lean(_verified(width, percent)), "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Sets are the distinct ``width``-word shingles of the text with A-Z lower-cased; a
    shorter text is one shingle, and a text without words (or null) has none and links
    with nothing. Sets link when their Jaccard similarity is ``percent`` / 100 or more;
    component_id is the smallest id that links reach. Ids are integers; a row without
    one gets n_shingles and no component. Rows that repeat an id are one document for
    links, each with its own n_shingles. Other columns are not read; an empty table
    gives an empty result. Tokens stand for their 64-bit hashes.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    spark = docs.sparkSession
    rows = only(docs, id=id_col, t=text_col).select(F.col("id").cast("long").alias("id"), F.col("t").cast("string").alias("t"))
    sigs = written(rows.mapInArrow(lean(_signatures(width)), "id long, n long, cls binary, bits binary"), "signatures")
    full = sigs.filter("n > 0 and id is not null")
    edges = F.array(*(F.lit(int(x)) for x in EDGES[:60]))
    counts = {r.band: r.n for r in full.groupBy((F.size(F.filter(edges, lambda x: x <= F.col("n"))) - 1).alias("band")).agg(F.count(F.lit(1)).alias("n")).collect()}
    # Equal sets are one class; its smallest id stands for it.
    # The rows of a large class are dealt over its salts.
    salted = full.select("id", "cls", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    least = salted.groupBy("cls").agg(F.min("id").alias("rep"), F.collect_set("salt").alias("salts"))
    spread = least.select("cls", "rep", F.explode("salts").alias("salt"))
    member = written(salted.join(spread, ["cls", "salt"]).groupBy("id").agg(F.min("rep").alias("rep")), "classes")
    reps = written(full.join(least.select(F.col("rep").alias("id"), "cls"), ["id", "cls"], "left_semi").select("id", "n", "bits").dropDuplicates(["id"]), "class-signatures")

    # A task holds one bucket at a time, so their number follows the keys' bytes.
    plan = allocation(counts, percent)
    buckets = max(4 * parallelism(spark), key_bytes(counts, percent, plan) // BUCKET)
    blobs = rows.mapInArrow(lean(_key_blobs(width, percent, plan, buckets, FLUSH_KEYS)), "bucket long, blob binary")
    dealt = blobs.repartition(max(parallelism(spark), buckets // 4), "bucket").sortWithinPartitions("bucket")
    groups = written(dealt.mapInArrow(lean(_groups), "g long, lead long, id long"), "groups")
    release(spark)

    # Round 1: of each set's groups' leads, the nearest by bitmap.
    star = groups.select("lead", "id").distinct()
    named = star.join(member.select("id", F.col("rep").alias("b")), "id").join(member.select(F.col("id").alias("lead"), F.col("rep").alias("a")), "lead")
    ends = named.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sided = ends.join(reps.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "a").join(reps.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "b")
    near = written(sided.mapInArrow(lean(_near(percent)), "a long, b long, far long"), "near-pairs")
    # A group names any member of a class; its text is the representative's.
    taking = groups.select("id").union(groups.select("lead")).distinct().join(member, "id").select(F.col("rep").alias("id")).distinct()
    texts = written(rows.filter("id is not null").mapInArrow(lean(_packed), "id long, z binary").join(taking, "id", "left_semi").dropDuplicates(["id"]), "texts", "none")
    release(spark)
    best = near.groupBy("b").agg(F.min(F.struct("far", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    links = written(_verify(best, texts, width, percent), "links-1")
    first = written(components(links), "components-1")

    # Round 2: what else could link shares a group but no component. Candidates, joined up,
    # make families; a set is in one family, where it is compared on its tokens.
    home = written(member.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("id", "rep", F.coalesce("component", "rep").alias("component")), "homes")
    own = home.filter("id = rep").select("rep", "component")
    of = lambda side: own.select(F.col("rep").alias(side), F.col("component").alias(f"c_{side}"))
    rest = near.join(of("a"), "a").join(of("b"), "b").filter("c_a <> c_b").select("a", "b")
    # A group of two has but the pair compared before.
    large = groups.join(groups.groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("g"), "g", "left_semi")
    inside = large.select("g", "id").union(large.select("g", F.col("lead").alias("id"))).distinct().join(home, "id").select("g", "rep", "component")
    mixed = inside.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("g")
    sized, drawn = (reps.select(F.col("id").alias("rep"), k) for k in ("n", "bits"))
    crossing = _tiled(inside.join(mixed, "g", "left_semi").distinct().join(sized, "rep"), "g", TILE).join(drawn, "rep")
    forest = written(_by_tile(crossing.select("g", "lo", "hi", "rep", "own", "n", "component", "bits"), "g").mapInArrow(lean(_candidates(percent)), "a long, b long").union(rest).distinct(), "candidates")
    if not forest.isEmpty():
        family = components(forest).select(F.col("node").alias("rep"), F.col("component").alias("family"))
        facing = _tiled(family.join(own, "rep").join(sized, "rep"), "family", TILE).join(texts.withColumnRenamed("id", "rep"), "rep")
        found = written(_by_tile(facing.select("family", "lo", "hi", "rep", "own", "n", "component", "z"), "family").mapInArrow(lean(_links(width, percent)), "a long, b long"), "links-2")
        first = written(components(links.unionByName(found)), "components-2")
        home = member.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    out = sigs.select("id", "n").join(home.select("id", "component"), "id", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) END AS sh FROM w
), cls AS (SELECT sh, min(doc_id) AS rep FROM s WHERE len(sh) > 0 GROUP BY sh
), m AS (SELECT s.doc_id, cls.rep FROM s JOIN cls ON s.sh = cls.sh
), t AS (SELECT rep, unnest(sh) AS x, len(sh) AS n FROM cls
), p AS (
  SELECT a.rep AS a, b.rep AS b FROM t a JOIN t b ON a.x = b.x AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r AS (
  SELECT rep AS node, rep AS other FROM cls UNION SELECT r.node, p.b FROM r JOIN p ON r.other = p.a
), g AS (SELECT node, min(other) AS component FROM r GROUP BY node)
SELECT s.doc_id, len(s.sh) AS n_shingles, coalesce(g.component, s.doc_id) AS component_id
FROM s LEFT JOIN m USING (doc_id) LEFT JOIN g ON g.node = m.rep
"""
