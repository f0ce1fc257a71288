"""Language identification by fusing evidence in a Bayesian way.

* Text: byte-trigram counts per language over all rows that declare one (hashed into
  ``BINS`` bins), scored as a multinomial whose overlapping trigrams count a third each.
* Declared language: how often rows whose text alone says one language declare each
  other one; a smoothed table of languages by declarations.
* Address: P(language | host), smoothed towards P(language | address suffix), which is
  smoothed towards P(language). All are grouped counts of what the text alone says.

The posterior is the normalised product. Rows whose text has no letters, whose best
language isn't accepted, or whose posterior stays under ``least`` are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import buffers, lean, pieces
from .common import small_batches, table, written

BINS, LEAST = 1 << 14, 0.5
STRENGTH = 20.0

_LETTER = np.full(256, 32, np.uint8)
for _a, _b, _d in ((65, 91, 32), (97, 123, 0), (128, 256, 0)):
    _LETTER[_a:_b] = np.arange(_a, _b) + _d


def trigrams(raw: np.ndarray, at: np.ndarray, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(bin, text number) of every trigram that begins with a letter or ends with one;
    what is no letter is a space, and a trigram stays within its text."""
    b = _LETTER[raw].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    good = np.flatnonzero(((b[:-2] != 32) | (b[2:] != 32)) & (text[:-2] == text[2:]))
    scrambled = gram[good] * np.uint32(2654435761)
    return (scrambled >> np.uint32(32 - bins.bit_length() + 1)).astype(np.int64), text[good]


def _counted(languages: list[str], bins: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: k for k, x in enumerate(languages)}
        total = np.zeros(len(languages) * bins, np.int64)
        for batch in pieces(batches, "t"):
            own = np.array([number.get(x, -1) for x in batch["declared"].to_pylist()], np.int64)
            gram, text = trigrams(*buffers(batch["t"]), bins)
            lang = own[text]
            total += np.bincount(lang[lang >= 0] * bins + gram[lang >= 0], minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.record_batch({"lang": pa.array(found // bins, pa.int64()), "bin": pa.array(found % bins, pa.int64()), "n": pa.array(total[found], pa.int64())})

    return scan


def _scored(model: np.ndarray, bins: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "t"):
            gram, text = trigrams(*buffers(batch["t"]), bins)
            n = batch.num_rows
            sums = np.stack([np.bincount(text, weights=row[gram], minlength=n) for row in model], 1) / 3
            raw, at = buffers(batch["t"])
            known = np.add.reduceat(np.append(_LETTER[raw] != 32, False).astype(np.int64), at[:-1]) * (np.diff(at) > 0)
            scores = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(model), pa.int32()), pa.array(sums.ravel()))
            yield pa.record_batch([batch["id"], batch["declared"], batch["host"], batch["suffix"], scores, pa.array(known, pa.int64())], names=["id", "declared", "host", "suffix", "scores", "n"])

    return scan


def _argmax(scores: Column) -> Column:
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def suffix_of(host: Column) -> Column:
    return F.nullif(F.regexp_extract(host, r"([^.]+)$", 1), F.lit(""))


def markup_language(html: Column) -> Column:
    """The primary subtag of the html element's lang attribute, or null."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?i)<html[^>]*\blang\s*=\s*["']?([a-z]{2,3})""", 1)), F.lit(""))


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: Column | str = "text",
    declared: Column | str | None = "lang",
    host: Column | str | None = "source",
    suffix: Column | str | None = None,
    accept: tuple[str, ...] | None = None,
    least: float = LEAST,
    bins: int = BINS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang (null if unknown), confidence, kept.

    ``declared``, ``host`` and ``suffix`` are columns or expressions; None or a null
    value is no evidence. Languages are all that any row declares, as they stand; the model
    grows with their number. Without any, rows with letters are kept as unknown. ``accept``
    limits which are kept (unknown is none of them). A null or letterless text is rejected with confidence 0.
    Repeated rows get the same verdict; ties go to the first language by name. Other
    columns are not read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    own = lambda x: F.lit(None).cast("string") if x is None else (F.col(f"`{x}`") if isinstance(x, str) else x).cast("string")
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), own(text).alias("t"), own(declared).alias("declared"), own(host).alias("host"), own(suffix).alias("suffix"))
    languages = sorted(r.declared for r in rows.filter("declared is not null").select("declared").distinct().collect())
    if not languages:
        lettered = F.coalesce(F.rlike("t", F.lit(r"[A-Za-z]|[^\x00-\x7F]")), F.lit(False)) & F.lit(accept is None)
        return rows.select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), lettered.alias("kept"))
    # The model is languages x bins numbers, however many rows there are.
    counts = np.full((len(languages), bins), 0.5)
    learned = rows.filter("declared is not null").mapInArrow(lean(_counted(languages, bins)), "lang long, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    np.add.at(counts, (learned["lang"].to_numpy(int), learned["bin"].to_numpy(int)), learned["n"].to_numpy(float))
    model = np.log(counts / counts.sum(1, keepdims=True))

    scored = written(rows.mapInArrow(lean(_scored(model, bins)), f"id {id_type}, declared string, host string, suffix string, scores array<double>, n long"), "language-scores")
    guess = scored.filter("n > 0").withColumn("guess", _argmax(F.col("scores")))
    # What rows of each guess declare: at most languages x languages counts.
    heard = guess.filter("declared is not null").groupBy("guess", "declared").agg(F.count(F.lit(1)).alias("n")).collect()
    place = {x: k for k, x in enumerate(languages)}
    says = np.full((len(languages), len(languages) + 1), 0.5)
    for r in heard:
        says[r.guess, place[r.declared]] += r.n
    says = np.log(says / says.sum(1, keepdims=True))
    table_of = docs.sparkSession.createDataFrame([(x, says[:, k].tolist()) for x, k in place.items()], "declared string, word array<double>")

    def counted(*by: str) -> DataFrame:
        each = guess.groupBy(*by, "guess").agg(F.count(F.lit(1)).alias("n"))
        return each.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("guess", F.col("n").cast("double")))).alias("c"), F.sum("n").cast("double").alias("whole"))

    overall = {r.guess: r.n for r in guess.groupBy("guess").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(overall.values())
    base = [(overall.get(k, 0) + 1) / (total + len(languages)) for k in range(len(languages))]
    numbers = F.sequence(F.lit(0), F.lit(len(languages) - 1))
    smoothed = lambda up: F.transform(numbers, lambda k: (F.coalesce(F.try_element_at("c", k), F.lit(0.0)) + STRENGTH * F.get(up, k)) / (F.col("whole") + STRENGTH))
    suffixes = counted("suffix").select("suffix", smoothed(F.array(*(F.lit(x) for x in base))).alias("up"))
    per_host = counted("host", "suffix")
    prior = F.transform(smoothed(F.col("up")), lambda p: F.log(p))
    hosts = per_host.join(suffixes, per_host["suffix"].eqNullSafe(suffixes["suffix"])).select("host", per_host["suffix"], prior.alias("prior"))
    joined = scored.join(hosts, scored["host"].eqNullSafe(hosts["host"]) & scored["suffix"].eqNullSafe(hosts["suffix"]), "left").select("id", "declared", "scores", "n", "prior")
    joined = joined.join(F.broadcast(table_of), "declared", "left")

    flat = F.array(*(F.lit(math.log(x)) for x in base))
    none = F.array_repeat(F.lit(0.0), len(languages))
    word = F.coalesce("word", none)
    fused = F.zip_with(F.zip_with("scores", F.coalesce("prior", flat), lambda a, b: a + b), word, lambda a, b: a + b)
    judged = joined.select("id", "n", fused.alias("p")).withColumn("top", F.array_max("p"))
    mass = F.aggregate("p", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    names = F.array(*(F.lit(x) for x in languages))
    out = judged.select("id", "n", F.when(F.col("n") > 0, names[_argmax(F.col("p"))]).alias("lang"), F.when(F.col("n") > 0, 1 / mass).otherwise(0.0).alias("confidence"))
    good = (F.col("n") > 0) & (F.col("confidence") >= least)
    if accept is not None:
        good = good & F.col("lang").isin(list(accept))
    return out.select(F.col("id").alias("doc_id"), "lang", "confidence", F.coalesce(good, F.lit(False)).alias("kept"))


def identify_pages(pages: DataFrame, **options) -> DataFrame:
    """``identify`` for web pages: markup language, host and address suffix from their own columns."""
    host = host_of(F.col("url"))
    shown = F.regexp_replace("html", r"(?is)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    return identify(pages, "page_id", shown, markup_language(F.col("html")), host, suffix_of(host), **options).withColumnRenamed("doc_id", "page_id")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def language_id_pages(spark, sf_dir: str) -> DataFrame:
    """The same operator over web pages, whose markup and addresses are evidence too."""
    return identify_pages(table(spark, sf_dir, "pages"))
