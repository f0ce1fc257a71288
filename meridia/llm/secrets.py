r"""Secret scanning: three fixed patterns, and the Shannon entropy of sliding windows.

DataFrame functions only. Positions come from splitting: the pieces between the
matches of a pattern and the matches themselves alternate, so running sums of their
lengths are the spans. A pattern's cheap test comes first, and only texts that pass it
pay for the rest.

Entropy works on candidate strings (runs of base64/URL characters with a digit and a
letter in them). Each is scored against the threshold of its character class: hexadecimal
digits of any case, letters of one case with digits, or else base64. A threshold is what
99 of 100 random strings of the class reach in a single window, so of random secrets of
``WINDOW`` characters one in a hundred is missed, and fewer of longer ones. A window of ``WINDOW`` characters slides over it; an
array of counts, one per character of the class, is updated by the character that
enters and the one that leaves, and the sum of c*log2(c) with it, so a step costs the
same however long the window is. A candidate with a window at or above the threshold
becomes a span, unless the allow-list suppresses it. Base spans are never suppressed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only, table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A maximal run is matched whole or not at all, so the least length can be in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW, RUN = 20, 256
#: Bits per character that a window must reach, by character class: the lowest hundredth of
#: windows of 20 characters drawn at random from 16, 36 and 62 or 64 symbols is below.
HEX_BITS, ALNUM_BITS, BASE64_BITS = 2.9, 3.4, 3.64
#: Strings of high entropy that are no secrets: UUIDs, and paths or dates with separators.
ALLOW = (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$", r"^/?[a-z]+(/[a-z0-9._-]+)+/?$", r"^[0-9]+([-_/=+][0-9]+)*$")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Array of (start, kind, end, text) of the matches whose ``group`` has ``least`` characters."""
    lit = F.lit(pattern)
    match, gaps = F.regexp_extract_all(text, lit, F.lit(0)), F.split(text, pattern, -1)
    extra = (F.regexp_extract_all(text, lit, F.lit(group)),) if group else ()
    tested = "2" if group else "1"
    size = lambda x: F.length(x["0"]) + F.length(x["1"])

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["1"].alias("text")).cast(SPAN[6:-1]))
        return F.struct(end.alias("at"), F.when(F.length(x[tested]) >= least, F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    none = F.array().cast(SPAN)

    def located(pairs: Column) -> Column:
        # Runs of RUN matches are summed first, so that no array grows match by match.
        runs = F.transform(F.sequence(F.lit(0), F.size(pairs).cast("int") - 1, F.lit(RUN)), lambda k: F.slice(pairs, k + 1, RUN))
        return _let(runs, lambda runs: _let(_begins(F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda acc, x: acc + size(x)))), lambda begins: F.flatten(F.transform(runs, lambda run, k: F.aggregate(run, F.struct(F.get(begins, k).alias("at"), none.alias("found")), step, lambda acc: acc["found"])))))

    # The last gap has no match after it.
    pairs = F.slice(F.arrays_zip(gaps, match, *extra), 1, F.size(match))
    return F.when(F.rlike(text, lit), _let(pairs, lambda p: F.when(F.size(p) > 0, located(p)).otherwise(none))).otherwise(none)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _begins(lengths: Column) -> Column:
    """The sums of the lengths before each."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins"))
    return F.aggregate(lengths, none, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["begins"], F.array(acc["at"])).alias("begins")), lambda acc: acc["begins"])


def _window_bits(word: Column, alphabet: str, window: int) -> Column:
    """The highest entropy (bits per character) of the windows of ``word``.

    State: a count for each character of the alphabet, the running sum of c*log2(c),
    and the least such sum of a whole window, which is the most entropy. The word is
    cut into characters once; each step knows the one that enters and the one that leaves.
    """
    size, log_w = len(alphabet), math.log2(window)
    gain = F.lit([0.0] + [(c + 1) * math.log2(c + 1) - c * math.log2(c) for c in range(1, window + 1)])
    number = F.map_from_arrays(F.lit(list(alphabet)), F.lit(list(range(1, size + 1))))

    def put(counts: Column, at: Column, by: int) -> Column:
        return F.concat(F.slice(counts, 1, at - 1), F.array(F.element_at(counts, at) + by), F.slice(counts, at + 1, size))

    def step(acc: Column, x: Column) -> Column:
        come, go = x["come"], x["go"]
        grown = put(acc["counts"], come, 1)
        total = acc["total"] + F.element_at(gain, F.element_at(acc["counts"], come) + 1)
        full = go > 0
        out = F.greatest(go, F.lit(1))
        total = F.when(full, total - F.element_at(gain, F.greatest(F.element_at(grown, out), F.lit(1)))).otherwise(total)
        counts = F.when(full, put(grown, out, -1)).otherwise(grown)
        seen = acc["seen"] + 1
        least = F.when(seen >= window, F.least(acc["least"], total)).otherwise(acc["least"])
        return F.struct(counts.alias("counts"), total.alias("total"), least.alias("least"), seen.alias("seen"))

    zero = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("total"), F.lit(1e9).alias("least"), F.lit(0).alias("seen"))
    codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.element_at(number, c))
    late = lambda own: F.slice(F.concat(F.array_repeat(F.lit(0), window), own), F.lit(1), F.size(own))
    return _let(codes, lambda own: F.aggregate(F.zip_with(own, late(own), lambda a, b: F.struct(a.alias("come"), b.alias("go"))), zero, step, lambda acc: F.lit(log_w) - acc["least"] / window))


def _entropy_spans(text: Column, window: int, hex_bits: float, alnum_bits: float, base64_bits: float, allow: tuple[str, ...]) -> Column:
    mixed = F.lit(r"(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])" + CANDIDATE)

    def secret(x: Column) -> Column:
        word = x["text"]
        listed = F.lit(False)
        for pattern in allow:
            listed = listed | F.rlike(word, F.lit(pattern))
        odd = F.rlike(word, F.lit("[0-9]")) & F.rlike(word, F.lit("[A-Za-z]"))
        plain = F.lower(word)
        high = F.when(F.rlike(word, F.lit("^[0-9a-fA-F]+$")), _window_bits(plain, "0123456789abcdef", window) >= hex_bits)
        high = high.when(F.rlike(word, F.lit("^([0-9a-z]+|[0-9A-Z]+)$")), _window_bits(plain, "0123456789abcdefghijklmnopqrstuvwxyz", window) >= alnum_bits)
        high = high.otherwise(_window_bits(word, ALPHABET, window) >= base64_bits)
        return F.when(odd & ~listed, high).otherwise(False)

    found = F.filter(_spans(text, CANDIDATE, KINDS.index("entropy")), secret)
    return F.when(F.rlike(text, mixed), found).otherwise(F.array().cast(SPAN))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def secret_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    hex_bits: float = HEX_BITS,
    base64_bits: float = BASE64_BITS,
    allow: tuple[str, ...] = ALLOW,
    alnum_bits: float = ALNUM_BITS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``found``, its spans as an array of
    (start, kind, end, text) in code points by start, then kind.

    Matches of a pattern are leftmost and don't overlap; spans of different kinds may.
    A null text counts as empty and has no spans; a null id stays null; repeated rows
    are scanned each; other columns are not read; an empty table gives an empty result.
    ``allow`` lists patterns of candidates that entropy leaves alone.
    """
    text = F.coalesce(F.col("t").cast("string"), F.lit(""))
    rows = only(docs, id=id_col, t=text_col).select("id", text.alias("t"))
    t = F.col("t")
    base = F.array_sort(F.concat(_spans(t, ASSIGN, 0, 1, 6), _spans(t, ACCESS, 1), _spans(t, HEX, 2)))
    found = rows.select("id", base.alias("base"), _entropy_spans(t, window, hex_bits, alnum_bits, base64_bits, allow).alias("more"))
    return found.select(F.col("id").alias("doc_id"), "base", F.array_sort(F.concat("base", "more")).alias("found"))


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast(T.LongType())
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
