"""Exact deduplication by a 128-bit content hash, proved on the bytes of each group.

DataFrame functions only. The texts of a group meet as two running values, the least
and the greatest text: they are equal exactly when all texts of the group are, and
they combine before the shuffle, so a text with millions of copies moves once for
each map task. Groups in which they differ (a hash collision) are grouped anew by the
texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, only, table, written

SALTS = 64


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "max",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; ``keep`` says whether the
    largest ("max") or smallest ("min") id of a group stays. A null text counts as
    empty. Rows without an id are compared like others but never stay while a row with
    an id does; in a group without any id keep_id is null and kept false. Rows that
    repeat an id with an equal text get the same verdict each. An empty table gives an
    empty result; other columns are not read. ``digest`` is the group hash.
    """
    if keep not in ("max", "min"):
        raise ValueError(f"keep must be 'max' or 'min', not {keep!r}")
    best = F.max if keep == "max" else F.min
    text = ascii_lower(F.coalesce(F.col("t").cast("string"), F.lit("")))
    normal = only(docs, id=id_col, t=text_col).select("id", text.alias("t"))
    hashed = normal.select("id", "t", digest("t").alias("h"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))

    groups = written(
        hashed.groupBy("h")
        .agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count(F.lit(1)).alias("n"), best("id").alias("keep"), F.collect_set("salt").alias("salts"))
        .select("h", "n", "keep", "salts", (F.col("lo") == F.col("hi")).alias("same")),
        "exact-groups",
    )
    # The rows of a hot group are dealt over its salts, and its verdict goes to each.
    verdicts = groups.select("h", "n", "keep", "same", F.explode("salts").alias("salt"))
    rows = hashed.select("id", "h", "salt", F.sha2("t", 256).alias("sha")).join(verdicts, ["h", "salt"])
    out = rows.filter("same") if (collided := not groups.filter("not same").isEmpty()) else rows
    out = out.select("id", "keep", "n", "sha")
    if collided:
        clash = written(hashed.join(groups.filter("not same").select("h", F.explode("salts").alias("salt")), ["h", "salt"]), "exact-collisions")
        # ``t`` tells the members of a collided group apart; copies combine before the shuffle.
        truth = clash.groupBy("h", "t").agg(F.count(F.lit(1)).alias("n"), best("id").alias("keep"), F.collect_set("salt").alias("salts"))
        truth = truth.select("h", "t", "n", "keep", F.explode("salts").alias("salt"))
        out = out.unionByName(clash.join(truth, ["h", "t", "salt"]).select("id", "keep", "n", F.sha2("t", 256).alias("sha")))
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.coalesce(F.col("id") == F.col("keep"), F.lit(False)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
