"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups, keep one row by its stable id.

DataFrame functions only. The first aggregation is keyed by the hash and the text itself, so equality is decided by bytes and a hash collision
never merges two texts. Map-side combining leaves at most one row for each text and task before the shuffle: a group that holds a third of all
rows arrives as a few rows. Ids are then joined to their group by the 16-byte hash alone; texts that share a hash without being equal (found by a
count over the narrow group table) take a second join that compares the texts.

Defined cases: a null text counts as empty; an empty table gives an empty result; rows with a null id can only stay if every id of their group is
null; a row repeated with the same id and text shares the decision of its twin, and ``keep_exact`` leaves one of them. Extra columns of any type, maps included, are ignored
by ``exact_groups`` and carried by ``keep_exact``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkin.llm._common import cut, table


def content_hash(text: Column) -> Column:
    """The MD5 digest of the text's UTF-8 bytes, 16 bytes."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``. ``keep``: which id of equal texts stays, "min" or "max"."""
    pick = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("h", hash_of(F.col("t")))
    each = [F.count(F.lit(1)).alias("group_size"), pick("i").alias("keep_id")]
    groups = cut(rows.groupBy("h", "t").agg(*each).select("h", "keep_id", "group_size", F.unhex(F.sha2("t", 256)).alias("s")))
    collided = groups.groupBy("h").count().filter("count > 1").select("h")
    narrow = rows.select("i", "h")
    if collided.isEmpty():
        found = narrow.join(groups, "h")
    else:
        collided = cut(collided)
        apart = rows.join(collided, "h", "left_semi")
        texts = apart.groupBy("h", "t").agg(*each).withColumn("s", F.unhex(F.sha2("t", 256)))
        found = narrow.join(groups.join(collided, "h", "left_anti"), "h").select("i", "keep_id", "group_size", "s").unionByName(apart.join(texts, ["h", "t"]).select("i", "keep_id", "group_size", "s"))
    return found.select(F.col("i").alias(id_col), "keep_id", "group_size", F.col("i").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("s")).alias("text_sha256"))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def keep_exact(docs: DataFrame, keep: str = "max", id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows that stay, with all their columns, after one shuffle: one row for each distinct text.

    Of rows that tie on the id, the one whose other columns have the greatest hash stays. Texts are sorted within a task, by their hash.
    """
    best = {"min": F.min_by, "max": F.max_by}[keep]
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    names = {c: f"r{k}" for k, c in enumerate([id_col, *rest])}
    row = F.struct(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col(text_col).isNull().alias("none"))
    # maps have neither an order nor a hash
    tie = F.xxhash64(*(F.to_json(F.struct(f"`{c}`")) if _has_map(docs.schema[c].dataType) else F.col(f"`{c}`") for c in rest), F.col(text_col).isNull())
    # a null id sorts first, yet must not stay before a known one
    order = F.struct(*([F.col(id_col).isNull().alias("last")] if keep == "min" else []), F.col(id_col).alias("i"), tie.alias("tie"))
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), row.alias("r"), order.alias("o")).withColumn("h", hash_of(F.col("t")))
    kept = rows.groupBy("h", "t").agg(best("r", "o").alias("r"))
    back = {text_col: F.when(~F.col("r.none"), F.col("t")), **{c: F.col(f"r.{n}") for c, n in names.items()}}
    return kept.select(*(back[c].alias(c) for c in docs.columns))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
