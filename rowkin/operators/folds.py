"""Folds, samples and labels; all by hashes of ids, so they do not depend on row order or cluster layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS = 5
EMBEDDING_FOLDS, MATCHER_FOLDS, VALIDATION_FOLDS = (1, 2), (3, 4), (0,)


def hash_of(*columns: Column | str) -> Column:
    """32 bits of the MD5 digest of the values as text."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 8), 16, 10).cast("long")


def fold(key: Column | str, folds: int = FOLDS) -> Column:
    return (hash_of(F.col(key) if isinstance(key, str) else key) % folds).cast("int")


def dropped(key: Column | str, share: float = 0.19) -> Column:
    """Whether an entity is left out to simulate records without a partner."""
    return hash_of(F.col(key) if isinstance(key, str) else key, F.lit("drop")) % 10_000 < round(share * 10_000)


def sampled(df: DataFrame, keys: list[str], n: int | None = None, share: float | None = None, seed: str = "") -> DataFrame:
    """n rows, or a share of all, in the order of a seeded hash of the keys."""
    h = hash_of(*(F.col(k) for k in keys), F.lit(seed))
    return df.filter(h < int(share * (1 << 32))) if share is not None else df.orderBy(h, *keys).limit(n)


def labelled(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """y = 1 for pairs of the truth (s, x), else 0."""
    return pairs.join(truth.select("s", "x").distinct().withColumn("y", F.lit(1)), ["s", "x"], "left").fillna(0, ["y"])


def hard_pairs(candidates: DataFrame, folds: tuple[int, ...] = EMBEDDING_FOLDS) -> DataFrame:
    """Near pairs of the given folds (column f)."""
    return candidates.filter(F.col("f").isin(list(folds)) & ((F.col("rx") < 3) | (F.col("rs") < 5)))


def pseudo_labels(scores: DataFrame, hot: str | None = None, most_hot: int = 900_000, most_other: int = 600_000) -> DataFrame:
    """(s, x, y): a record's best pair where sure (q over 0.97) is positive, its next two are negative, as are the best two of records that fit nowhere (q under 0.005).

    With ``hot``, a value of ``country``, at most so many rows of it and of the others are drawn by hash.
    """
    each = Window.partitionBy("x")
    ranked = scores.withColumns({"qm": F.max("q").over(each), "r": F.row_number().over(each.orderBy(F.desc("q"), "s"))})
    sure, none = F.col("qm") > 0.97, F.col("qm") < 0.005
    label = F.when(sure & (F.col("r") == 1), 1.0).when((sure & (F.col("r") <= 3)) | (none & (F.col("r") <= 2)), 0.0)
    found = ranked.withColumn("y", label).filter("y IS NOT NULL")
    if hot is not None:
        of = F.coalesce(F.col("country") == hot, F.lit(False))
        found = sampled(found.filter(of), ["s", "x"], most_hot, seed="1").unionByName(sampled(found.filter(~of), ["s", "x"], most_other, seed="1"))
    return found.select("s", "x", "y")
