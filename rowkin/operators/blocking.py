"""Candidate retrieval: exact top-k by vector similarity inside blocks, and its cuts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOP, MOST_RANK = 20, 127
#: Rows of one tile's side; a task holds one tile of each side.
TILE = 65_536
#: Cells of similarities that a task computes at once.
CELLS = 1 << 24


def dot(a: Column, b: Column) -> Column:
    """Inner product of two float arrays, summed in double from the first element on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _buckets(texts: list[str], size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every character n-gram: its code points as digits to the base 31, modulo ``size``. A shorter text is one n-gram, an empty one none."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    padded = np.concatenate([codes, np.zeros(n, np.int64)])
    owner = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(codes.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = lengths[owner] - place  # characters from here to the text's end
    digits = sum(np.where(left > k, padded[k : k + codes.size], 0) * 31 ** (n - 1 - k) for k in range(n))
    keep = (left >= n) | (place == 0)
    return owner[keep], digits[keep] % size


@dataclass(frozen=True)
class NgramEmbedder:
    """The default embedder: counts of character n-grams by hash, weighted by the buckets' rarity once fitted, in unit length. A null or empty text is the zero vector."""

    size: int = 64
    n: int = 3
    weights: tuple[float, ...] | None = None

    def __call__(self, text: Column) -> Column:
        size, n, weights = self.size, self.n, np.ones(self.size) if self.weights is None else np.array(self.weights)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def embed(texts: pd.Series) -> pd.Series:
            owner, bucket = _buckets(texts.fillna("").tolist(), size, n)
            counts = np.bincount(owner * size + bucket, minlength=len(texts) * size).reshape(-1, size) * weights
            norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            return pd.Series(list(counts / np.where(norms > 0, norms, 1)))

        return embed(text)

    def fit(self, texts: DataFrame) -> NgramEmbedder:
        """The embedder with weights 1 + ln((1 + texts) / (1 + texts with the bucket)); ``texts``: one column, text. One small aggregation."""
        counts = texts.select(F.posexplode(replace(self, weights=None)(F.col(texts.columns[0]))).alias("d", "v")).groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") > 0).alias("df")).collect()
        found = {r["d"]: float(1 + np.log((1 + r["n"]) / (1 + r["df"]))) for r in counts}
        return replace(self, weights=tuple(found.get(d, 1.0) for d in range(self.size)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks if len(c)]
    return np.concatenate(parts).astype(np.float64, copy=False).reshape(len(column), -1)


def _nearest(ours: np.ndarray, theirs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, similarity) of each row's k most similar columns, equal ones by place.

    Single precision finds the candidates: all within twice its error of the k-th; their sums are then taken in double, element by element, so that equal vectors have equal sums
    in any tile.
    """
    k = min(k, len(theirs))
    norm = lambda m: float(np.sqrt((m * m).sum(axis=1)).max())
    error = (ours.shape[1] + 2) * 2.0**-23 * norm(ours) * norm(theirs)
    small, turned = ours.astype(np.float32), np.ascontiguousarray(theirs.astype(np.float32).T)
    out, step = [], max(1, CELLS // len(theirs))
    for at in range(0, len(ours), step):
        near = small[at : at + step] @ turned
        least = np.partition(near, len(theirs) - k, axis=1)[:, len(theirs) - k]
        rows, columns = np.nonzero(near >= (least - np.float32(2 * error) - np.abs(least) * np.float32(1e-6))[:, None])
        sims = np.zeros(rows.size)
        for d in range(ours.shape[1]):
            sims += ours[at + rows, d] * theirs[columns, d]
        order = np.lexsort((columns, -sims, rows))
        rows, columns, sims = rows[order], columns[order], sims[order]
        rank = np.arange(rows.size) - np.searchsorted(rows, rows)
        out.append((at + rows[rank < k], columns[rank < k], sims[rank < k]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def scored_pairs(entities: DataFrame, records: DataFrame, k: int = TOP, tile: int = TILE) -> DataFrame:
    """(block, s, x, sim): each record's k most similar entities of its block, ties to the smaller s.

    ``entities``: block, s, e; ``records``: block, x, e; e are vectors of one length as double arrays. Blocks are cut in tiles of both sides by hash; a task multiplies one tile of
    records with one tile of entities and keeps the top k of each record; the tops of all tiles then meet in a window that is limited to k before
    its shuffle. So a block of any size is spread over tasks, and none holds more than two tiles (32 MB each at 64 elements). A record is sent once for each 65,536 entities of
    its block, an entity once for each 65,536 records. Records of blocks without entities are left out.
    """
    sizes = entities.groupBy("block").count().select("block", F.ceil(F.col("count") / tile).cast("int").alias("es"))
    of_records = records.groupBy("block").count().select("block", F.ceil(F.col("count") / tile).cast("int").alias("rs"))
    tiles = sizes.join(of_records, "block")
    left = entities.join(tiles, "block").select("block", F.pmod(F.xxhash64("s"), F.col("es")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rs") - 1)).alias("j"), "s", "e")
    right = records.join(tiles, "block").select(F.col("block").alias("block_x"), F.explode(F.sequence(F.lit(0), F.col("es") - 1)).alias("i_x"), F.pmod(F.xxhash64("x"), F.col("rs")).cast("int").alias("j_x"), "x", F.col("e").alias("e_x"))
    types = {c: d.schema[c].dataType.simpleString() for d, c in ((entities, "block"), (entities, "s"), (records, "x"))}

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["block", "s", "x", "sim"]
        if not a.num_rows or not b.num_rows:
            return pa.table({"block": a["block"].slice(0, 0), "s": a["s"].slice(0, 0), "x": b["x"].slice(0, 0), "sim": pa.array([], pa.float64())})
        a = a.sort_by("s")
        rows, columns, sims = _nearest(_matrix(b["e_x"]), _matrix(a["e"]), k)
        return pa.Table.from_arrays([b["block_x"].take(rows), a["s"].take(columns), b["x"].take(rows), pa.array(sims)], names)

    found = left.groupBy("block", "i", "j").cogroup(right.groupBy("block_x", "i_x", "j_x")).applyInArrow(multiply, f"block {types['block']}, s {types['s']}, x {types['x']}, sim double")
    return found.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("sim"), "s"))).filter(F.col("r") <= k).drop("r")


def joined_pairs(entities: DataFrame, records: DataFrame, k: int = TOP) -> DataFrame:
    """The same by an equi-join on the block: all pairs of a block as rows, to compare with in tests."""
    pairs = entities.select("block", "s", F.col("e").alias("es")).join(records.select("block", "x", F.col("e").alias("ex")), "block").select("block", "s", "x", dot("ex", "es").alias("sim"))
    return pairs.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("sim"), "s"))).filter(F.col("r") <= k).drop("r")


def ranked(pairs: DataFrame) -> DataFrame:
    """rx, the entity's rank for the record, and rs, the record's rank for the entity within the given pairs; both from 0, rs at most 126. The second sorts ids and similarities alone, by entity."""
    rx = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("sim"), "s")) - 1
    rs = F.least(F.row_number().over(Window.partitionBy("s").orderBy(F.desc("sim"), "x")), F.lit(MOST_RANK)) - 1
    return pairs.withColumns({"rx": rx, "rs": rs})


def block_topk(entities: DataFrame, records: DataFrame, k: int = TOP, pairs: Callable = scored_pairs) -> DataFrame:
    """(block, s, x, sim, rx, rs): exact blocked top-k."""
    return ranked(pairs(entities, records, k))


def prune(candidates: DataFrame, kx: int = 3, ks: int = 10) -> DataFrame:
    """Pairs that are near for the record or for the entity."""
    return candidates.filter((F.col("rx") < kx) | (F.col("rs") < ks))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with a dense ``place`` from 0 in the given order: rows are sorted by ranges, numbered within each, and the sizes of the ranges before added, so no task sees all rows."""
    parts = rows.sort(*order).withColumn("part", F.spark_partition_id()).persist()
    within = parts.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("first", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")  # as many rows as ranges
    return within.join(before, "part").withColumn("place", F.col("place") + F.col("first")).drop("part", "first")


def debug_candidates(truth: DataFrame, entities: DataFrame, n: int = 200_000, negatives: int = 3) -> DataFrame:
    """(s, x, sim, rx, rs): n true pairs by hash, and for each record ``negatives`` entities by hash, distinct, with constant similarity.

    ``entities``: s and a dense place 0..count-1. Negative places are hashes of the record, looked up by an equi-join.
    """
    count = entities.count()
    some = truth.select("s", "x").orderBy(F.md5(F.concat_ws("|", "s", "x")), "s", "x").limit(n)
    place = lambda j: F.conv(F.substring(F.md5(F.concat_ws("|", F.col("x"), F.lit(j))), 1, 8), 16, 10).cast("long") % max(count, 1)
    false = some.select("x", F.explode(F.array(*(place(j) for j in range(negatives)))).alias("place")).join(entities, "place").select("s", "x")
    return some.unionByName(false).distinct().select("s", "x", F.lit(0.5).alias("sim"), F.lit(0).alias("rx"), F.lit(0).alias("rs"))
