"""SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint has one bit for each of 64 hash bits, set where over half the shingle hashes have it. For a radius r the tables are the 2^(r+1)-1
nonzero vectors v of r+1 bits: bit i of a fingerprint gets a fixed nonzero vector phi(i), and the mask of v holds the bits with an odd inner
product of phi(i) and v. Any r differing bits span at most r dimensions, so some v is orthogonal to all of them, and in its table the pair agrees
on every masked bit: no pair within the radius is missed.

Only distinct fingerprints take part. Buckets of up to ``BUCKET`` fingerprints are compared in full. Larger ones are linked exactly without pairs (radius 2 or
less): every member names itself and the fingerprints one flipped unmasked bit away, and members that name the same one are linked to its least
member. Two fingerprints name a common one if and only if they differ in at most two bits.

Defined cases: null and empty texts, or texts without a word, have fingerprint zero and are linked like any other; fewer words than a shingle make
one shingle; repeated rows and ids are each returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkin.llm._common import cut, small_batches, table
from rowkin.llm.graph import components

SHINGLE, RADIUS, SEED = 3, 2, 42
BUCKET = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text, unsigned."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z, and only ASCII white space
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    total, digest, most = np.zeros(64, np.int64), xxhash.xxh64_intdigest, n - shingle + 1
    for at in range(0, most, 1 << 16):  # bounded memory for texts of any length
        to = min(most, at + (1 << 16))
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:to], ends[at + shingle - 1 : to + shingle - 1], strict=True)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > most, bitorder="little").tobytes(), "little")


def masks(radius: int) -> list[int]:
    """The covering masks, one for each table, as unsigned 64-bit integers."""
    size = 1 << (radius + 1)
    return [sum(1 << i for i in range(64) if ((i % (size - 1) + 1) & v).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints whose components are those of all pairs within the radius. ``prints``: one column, f, distinct."""
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2: larger buckets are linked through one flipped bit")
    mask = [_signed(m) for m in masks(radius)]
    keyed = prints.select("f", F.explode(F.array(*(F.struct(F.lit(k).alias("t"), F.col("f").bitwiseAND(F.lit(m)).alias("k")) for k, m in enumerate(mask)))).alias("e")).select("f", "e.*")
    sizes = cut(keyed.groupBy("t", "k").count().filter("count > 1"))
    shared = keyed.join(sizes, ["t", "k"])
    few = shared.filter(F.col("count") <= bucket).select("t", "k", "f")
    pairs = few.withColumnRenamed("f", "a").join(few.withColumnRenamed("f", "b"), ["t", "k"]).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    if not sizes.filter(F.col("count") > bucket).isEmpty():
        flips = F.element_at(F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(64) if radius and not m >> i & 1)) for m in masks(radius))), F.col("t") + 1)
        named = shared.filter(F.col("count") > bucket).select("t", "k", "f", F.explode(flips).alias("x")).withColumn("x", F.col("f").bitwiseXOR(F.col("x")))
        if radius == 1:  # names count where a member bears them
            named = named.join(prints.withColumnRenamed("f", "x"), "x", "left_semi")
        hubs = named.groupBy("t", "k", "x").agg(F.min("f").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        pairs = pairs.unionByName(named.join(hubs, ["t", "k", "x"]).filter("f <> a").select("a", F.col("f").alias("b")))
    return pairs.distinct()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, f), f signed. Each document's text is read once."""
    small_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    of_id = to_arrow_type(kind)

    def of_batch(batches):
        for b in batches:
            f = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(of_id), pa.array(f)], ["doc_id", "f"])

    return docs.select("doc_id", "text").mapInArrow(of_batch, f"doc_id {kind.simpleString()}, f long")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: doc_id, fingerprint (hexadecimal), component_id (the component's smallest doc_id)."""
    each = cut(fingerprints(docs, shingle))
    prints = cut(each.groupBy("f").agg(F.min("doc_id").alias("low")))
    roots = components(links(prints.select("f"), radius, bucket))
    joined = cut(prints.join(roots.withColumnRenamed("node", "f"), "f"))
    lows = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    moved = joined.join(lows, "root").select("f", F.col("component_id").alias("c"))
    # kept apart, so that the join below shuffles both sides and a fingerprint of very many documents can be split
    of_print = cut(prints.join(moved, "f", "left").select("f", F.least("low", "c").alias("component_id")))
    return each.join(of_print, "f").select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
