"""Substring dedup by content-defined chunking with a gear rolling hash.

The rolling hash of 16 bits adds a fixed random value for each byte and shifts by one, so it depends on the last 16 bytes alone. A chunk ends where the
hash falls below ``2^16 / SPREAD`` and at least ``LEAST`` bytes have passed, or, after ``MOST`` bytes without such a place, at the least hash. Inserted text therefore moves only the chunk ends near
it. Chunks are compared by a 64-bit digest over all documents; runs of adjoining chunks that other documents also hold are the
repeated passages, divided where the first holder changes. A run needs two chunks or more, so a digest that two chunks share by chance makes none.

Passages of more than 50 words are looked for. What such a passage has outside its first and last common chunk end is not counted, so runs from ``WORDS`` words are taken, but only where
the run, the two chunks beside it and ``SLACK`` words could be ``LONG`` words together: a shorter line or phrase that many documents share is left alone. Repeats within one
document alone are no passages.

Digests are combined before the shuffle (smallest and largest document, no list), so a passage that a third of all documents hold is as
cheap as any other. Chunks are computed again for the join instead of being stored: that is cheaper than writing them.

Every row is told apart by a 64-bit key. Ids from 0 to 2^38 are the key's upper part, so that documents are ordered by id, with 24 bits of a hash of the text below; any other
id, strings among them, is hashed with its text, and comes behind.

Defined cases: null and empty texts have no chunks; rows that repeat id and text count once; rows that repeat an id with another text are documents of their own, as is every row
without an id; an empty table gives an empty result; ids come back as they are, in the type they have; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkin.llm._common import cut, small_batches, table

SPREAD, LEAST, MOST = 20, 12, 160
WORDS, SLACK, LONG = 20, 3, 51
REACH = 16
#: The gear: one value for each byte, from a rule; zero for the byte that separates texts.
GEAR = np.array([0] + [xxhash.xxh64_intdigest(bytes([k]), 1) & 0xFFFF for k in range(1, 256)], np.uint16)
#: Keys from here on are hashes.
HASHED, ORDERED = 1 << 62, 1 << 38


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, for all bytes at once: sums over 1, 2, 4, 8 and 16 bytes."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        wider = h.copy()
        wider[k:] += h[:-k] << np.uint16(k)
        h = wider
    return h


def ends_of(candidates: list[int], h: np.ndarray) -> list[int]:
    """Chunk ends of a text, given the hash after each byte and the places after which it would end one.

    Where no place comes within ``MOST`` bytes, as in a word repeated over and over, the chunk ends at the first least hash, so that ends depend on the content there too.
    """
    ends, last, size = [], 0, len(h)
    for c in [*candidates, size]:
        while c - last > MOST:
            last += LEAST + int(h[last + LEAST - 1 : last + MOST].argmin())
            ends.append(last)
        if c - last >= LEAST and c < size:
            ends.append(c)
            last = c
    if size > last:
        ends.append(size)
    return ends


def chunks_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, start, end, words begun, digest) of all chunks of all texts; start and end in code points."""
    gap = b"\0" * REACH
    data = gap + gap.join(texts) + gap
    array = np.frombuffer(data, np.uint8)
    hashes = gear_hash(array)
    hit = np.flatnonzero(hashes < (1 << 16) // SPREAD) + 1
    space = (array == 32) | ((array >= 9) & (array <= 13))
    fresh = np.zeros(array.size, np.int64)
    fresh[1:] = ~space[1:] & (space[:-1] | (array[:-1] == 0))
    words = np.concatenate(([0], np.cumsum(fresh)))
    points = np.concatenate(([0], np.cumsum((array & 0xC0) != 0x80)))
    which, froms, tos, digests = [], [], [], []
    digest, at = xxhash.xxh3_64_intdigest, REACH
    for k, t in enumerate(texts):
        a, b = np.searchsorted(hit, (at + 1, at + len(t)))
        last = at
        for e in ends_of((hit[a:b] - at).tolist(), hashes[at : at + len(t)]):
            froms.append(last)
            last = at + e
            tos.append(last)
            digests.append(digest(data[froms[-1] : last]))
        which += [k] * (len(froms) - len(which))
        at += len(t) + REACH
    which, froms, tos = np.array(which, np.int64), np.array(froms, np.int64), np.array(tos, np.int64)
    base = np.concatenate(([REACH], REACH + np.cumsum([len(t) + REACH for t in texts])))[:-1][which] if texts else froms
    return which, points[froms] - points[base], points[tos] - points[base], words[tos] - words[froms], np.array(digests, np.uint64).view(np.int64)


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(r, text) of all rows, and (r, doc_id) of those whose id the key does not show."""
    kind = docs.schema["doc_id"].dataType
    rows, own = docs.select("doc_id", "text"), F.xxhash64(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))
    hashed = F.lit(HASHED).bitwiseOR(F.shiftrightunsigned(own, 2))
    plain = F.lit(False)
    if isinstance(kind, T.IntegralType):
        plain = (F.col("doc_id") >= 0) & (F.col("doc_id") < ORDERED)
        hashed = F.when(plain, F.shiftleft(F.col("doc_id").cast("long"), 24).bitwiseOR(F.shiftrightunsigned(own, 40))).otherwise(hashed)
    known = rows.filter("doc_id IS NOT NULL")
    every, others = known.select(hashed.alias("r"), "text"), known.filter(~plain).select(hashed.alias("r"), "doc_id")
    if not (none := rows.filter("doc_id IS NULL")).isEmpty():
        # numbered once and kept, so that a row has the same key whenever it is read
        none = cut(none.select(F.lit(HASHED).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id(), F.lit("none")), 2)).alias("r"), "doc_id", "text"))
        every, others = every.unionByName(none.select("r", "text")), others.unionByName(none.select("r", "doc_id"))
    return every, others.distinct()


def chunks(rows: DataFrame) -> DataFrame:
    """r, place, d (digest) of the chunks of (r, text). ``place`` holds start, length, and the words that begin in the chunk, in the one before and in the one behind it."""
    small_batches(rows.sparkSession)

    def of_batch(batches):
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), [(t or "").encode("utf-8", "replace") for t in b.column(1).to_pylist()]
            a = size = 0
            for k, t in enumerate(texts, 1):
                size += len(t)
                if size > 1 << 20 or k == len(texts):
                    which, start, end, n, d = chunks_of(texts[a:k])
                    same = which[1:] == which[:-1]
                    beside = np.zeros((2, n.size), np.int64)
                    beside[0, 1:], beside[1, :-1] = n[:-1] * same, n[1:] * same
                    place = start << 32 | end - start << 24 | n << 16 | beside[0] << 8 | beside[1]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[a:k][which], place, d)], ["r", "place", "d"])
                    a, size = k, 0

    return rows.select("r", "text").mapInArrow(of_batch, "r long, place long, d long")


def repeated_passages(docs: DataFrame, words: int = WORDS, long: int = LONG) -> DataFrame:
    """One row per passage that other documents also hold: doc_id, start, end (code points), n_words, keep_doc_id, kept.

    In a run of common chunks, those that no earlier document holds are the document's own, and so are fewer than ``words`` words beside them; such a part is ``kept``.
    The rest is not kept and divided by the first document that holds each chunk, ``keep_doc_id``; fewer than ``words`` words of another one, or one chunk, count with the part before
    or after. Parts of less than ``words`` words are not reported. So a chunk is never given up in the first document that holds it, and each text has one that keeps it.
    """
    rows, others = keyed(docs)
    every = chunks(rows)
    # kept apart, so that the join shuffles both sides and a chunk of very many documents can be split
    common = cut(every.groupBy("d").agg(F.min("r").alias("first"), F.max("r").alias("last")).filter("first < last").select("d", "first"))
    bits = lambda shift: F.shiftright("place", shift).bitwiseAND(F.lit(255))
    found = every.join(common, "d").select("r", "place", "first").repartition("r").distinct()
    found = found.select("r", "first", F.shiftright("place", 32).alias("start"), (F.shiftright("place", 32) + bits(24)).alias("end"), bits(16).alias("n"), bits(8).alias("before"), bits(0).alias("behind"))
    each = Window.partitionBy("r").orderBy("start")
    changed = lambda *xs: F.coalesce(reduce(or_, (F.lag(x).over(each) != F.col(x) for x in xs)), F.lit(True)).cast("int")
    opens, closes = F.coalesce(F.lag("end").over(each) != F.col("start"), F.lit(True)), F.coalesce(F.lead("start").over(each) != F.col("end"), F.lit(True))
    runs = found.withColumns({"new": opens.cast("int"), "beside": F.when(opens, F.col("before")).otherwise(0) + F.when(closes, F.col("behind")).otherwise(0)})
    runs = runs.withColumn("turn", F.greatest("new", changed("first")))
    runs = runs.withColumns({"run": F.sum("new").over(each), "part": F.sum("turn").over(each)})
    parts = runs.groupBy("r", "run", "part", "first").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("c"), F.sum("beside").alias("beside"))
    parts = parts.withColumn("own", F.col("first") == F.col("r")).withColumn("turn", changed("run", "own")).withColumn("stretch", F.sum("turn").over(each))
    of_run, of_stretch = Window.partitionBy("r", "run"), Window.partitionBy("r", "stretch")
    total = {name: F.sum(c).over(of_run) for name, c in (("size", "n"), ("edge", "beside"), ("chunks", "c"))}
    parts = parts.withColumns({**total, "some": F.max("own").over(of_run), "near": F.sum("n").over(of_stretch)})
    parts = parts.filter((F.col("size") >= words) & (F.col("size") + F.col("edge") + SLACK >= long) & (F.col("chunks") > 1))
    parts = parts.withColumn("own", F.col("own") | F.col("some") & (F.col("near") < words)).withColumn("turn", changed("run", "own")).withColumn("stretch", F.sum("turn").over(each))
    large, most = F.when((F.col("n") >= words) & (F.col("c") > 1), F.col("first")), F.max(F.struct("n", "first")).over(of_stretch)["first"]
    before, any_large = F.last(large, True).over(of_stretch.orderBy("start")), F.first(large, True).over(of_stretch.orderBy("start").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = parts.withColumn("keep", F.when(F.col("own"), F.col("r")).otherwise(F.coalesce(before, any_large, most)))
    parts = parts.withColumn("turn", changed("run", "keep")).withColumn("part", F.sum("turn").over(each))
    passages = parts.groupBy("r", "part", "keep").agg(F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end"), F.sum("n").alias("n_words")).filter(F.col("n_words") >= words)
    kind = docs.schema["doc_id"].dataType
    shown = lambda c: F.when(F.col(c) < HASHED, F.shiftright(c, 24)).cast(kind) if isinstance(kind, T.IntegralType) else F.lit(None).cast(kind)
    for key, name in (("r", "doc_id"), ("keep", "keep_doc_id")):
        passages = passages.join(others.toDF(key, "other"), key, "left").withColumn(name, F.coalesce(shown(key), "other")).drop("other")
    return passages.select("doc_id", "start", "end", "n_words", "keep_doc_id", (F.col("keep") == F.col("r")).alias("kept"))


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
