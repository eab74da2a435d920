"""Near-dedup of texts by SimHash and covering locality-sensitive hashing: groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A text's fingerprint has 192 bits, each set where over half its shingle hashes have it. It is cut into 12 parts of 16 bits, and each part has the 7 covering masks
for radius 2 of ``simhash``, so there are 84 tables: two texts meet in one for certain if their fingerprints differ in 35 bits or fewer, since then some part differs
in two at most, and in most cases beyond. In each table texts are candidates if a chain of texts of one key joins them, each within ``REACH`` bits of the next. By
calculation fingerprints at a similarity of 0.8 differ in 29 bits on average; 2 pairs of exactly 0.8 in a million meet in no table, 1 differs in over ``REACH`` bits,
and fewer the more alike they are. Sets of few shingles differ in less even ways: the one case well beyond that, four shingles within five, is met by adding the
fingerprints of a set of five without one each. Every link is verified on the two whole shingle sets, so no pair below 0.8 is linked.

The candidates of a table are cut once more into chains, of fingerprints of 1,024 bits that differ in ``LONG_REACH`` bits at most, where 155 are the average at 0.8.
These form buckets. At first each member is verified with one member of the bucket that a hash chooses, in large buckets with several, which joins nearly all of a
large group by a number of pairs in proportion to its size. Then, in each bucket, the members outside its largest component are verified with all members of other
components, in large buckets by tiles within a task that emit only links, so the components are those of all candidate pairs above the threshold. Work grows with the
square of a bucket's size only where many of its members are not in one component. Fingerprints of one key are compared in pairs, some 4 ns each, unless they are in
one chain already: this part grows with the square of the number of texts.

Defined cases: words are separated by ASCII white space, only A-Z are lower-cased; fewer words than a shingle make one shingle; texts without a word, null and
empty ones among them, are alike; rows without an id stay; rows that repeat an id are decided by their own text; an empty table gives an empty result; all
columns are carried. Texts are told apart by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkin.llm._common import cut, small_batches
from rowkin.llm.graph import components
from rowkin.llm.simhash import masks

SHINGLE, SIMILARITY = 5, 0.8
#: Parts of 16 bits of a fingerprint, the radius that the masks of a part cover, and the bits in which the fingerprints of candidates may differ.
PARTS, RADIUS, REACH = 12, 2, 54
WORDS = PARTS // 4
#: The same of the long fingerprints, of 1,024 bits.
LONG, LONG_REACH = 16, 224
#: Tasks' shares of a table, the fingerprints dealt at once, and the size up to which all pairs of a key are compared at once.
SHARES, DEALT, SQUARE = 64, 1 << 15, 512
_ENTRY = np.dtype([("node", "<i8"), ("print", "<u8", WORDS)])
_MASKS = np.array([m & 0xFFFF for m in masks(RADIUS)], np.uint16)
#: Up to this size a bucket's pairs are verified one by one; members of larger ones by tiles of about so many, after so many leads.
BUCKET, TILE, LEADS = 16, 1000, 16
_RULE = np.array([[xxhash.xxh3_64_intdigest(bytes([k, j]), 7) for k in range(LONG)] for j in (0, 1)], np.uint64)
_FLIP, _TIMES = _RULE[0], _RULE[1] | np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, in order; none where it has no word."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z, and only ASCII white space
    joined, n = b" ".join(words), len(words)
    if not n:
        return np.zeros(0, np.uint64)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)).tolist()
    starts, size, digest = [0, *(e + 1 for e in ends[:-1])], min(size, n), xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends[size - 1 :])), np.uint64, n - size + 1))


def fingerprint(found: np.ndarray, words: int = WORDS) -> bytes:
    """The fingerprint of a set of shingles; zero for none."""
    total = np.zeros(64 * words, np.int64)
    for at in range(0, found.size, 255):  # so many fit a sum of one byte
        h = (found[at : at + 255, None] ^ _FLIP[:words]) * _TIMES[:words]
        h = (h ^ h >> np.uint64(32)) * _TIMES[:words]
        h ^= h >> np.uint64(29)
        total += np.unpackbits(h.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > found.size, bitorder="little").tobytes()


def fingerprints(found: np.ndarray, words: int = WORDS) -> bytes:
    """The fingerprint of a set of shingles; of five, also those of each four of them, one after the other."""
    return fingerprint(found, words) + b"".join(fingerprint(np.delete(found, k), words) for k in range(5 if found.size == 5 else 0))


def _apart(cols: list[np.ndarray], others: list) -> np.ndarray:
    return sum((np.bitwise_count(c ^ o) for c, o in zip(cols, others, strict=True)), np.zeros((), np.uint16))


def chains(prints: np.ndarray, reach: int = REACH) -> list[np.ndarray]:
    """The places of fingerprints in each component, of two or more, of those that differ in so many bits at most."""
    cols = [np.ascontiguousarray(c) for c in prints.T]
    rest, out = np.arange(len(prints)), []
    if rest.size <= SQUARE:
        few = _apart([c[:, None] for c in cols], cols) <= reach
        if np.count_nonzero(few) == rest.size:
            return out
        rest = np.flatnonzero(np.count_nonzero(few, axis=1) > 1)
        cols = [c[rest] for c in cols]
    while rest.size:
        todo, chain = [(rest[0], [c[0] for c in cols])], []
        rest, cols = rest[1:], [c[1:] for c in cols]
        while todo:
            x, own = todo.pop()
            chain.append(x)
            if rest.size and (near := _apart(cols, own) <= reach).any():
                todo += zip(rest[near], zip(*(c[near] for c in cols), strict=True), strict=True)
                rest, cols = rest[~near], [c[~near] for c in cols]
        if len(chain) > 1:
            out.append(np.array(chain))
    return out


def _buckets(found) -> pa.Table:
    """(k, node) of the nodes of chains, k being the least node."""
    sets = [own for own in map(np.unique, found) if own.size > 1]
    none = [np.zeros(0, np.int64)]
    return pa.table({"k": pa.array(np.concatenate(none + [np.full(own.size, own[0]) for own in sets])), "node": pa.array(np.concatenate(none + sets))})


def candidates(nodes: DataFrame) -> DataFrame:
    """(k, node) of the buckets of all tables, k being the least node. ``nodes``: node, prints."""

    def dealt(batches):
        """A row for each share of each table with the entries of very many texts."""
        held, size = [], 0

        def rows_of(held):
            data = np.concatenate(held)
            lanes = data["print"].view("<u2")
            for p in range(PARTS):
                shares, blobs = [], []
                for j, m in enumerate(_MASKS):
                    share = (lanes[:, p] & m) * np.uint16(40503) >> np.uint16(10)
                    order = np.argsort(share, kind="stable")
                    share, own = share[order], data[order]
                    starts = np.flatnonzero(np.diff(share, prepend=np.uint16(SHARES)))
                    shares += ((p * len(_MASKS) + j) * SHARES + share[starts].astype(np.int64)).tolist()
                    blobs += [own[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(own)])]
                yield pa.RecordBatch.from_arrays([pa.array(shares, pa.int32()), pa.array(blobs, pa.binary())], ["share", "entries"])

        for rows in batches:
            texts = rows.column(1).to_pylist()
            part = np.zeros(sum(map(len, texts)) // (8 * WORDS), _ENTRY)
            part["node"] = np.repeat(rows.column(0).to_numpy(zero_copy_only=False), [len(t) // (8 * WORDS) for t in texts])
            part["print"] = np.frombuffer(b"".join(texts), "<u8").reshape(-1, WORDS)
            held.append(part)
            size += len(part)
            if size >= DEALT:
                yield from rows_of(held)
                held, size = [], 0
        if size:
            yield from rows_of(held)

    def of_group(group):
        data = np.frombuffer(b"".join(group["entries"].to_pylist()), _ENTRY)
        p, j = divmod(group["share"][0].as_py() // SHARES, len(_MASKS))
        key = data["print"].view("<u2")[:, p] & _MASKS[j]
        order = np.argsort(key, kind="stable")
        key, data = key[order], data[order]
        starts = np.flatnonzero(np.diff(key, prepend=~key[:1]))
        spans = [(a, b) for a, b in zip(starts, [*starts[1:], len(key)]) if b - a > 1]
        return _buckets(data["node"][a:b][chain] for a, b in spans for chain in chains(data["print"][a:b]))

    shares = nodes.select("node", "prints").mapInArrow(dealt, "share int, entries binary")
    return shares.groupBy("share").applyInArrow(of_group, "k long, node long").distinct()


def refined(keyed: DataFrame, texts: DataFrame) -> DataFrame:
    """The buckets (k, node) cut into chains of long fingerprints. Buckets with a text whose least bucket is the same are one, so that a large group does not come once for each table."""

    def of_batch(batches):
        for rows in batches:
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([fingerprints(shingles(t.as_py()), LONG) for t in rows.column(1)], pa.binary())], ["node", "prints"])

    def of_group(group):
        texts = group["prints"].to_pylist()
        nodes = np.repeat(group["node"].to_numpy(), [len(t) // (8 * LONG) for t in texts])
        return _buckets(nodes[chain] for chain in chains(np.frombuffer(b"".join(texts), "<u8").reshape(-1, LONG), LONG_REACH))

    prints = cut(texts.select("node", "text").mapInArrow(of_batch, "node long, prints binary"))
    met = keyed.groupBy("node").agg(F.collect_set("k").alias("ks")).join(prints, "node")  # of a text, one bucket for each table at most
    found = cut(met.select(F.explode("ks").alias("k"), "node", "prints").groupBy("k").applyInArrow(of_group, "k long, node long").distinct())
    least = found.groupBy("node").agg(F.min("k").alias("least"))
    joined = found.join(least, "node").groupBy("k").agg(F.min("least").alias("to"))
    return cut(found.join(joined, "k").select(F.col("to").alias("k"), "node").distinct())


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    both = np.intersect1d(a, b, assume_unique=True).size
    return both >= similarity * (a.size + b.size - both)


def _node(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are alike."""

    def of_batch(batches):
        last, own = None, None
        for rows in batches:
            good = []
            for a, x, y in zip(rows.column(0).to_pylist(), rows.column(2), rows.column(3), strict=True):
                if a != last:
                    last, own = a, shingles(x.as_py())
                good.append(alike(own, shingles(y.as_py())))
            yield rows.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(texts.toDF("b", "y"), "b").join(texts.toDF("a", "x"), "a").select("a", "b", "x", "y")
    return cut(both.mapInArrow(of_batch, "a long, b long"))


def links(texts: DataFrame, keyed: DataFrame, bucket: int = BUCKET, tile: int = TILE) -> DataFrame:
    """(node, root) of all texts that are linked to another. ``texts``: node, text of all that share a key; ``keyed``: k, node, lead of each bucket."""
    pairs = cut(keyed.filter("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct())
    roots = components(_verified(pairs, texts))
    labelled = cut(keyed.select("k", "node").distinct().join(roots, "node", "left").select("k", "node", F.coalesce("root", "node").alias("root")))
    parts = labelled.groupBy("k", "root").count().groupBy("k").agg(F.max_by("root", F.struct("count", "root")).alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("k", "top")
    left = cut(labelled.join(parts, "k"))
    sizes = cut(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    small = left.join(sizes.filter(F.col("n") <= bucket).select("k"), "k")
    few = small.filter("root <> top").select("k", F.col("node").alias("x"), F.col("root").alias("own"))
    more = few.join(small, "k").filter("own <> root AND (root = top OR x < node)").select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()
    more = _verified(cut(more.join(pairs, ["a", "b"], "left_anti")), texts)
    if not (big := sizes.filter(F.col("n") > bucket)).isEmpty():
        more = more.unionByName(_tiled(left.join(big.withColumn("of", F.ceil(F.col("n") / tile).cast("int")), "k"), texts))
    return roots if more.isEmpty() else components(more.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))))


def _tiled(left: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges that join the components of all alike pairs in each bucket. ``left``: k, node, root, top, and ``of``, the number of tiles; each pair of tiles is one group."""

    def of_group(group):
        nodes, roots, top, tiles = (group[c].to_pylist() for c in ("node", "root", "top", "own"))
        sets = [shingles(t) for t in group["text"].to_pylist()]
        sizes = np.array([x.size for x in sets])
        known, at = np.unique(np.concatenate(sets), return_inverse=True)
        holder, begins = np.repeat(np.arange(len(sets)), sizes), np.concatenate(([0], np.cumsum(sizes)))
        tile, across, parent, found = np.array(tiles), len(set(tiles)) > 1, {r: r for r in roots}, []

        def root_of(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for x in (k for k in range(len(sets)) if roots[k] != top[k]):
            held = np.zeros(known.size)
            held[at[begins[x] : begins[x + 1]]] = 1
            both = np.bincount(holder, held[at], len(sets))
            good = both >= SIMILARITY * (sizes + sizes[x] - both)
            for y in np.flatnonzero(good & (tile != tile[x]) if across else good).tolist():
                if (p := root_of(roots[x])) != (q := root_of(roots[y])):
                    parent[p] = q
                    found.append((nodes[x], nodes[y]))
        return pa.table({"a": pa.array([min(e) for e in found], pa.int64()), "b": pa.array([max(e) for e in found], pa.int64())})

    dealt = left.withColumn("own", F.pmod(F.xxhash64("node"), F.col("of")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    dealt = dealt.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "top").join(texts, "node")
    return cut(dealt.groupBy("k", "i", "j").applyInArrow(of_group, "a long, b long"))


def keep_similar(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each component of near copies the one with the smallest id, with all columns."""
    small_batches(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    of_id = to_arrow_type(kind)

    def of_batch(batches):
        for rows in batches:
            found = pa.array([fingerprints(shingles(t.as_py())) for t in rows.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(of_id), rows.column(1), found], ["doc_id", "node", "prints"])

    rows = docs.select("doc_id", _node(F.col("text")).alias("node"), "text")
    each = cut(rows.mapInArrow(of_batch, f"doc_id {kind.simpleString()}, node long, prints binary"))
    nodes = cut(each.groupBy("node").agg(F.min("doc_id").alias("low"), F.first("prints").alias("prints")))
    keyed = cut(candidates(nodes))
    texts = cut(rows.select("node", "text").join(keyed.select("node").distinct(), "node").groupBy("node").agg(F.first("text").alias("text")))
    found = refined(keyed, texts)
    leads = [F.min(F.struct(F.xxhash64("k", "node", F.lit(j)), "node"))["node"] for j in range(LEADS)]
    buckets = found.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.array(*leads).alias("leads"))
    buckets = buckets.select("k", F.explode(F.array_distinct(F.slice("leads", 1, F.when(F.col("n") > BUCKET, LEADS).otherwise(1)))).alias("lead"))
    shared = cut(found.join(cut(buckets), "k").select("k", "node", "lead"))
    joined = nodes.select("node", "low").join(links(texts, shared), "node")
    lows = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    moved = joined.join(lows, "root").select("node", F.col("component_id").alias("c"))
    # kept apart, so that the join below shuffles both sides and a text of very many documents can be split
    of_node = cut(nodes.select("node", "low").join(moved, "node", "left").select("node", F.least("low", "c").alias("component_id")))
    gone = each.join(of_node, "node").filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"), F.col("node").alias("gone_node")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (_node(docs["text"]) == gone["gone_node"]), "left_anti")
