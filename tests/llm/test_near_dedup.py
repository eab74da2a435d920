"""The near-dedup stage against brute force on whole shingle sets."""

import random

import corpus_pipeline
from rowkin.llm import near_dedup


def shingles(text):
    words = (text or "").encode("utf-8", "replace").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def stays(rows):
    """Row numbers of those that stay, by all pairs."""
    sets, group = [shingles(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    return {k for k, (i, _) in enumerate(rows) if i is None or i == min(rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None)}


def check(spark, rows):
    frame = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k long").repartition(3)
    got = corpus_pipeline.near(spark, frame, None)
    assert got.columns == ["doc_id", "text", "k"]
    assert {r.k for r in got.collect()} == stays(rows)


def test_near_copies_go(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for _ in range(25):  # chains of copies, each with a few words of the one before changed
        text = [word() for _ in range(rnd.choice((3, 60, 300)))]
        for _ in range(rnd.choice((1, 2, 8))):
            rows.append((rnd.randrange(10**6), " ".join(text)))
            text = text.copy()
            for at in rnd.sample(range(len(text)), min(len(text) // 60 * rnd.choice((1, 2)) + 1, len(text))):
                text[at] = word()
    check(spark, rows + [(None, rows[0][1]), (-3, None), (-2, ""), (-1, " \n"), (7, "A b"), (8, "a  B")])


def test_large_group(spark):
    rnd = random.Random(6)
    base = [f"w{k}" for k in range(200)]
    check(spark, [(k, " ".join(f"x{k}y{w}" if rnd.random() < 0.02 else w for w in base)) for k in range(250)])


def test_tiles_give_the_components_of_all_pairs(spark, monkeypatch):
    rnd = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join(f"x{k}y{w}" if rnd.random() < p else w for w in base)) for k in range(150) for p in [rnd.choice((0.01, 0.02, 0.04, 0.06))]]
    monkeypatch.setattr(near_dedup.links, "__defaults__", (4, 20))
    check(spark, rows)


def test_near_copies_of_the_table_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {rows[k][0] for k in stays(rows)}
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, None).collect()} == want and len(want) < len(set(t for _, t in rows))


def test_rows_that_repeat_an_id_are_decided_by_their_text(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    check(spark, [(5, a), (5, b), (2, b)])


def plain_fingerprint(found):
    """By one bit of one shingle at a time."""
    m, counts = (1 << 64) - 1, [0] * 192
    for x in map(int, found):
        for w, (flip, times) in enumerate(zip(map(int, near_dedup._FLIP[:3]), map(int, near_dedup._TIMES[:3]), strict=True)):
            h = (x ^ flip) * times & m
            h = (h ^ h >> 32) * times & m
            h ^= h >> 29
            for k in range(64):
                counts[64 * w + k] += h >> k & 1
    return sum(1 << k for k, c in enumerate(counts) if 2 * c > len(found))


def test_fingerprints_are_majorities_of_bits():
    for n in (0, 1, 4, 5, 6, 300):
        found = near_dedup.shingles(" ".join(f"w{k}" for k in range(n + 4 if n else 0)))
        assert found.size == n
        got = near_dedup.fingerprints(found)
        want = [plain_fingerprint(found)] + [plain_fingerprint([*found[:k], *found[k + 1 :]]) for k in range(5) if n == 5]
        assert [int.from_bytes(got[at : at + 24], "little") for at in range(0, len(got), 24)] == want


def test_covering_masks_find_every_pair_within_35_bits(spark):
    rnd = random.Random(9)
    prints = []
    for _ in range(60):
        prints.append(rnd.getrandbits(192))
        for bits in (1, 20, 35, 35, 35, 54, 60):
            prints.append(prints[-1 if rnd.random() < 0.2 else len(prints) // 8 * 8] ^ sum(1 << k for k in rnd.sample(range(192), bits)))
    nodes = spark.createDataFrame([(k, x.to_bytes(24, "little")) for k, x in enumerate(prints)], "node long, prints binary").repartition(3)
    buckets = {}
    for r in near_dedup.candidates(nodes).collect():
        buckets.setdefault(r.k, set()).add(r.node)
    apart = lambda a, b: (prints[a] ^ prints[b]).bit_count()
    met = {(a, b) for own in buckets.values() for a in own for b in own if a < b}
    within = {(a, b) for b in range(len(prints)) for a in range(b) if apart(a, b) <= 35}
    assert len(within) > 200 and within <= met
    for own in buckets.values():  # each is one chain
        seen, todo = set(), [min(own)]
        while todo:
            seen.add(x := todo.pop())
            todo += [y for y in own - seen if apart(x, y) <= near_dedup.REACH]
        assert seen == own and len(own) > 1


def test_four_shingles_within_five(spark):
    rnd = random.Random(10)
    rows = []
    for k in range(300):
        words = [f"{k}x{rnd.random()}" for _ in range(9)]
        rows += [(2 * k, " ".join(words[1:] if k % 2 else words[:-1])), (2 * k + 1, " ".join(words))]
    check(spark, rows)
