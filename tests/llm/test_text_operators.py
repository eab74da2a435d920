"""Token counts, quality rules, page text, tree BPE and substring dedup against brute force, and their defined cases."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from rowkin.llm import html_text, quality, substring_dedup, token_counts, tree_bpe

SCHEMA = "doc_id long, text string, ids string, n_tokens long"
ODD = [None, "", " \n\t", "a", "🙂🙂 é ß", "x" * 3000, "ab " * 400, "naïve café — “quoted”…", "\x0b\x1c \x85 nbsp\xa0x", "don't you'll   go\n\n\n", "0123456789 " * 30, "same words here again " * 12]


@pytest.fixture(scope="module")
def sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text", "lang AS ids", "n_chars AS n_tokens")
    extra = spark.createDataFrame([(10_000 + k // 2, t, None, None) for k, t in enumerate([x for x in ODD for _ in (0, 1)])] + [(None, "null id", None, None)], SCHEMA)
    return docs.unionByName(extra).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_tree_bpe(sample, empty):
    import tiktoken

    bpe = tree_bpe.TreeBPE(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    known = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    got = tree_bpe.digests(sample).collect()
    assert len(got) == sample.count()
    want = {}
    for r in sample.collect():
        ids = known.encode_ordinary(r.text or "")
        want[r.doc_id] = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id] for r in got)
    texts = {r.doc_id: r.text or "" for r in sample.collect()}
    assert all(bytes(r.data).decode() == texts[r.doc_id] for r in tree_bpe.decode(tree_bpe.encode(sample)).collect())
    assert tree_bpe.digests(empty).count() == 0


@pytest.mark.parametrize("leaf", [1, 3, 24])
def test_joins_of_long_pretokens(leaf):
    bpe = tree_bpe.TreeBPE(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), leaf)
    rnd = random.Random(leaf)
    for _ in range(400):
        data = "".join(rnd.choice(("a", "e", "er", "the", "ing", "x", "=", "é", "11")) for _ in range(rnd.randrange(1, 150))).encode()
        assert bpe.encode_bytes(data) == bpe.merge(data)
    long = b"ab" * 700 + b"x" * 500
    assert bpe.encode_bytes(long) == bpe.merge(long) == bpe._merge_long(long)
    assert bpe.decode(bpe.encode_bytes(long)) == long


def best_count(trie, word):
    """Plain forward pass over one pre-token."""
    best = [(0.0, 0)]
    for d in range(1, len(word) + 1):
        c = word[d - 1]
        size = 1 if c in trie.score else len(c.encode())
        options = [(best[d - 1][0] + (trie.score[c] if c in trie.score else size * trie.byte), best[d - 1][1] - size)]
        options += [(best[d - k][0] + trie.score[word[d - k : d]], best[d - k][1] - 1) for k in range(2, d + 1) if word[d - k : d] in trie.score]
        best.append(max(options))
    return -best[-1][1]


def test_token_counts(sample, empty):
    trie = token_counts.Trie(token_counts.pieces_of(public_tokenizers.path("piece_bpe_32k.model")), nodes=3000)
    known = {}
    got = {r.doc_id: r for r in token_counts.token_counts(sample).collect()}
    for r in sample.collect():
        words = re.findall("[^\x20\x09-\x0d]+", r.text or "")
        for w in words:
            if w not in known:
                known[w] = best_count(trie, token_counts.MARK + w)
        want = sum(known[w] for w in words), len(words)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_pretokens) == want == trie.counts([r.text])[0]
    assert token_counts.token_counts(empty).count() == 0


def test_quality_measures(sample, empty):
    got = {r.doc_id: r for r in quality.judge(sample).collect()}
    for r in sample.collect():
        words, lines = re.findall("[^\x20\x09-\x0d]+", r.text or ""), [x for x in (r.text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        at = defaultdict(list)
        for k in range(len(words) - 7):
            at[tuple(words[k : k + 8])].append(k)
        covered = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
        want = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(covered)
        q = got[r.doc_id]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == want
        assert q.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (q.base_failed and q.kept)
    assert quality.judge(empty).count() == 0


def test_quality_keeps_good_and_drops_bad(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "label")
    rows = quality.op5_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").filter("NOT base_failed").collect()
    good, bad = ([r.kept for r in rows if r.label == y] for y in (1, 0))
    assert sum(good) > 0.98 * len(good) and sum(bad) < 0.1 * len(bad)


def test_estimate_recovers_known_accuracies():
    rnd, counts = random.Random(1), defaultdict(int)
    m = len(quality.RULES)
    for _ in range(20_000):
        good = rnd.random() < 0.8
        counts[tuple(0 if rnd.random() < 0.1 else (1 if rnd.random() < 0.97 else -1) if good else (-1 if rnd.random() < 0.6 else 1) for _ in range(m))] += 1
    prior, right, wrong = quality.estimate(counts)
    assert abs(prior - 0.8) < 0.02 and all(abs(a - 0.97) < 0.02 for a in right) and all(abs(b - 0.6) < 0.04 for b in wrong)
    assert quality.estimate({})[0] == quality.START_PRIOR


PAGE = '<html><head><title>T &amp; t</title><style>p{}</style></head><body><nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- <p>no</p> --><article class="x"><h1>Head</h1><p>One&nbsp;two <b>three<br>four<p>Five &lt;six&gt; <script>var a="</p>";</script> seven</p></article><footer>&copy; me</footer>'


def test_blocks():
    found = [(b.path.tag, b.text) for b in html_text.blocks_of(PAGE)]
    assert found == [("title", "T & t"), ("li", "Home"), ("h1", "Head"), ("p", "One two three four"), ("p", "Five <six> seven"), ("footer", "© me")]
    assert html_text.blocks_of(None) == html_text.blocks_of("") == html_text.blocks_of("<div><!-- open") == []
    assert [b.text for b in html_text.blocks_of("a < b <p x='>'>c</p")] == ["a < b", "c"]


def test_gradients_against_differences():
    rnd = np.random.default_rng(0)
    model = html_text.Labeller(5, 3)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    pages, labels = [rnd.standard_normal((n, 5)) for n in (4, 1, 7)], [rnd.integers(0, 2, n) for n in (4, 1, 7)]
    _, found = model.gradients(pages, labels)
    for name, w in model.weights.items():
        for at in [tuple(rnd.integers(0, s) for s in w.shape) for _ in range(4)]:
            sides = []
            for step in (1e-2, -1e-2):
                w[at] += step
                sides.append(model.gradients(pages, labels)[0])
                w[at] -= step
            assert abs((sides[0] - sides[1]) / 2e-2 - found[name][at]) < 1e-3, name


def right_share(labeller, pages, labels):
    """Share of blocks that are labelled right."""
    scores = labeller.scores(html_text.vectors([html_text.blocks_of(p) for p in pages]))
    wrong = sum(int(((s >= 0.5) != (np.array(y) > 0)).sum()) for s, y in zip(scores, labels, strict=True))
    return 1 - wrong / sum(map(len, labels))


def test_main_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    held = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").orderBy("page_id").limit(150).collect()]
    labeller = html_text.fitted(pages)
    odd = spark.createDataFrame([(-1, None, None, "x"), (-2, "u", "", None), (None, "u", PAGE, None)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.main_text(pages.unionByName(odd, allowMissingColumns=True), labeller).collect()}
    right = 0
    for r in pages.collect():
        blocks = html_text.blocks_of(r.html)
        right += got[r.page_id].text == "\n".join(b.text for b, y in zip(blocks, html_text.own_labels(blocks), strict=True) if y)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)
    assert right >= 0.99 * pages.count() and got[-1].text == got[-2].text == "" and "Five <six> seven" in got[None].text
    # pages that say nothing about their parts: the truth is that of the page they come from
    labels = [html_text.own_labels(html_text.blocks_of(p)) for p in held]
    unnamed = [re.sub(r"(</?)(article|main|nav|header|footer|aside)\b", r"\1div", p) for p in held]
    remarks = '<div class="discussion"><p>Nice one, thanks.</p><p>I do not agree with this at all.</p></div>'
    with_remarks = [p.replace("</article>", "</article>" + remarks) for p in held]
    more = [np.concatenate([y[:-1], [0, 0], y[-1:]]) for y in labels]
    assert right_share(labeller, unnamed, labels) > 0.97 and right_share(labeller, [re.sub(' class="?[a-z]+"?', "", p) for p in unnamed], labels) > 0.97
    assert right_share(labeller, with_remarks, more) > 0.97
    made = html_text.layouts([[b.text for b, y in zip(html_text.blocks_of(p), own, strict=True) if y] for p, own in zip(held[:30], labels, strict=False)], random.Random(5), 200)
    assert right_share(labeller, [p for p, _ in made], [y for _, y in made]) > 0.97
    plain = "<html><body><div>A headline of a few words</div><div>First paragraph, which says something about a town by the sea.</div><div>Second paragraph that goes on and on, with more words.</div></body></html>"
    assert html_text.extract([plain], labeller)[0].count("\n") >= 1
    assert html_text.main_text(pages.limit(0), labeller).count() == 0 and html_text.sample_of(pages.limit(0)) == []


def test_rolling_hash_and_chunks():
    data = np.frombuffer(bytes(random.Random(1).randrange(256) for _ in range(500)), np.uint8)
    h = substring_dedup.gear_hash(data)
    state = 0
    for k, byte in enumerate(data):
        state = (state << 1) + int(substring_dedup.GEAR[byte]) & 0xFFFF
        assert h[k] == state
    texts = [t.encode() for t in ("", "é" * 300, "a b  c", "x" * 5000, " ".join(str(k * k) for k in range(900)))]
    which, start, end, n, _ = substring_dedup.chunks_of(texts)
    for k, t in enumerate(texts):
        own = which == k
        assert n[own].sum() == len(t.decode().split()) and (end[own].max() if own.any() else 0) == len(t.decode())
        assert (start[own][1:] == end[own][:-1]).all()


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rnd.randrange(2, 9))) for _ in range(n))


def test_repeated_passages(spark, empty):
    rnd = random.Random(3)
    passage, line = words(rnd, 55), words(rnd, 8)
    docs = [(k, f"{words(rnd, rnd.randrange(20, 200))} {passage if k % 3 == 0 else ''} {words(rnd, 30)} {line}", None, None) for k in range(60)]
    frame = spark.createDataFrame(docs + [(None, None, None, None), (100, "", None, None), (7, docs[7][1], None, None)], SCHEMA).repartition(4)
    got = substring_dedup.repeated_passages(frame).collect()
    assert {r.doc_id for r in got} == set(range(0, 60, 3))
    for r in got:
        found = docs[r.doc_id][1][r.start : r.end]
        assert found in f" {passage} " and substring_dedup.WORDS <= r.n_words <= 56 and r.keep_doc_id == 0 and r.kept == (r.doc_id == 0)
    assert substring_dedup.repeated_passages(empty).count() == 0


def test_copies_that_share_a_phrase_with_an_earlier_document(spark):
    rnd = random.Random(11)
    phrase, text, other = words(rnd, 15), [words(rnd, 90) for _ in range(3)], words(rnd, 80)
    whole = f"{text[0]} {phrase} {text[1]}"
    docs = {1: f"{words(rnd, 40)} {phrase} {words(rnd, 40)}", 2: f"{words(rnd, 30)} {other} {words(rnd, 30)}", 5: whole, 9: whole, 12: f"{other} {text[2]}", 14: f"{other} {text[2]}"}
    got = substring_dedup.repeated_passages(spark.createDataFrame([(k, t, None, None) for k, t in docs.items()], SCHEMA)).collect()
    of = lambda k: sorted((r.start, r.end, r.keep_doc_id, r.kept) for r in got if r.doc_id == k)
    assert of(5) == [(0, len(whole), 5, True)]
    assert of(9)[0][0] == 0 and of(9)[-1][1] == len(whole) and not any(kept for *_, kept in of(9)) and {k for *_, k, _ in of(9)} <= {1, 5}
    assert sum(b - a for a, b, k, _ in of(9) if k == 5) > len(text[0]) + len(text[1]) - 100
    assert {(k, kept) for *_, k, kept in of(12)} == {(2, False), (12, True)} and {(k, kept) for *_, k, kept in of(14)} == {(2, False), (12, False)}
    assert all(docs[r.doc_id][r.start : r.end] in docs[r.keep_doc_id] for r in got)
