"""The whole pipeline against a plain version of every stage."""

import random
import re
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from test_near_dedup import stays

import corpus_pipeline
from rowkin.llm import langid, secret_scan


def grams(text):
    squeezed = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in f" {text.lower()} "))
    return [squeezed[k : k + langid.N] for k in range(len(squeezed) - langid.N + 1)]


def in_known_language(rows, held):
    """By exact sets of n-grams instead of filters."""
    seen = defaultdict(Counter)
    for i, text, lang in rows:
        if text is not None and lang is not None and i not in held:
            seen[lang].update(grams(text))
    rate = {}
    for x, c in seen.items():
        total = sum(c.values())
        rate[x] = {g: n / total for g, n in c.items()}
    top = Counter()
    for r in rate.values():
        for g, v in r.items():
            top[g] = max(top[g], v)
    sets = {x: {g for g, n in c.items() if n >= langid.LEAST_SEEN and rate[x][g] >= langid.SHARE * top[g]} for x, c in seen.items()}
    kept = []
    for row in rows:
        found = grams(row[1] or "")
        if any(c.isalpha() for c in row[1] or "") and (len(found) < langid.LEAST_GRAMS or max(sum(g in s for g in found) for s in sets.values()) >= langid.LEAST_SCORE * len(found)):
            kept.append(row)
    return kept


def redacted(text):
    found = [(m.start(), k, m.end(), part) for k, (kind, p, part) in enumerate(secret_scan.STRONG + secret_scan.WEAK) for m in re.finditer(p, text, re.ASCII) if kind != "assign" or len(m[2]) >= 6]
    near = lambda x, *parts: any(y[3] in parts and y[0] - x[2] <= secret_scan.SCOPE and x[0] - y[2] <= secret_scan.SCOPE for y in found)
    out, done = "", 0
    for x in sorted(found):
        if x[1] < len(secret_scan.STRONG) or (near(x, "identifier", "endpoint") if x[3] == "secret" else near(x, "secret")):
            if x[0] >= done:
                out += text[done : x[0]] + secret_scan.MARK
            done = max(done, x[2])
    return out + text[done:]


def test_stages_and_result(spark, tmp_path):
    from tokenizers import Tokenizer

    rnd = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    given = docs.orderBy("doc_id").collect()
    prose = max((r.text for r in given if r.lang == "en"), key=lambda t: len(t) < 4000 and len(t))
    foreign = " ".join("".join(rnd.choice("абвгдежзиклмнопрстуфхц") for _ in range(6)) for _ in range(80))
    mixed = lambda: " ".join(rnd.sample(prose.split(), min(120, len(prose.split()))))  # noqa: E731  # no near copy of anything
    texts = [foreign, None, "", "12 34", "A.", given[3].text, given[3].text, prose + " and one more", f"{mixed()}\nuser: anna pwd: hunter2", f"token=abcdef99 {mixed()} user: bob", f"https://db.example.com/x pwd: hunter2 {mixed()}", f"user: bob {mixed()}"]
    extra = [(10_000 + k, t, None, None, None) for k, t in enumerate(texts)] + [(None, given[9].text[::-1] + given[9].text, None, None, None)]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(*columns).unionByName(spark.createDataFrame(extra, docs.select(*columns).schema)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    every = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("held", langid.held_out(F.col("doc_id"))).collect()
    rows = in_known_language([(r.doc_id, r.text, r.lang) for r in every], {r.doc_id for r in every if r.held})
    assert 10_000 not in {i for i, _, _ in rows} and len(rows) >= len(given)
    last = {}
    for i, text, _ in rows:
        if text not in last or i is not None and (last[text] is None or i > last[text]):
            last[text] = i
    rows = [(i, text) for text, i in last.items()]
    places = stays(rows)
    rows = {rows[k][0]: redacted(rows[k][1]) for k in places}
    assert sum(secret_scan.MARK in t for t in rows.values()) >= 3

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows.items()}
    out = corpus_pipeline.run(spark, str(tmp_path), f"{tmp_path}/stages").collect()
    assert {r.doc_id: r.doc_tokens for r in out} == want
    for i, n in want.items():
        assert sum(r.length for r in out if r.doc_id == i) == n
