"""Every operator and stage on rows with extra columns of clashing names, nulls in every column, ties, repeated rows and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowkin.llm import exact_dedup, html_text, langid, packing, quality, secret_scan, simhash, substring_dedup, token_counts, tree_bpe

NAMES = "t h i r s x f k d w l v o p n c m q z a b u e j spans found keep_id kept group_size count word score lang_pred ids part text_sha256 votes low root component_id fingerprint first last start end run new n_words apart login phrase assign access hex".split()
TEXT = "The quick brown fox jumps over the lazy dog and runs far away from the noisy town to sleep. user: anna pwd: hunter2x token=abcdefgh"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, TEXT, "en"), (1, TEXT, "en"), (2, TEXT, None), (None, TEXT, "en"), (3, None, None), (None, None, None), (4, "", "en"), (5, TEXT + " again", "de")]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return base.withColumns({c: F.when(F.col("doc_id") != 2, F.lit(c)) for c in NAMES})


OPERATORS = {
    "langid": lambda d: langid.predict(d, langid.fit(d)),
    "packing": packing.pack,
    "simhash": simhash.simhash_groups,
    "token_counts": token_counts.token_counts,
    "quality": quality.judge,
    "secrets": secret_scan.report,
    "tree_bpe": tree_bpe.digests,
    "substring": substring_dedup.repeated_passages,
    "exact": exact_dedup.exact_groups,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator(docs, name):
    found = OPERATORS[name](docs)
    n = found.count()
    assert n == docs.count() or name in ("packing", "substring") and n >= 0
    assert OPERATORS[name](docs.limit(0)).count() == 0
    assert OPERATORS[name](docs.filter("text IS NULL")).count() == (0 if name == "substring" else 2)


@pytest.mark.parametrize("stage", range(5))
def test_stage(spark, docs, stage):
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, docs, None)
    if stage < 4:
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert 0 < out.count() <= docs.count()
    else:
        assert out.count() > 0
    assert f(spark, docs.limit(0), None).count() == 0


def test_stages_decide(spark, docs):
    kept = corpus_pipeline.exact(spark, docs, None).collect()
    assert len(kept) == 3 and {r.doc_id for r in kept} == {2, 4, 5}  # of null and empty texts the known id stays
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, None).collect()} == {1, 2, None, 5}
    assert not any("hunter2x" in (r.text or "") or "abcdefgh" in (r.text or "") for r in corpus_pipeline.secrets(spark, docs, None).collect())


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a b c</p></article>"), (1, None, None), (None, "u", "")], "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("text", "n_chars", *NAMES)})
    labeller = html_text.fit([])
    assert html_text.main_text(pages, labeller).count() == 3 and html_text.main_text(pages.limit(0), labeller).count() == 0
