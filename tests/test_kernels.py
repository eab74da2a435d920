"""String kernels, romanisation and word operators against hand values and plain definitions."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from rowkin.functions import scripts, strings
from rowkin.operators import normalize


def plain_lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


def test_lcs_against_the_dynamic_programme():
    rnd = random.Random(0)
    for _ in range(500):
        a, b = ("".join(rnd.choices("abcé ", k=rnd.randrange(0, 80))) for _ in range(2))
        assert strings.lcs(a, b) == plain_lcs(a, b)


def test_ratios():
    assert strings.ratio("", "") == 100 and strings.ratio("a", "") == 0
    assert round(strings.ratio("blue anvil", "blue bolt"), 4) == 63.1579
    assert strings.token_sort_ratio("b a", "a b") == 100 and strings.token_set_ratio("a b", "b a c") == 100
    assert strings.token_set_ratio("", "") == strings.token_set_ratio("a", "") == 0
    assert round(strings.token_set_ratio("fuzzy was a bear", "wuzzy was a bear"), 4) == 93.75  # "a bear was" before both remainders
    assert strings.partial_ratio("abc", "xxabcxx") == 100 and strings.partial_ratio("", "a") == 0 and strings.partial_ratio("", "") == 100
    assert round(strings.jaro_winkler("martha", "marhta"), 6) == 0.961111 and strings.jaro_winkler("", "") == 1 and strings.jaro_winkler("a", "") == 0


def test_partial_ratio_against_all_windows():
    rnd = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rnd.choices("abcd", k=rnd.randrange(1, 12))) for _ in range(2))

        def best(short, long):
            return max(strings.ratio(short, long[max(0, e - len(short)) : e]) for e in range(1, len(long) + len(short)))

        want = best(a, b) if len(a) < len(b) else best(b, a) if len(b) < len(a) else max(best(a, b), best(b, a))
        assert abs(strings.partial_ratio(a, b) - want) < 1e-9


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("राम", "rama"),  # Devanagari: the last vowel stays, m has no vowel mark
        ("दिल्ली", "dilli"),  # virama joins
        ("কলকাতা", "kalakata"),  # Bengali
        ("ਪੰਜਾਬ", "pamjaba"),  # Gurmukhi
        ("தமிழ்", "tamil"),  # Tamil
        ("shop दो", "sop do"),  # mixed words
        ("१२", "12"),  # digits
        ("සිංහල", "සිංහල"),  # a script without an entry passes
    ],
)
def test_romanise(text, want):
    assert scripts.romanise(text) == want


def test_normalise(spark):
    rows = [
        ("S1-1", "The Ünïted & Sons Pvt. Ltd", "0012 West Virginia Street, New  York", "US"),
        ("S2-1", "united-sons.com", None, "US"),
        ("S3-7", "L L C", "HNo 007 Rue", "France"),
        ("S3-8", "दिल्ली Traders", "000", "India"),
        (None, None, None, None),
    ]
    got = {r.entity_id: r for r in normalize.normalise(spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")).collect()}
    a = got["S1-1"]
    assert (a.nn, a.nc, a.nsp, a.init, a.src) == ("the united and sons pvt ltd", "united sons", "unitedsons", "us", 1)
    assert a.an == "12 w va st ny" and a.nums == ["12"] and not a.is_domain
    assert got["S2-1"].is_domain and got["S2-1"].nn == "united sons" and got["S2-1"].addr_empty
    assert got["S3-7"].nc == "" and got["S3-7"].init == "" and got["S3-7"].an == "h no 7 r"
    assert got["S3-8"].nonlatin and got["S3-8"].nn == "dilli traders" and got["S3-8"].ncc == "dilli" and got["S3-8"].an == "0"
    assert got[None].nn == "" and got[None].nums == []


def test_phrases_meet_neighbours(spark):
    df = spark.createDataFrame([("new york new york",), ("newyork",), ("",)], "t string")
    assert [r[0] for r in df.select(normalize.with_phrases(F.col("t"), {"new york": "ny"})).collect()] == ["ny ny", "newyork", ""]


def test_decompose(spark):
    texts = ["½ ﬁ ²", "Ångström", None, "plain"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scripts.decompose("t")).collect()]
    assert got == [unicodedata.normalize("NFKD", t) if t else t for t in texts]
