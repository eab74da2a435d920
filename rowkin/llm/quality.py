"""Quality rules combined by weak supervision. DataFrame functions only.

Every rule votes good (1) or bad (-1) on a document or abstains (0). Expectation-maximisation over the counts of vote patterns estimates, for each
rule, how often its votes are right on good and on bad documents, and the share of good documents; a document's posterior probability to be good
then decides, instead of an all-must-pass filter. There are at most 3^8 patterns, so the counts that reach the driver are bounded whatever the input.

Repeated windows are found within each row: hashes (XXH64) of all 8-word windows are compared, and only rows with a repeated hash sort them with their
places. Within one text two different windows share a hash with a probability below 1e-9 even at 100,000 words.

Defined cases: a null text has no words; fewer than ``MIN_WORDS`` words fail the base rules; nulls in other columns are ignored and ids carried; repeated rows
are judged alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkin.llm._common import cut, table

MIN_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30  # words, words, per cent of the words
SPACE, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Rule: (value, bad if above, good if at most). Between the bounds and where the value is null, a rule abstains.
RULES = (
    ("symbols", "n_symbols / n_words", 0.2, 0.05),
    ("dup_lines", "if(n_lines > 1, n_dup_lines / n_lines, null)", 0.5, 0.1),
    ("repeats", "n_repeat_words / n_words", 0.25, 0.05),
    ("shouting", "n_upper / n_words", 0.5, 0.1),
    ("word_length", "abs(word_chars / n_words - 5.5)", 6.0, 2.5),
    ("bare_symbols", "n_bare / n_words", 0.2, 0.03),
    ("odd_ends", "n_odd_ends / n_words", 0.3, 0.05),
    ("stutter", "n_stutter / n_words", 0.2, 0.02),
)
START_PRIOR, START_GOOD, START_BAD, ROUNDS = 0.8, 0.95, 0.5, 50
CLEAN, DOUBTFUL = 0.95, 0.2


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the other values that rules read.

    Every step drops what the next does not need, since arrays are copied from step to step.
    """
    long = lambda c: c.cast("long")
    count = lambda pattern: F.regexp_count("t", F.lit(pattern))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    rows = rows.select(
        "doc_id",
        F.filter(F.split("t", f"{SPACE}+", -1), lambda x: x != "").alias("w"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD)).alias("l"),
        count("[#*$%&|<>]").alias("n_symbols"),
        count(r"\p{Lu}{2,}").alias("n_upper"),
        count(rf"(?<!{WORD})[^\p{{L}}\p{{N}}\x20\x09-\x0D]+(?!{WORD})").alias("n_bare"),
        count(rf"[^\p{{L}}\p{{N}}.,;:!?)\"'\x20\x09-\x0D](?!{WORD})").alias("n_odd_ends"),
    )
    counted = ["n_symbols", "n_upper", "n_bare", "n_odd_ends"]
    rows = rows.select(
        "doc_id",
        *(long(F.col(c)).alias(c) for c in counted),
        long(F.size("w")).alias("n_words"),
        long(F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x))).alias("word_chars"),
        long(F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        long(F.size("l")).alias("n_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("v"),
    )
    counted += ["n_words", "word_chars", "n_dup_lines", "n_lines"]
    windows = F.expr(f"transform(sequence(0, greatest(size(v) - {WINDOW}, 0)), i -> xxhash64(slice(v, i + 1, {WINDOW})))")
    rows = rows.select("doc_id", *counted, long(F.expr("size(filter(v, (x, i) -> x = get(v, i - 1)))")).alias("n_stutter"), F.when(F.size("v") >= WINDOW, windows).alias("h"))
    counted += ["n_stutter"]
    rows = rows.select("doc_id", *counted, F.when(F.size(F.array_distinct("h")) < F.size("h"), F.expr("sort_array(transform(h, (x, i) -> struct(x AS h, i AS i)))")).alias("o"))
    rows = rows.select("doc_id", *counted, F.expr("sort_array(filter(transform(o, (x, j) -> if(x.h = get(o, j - 1).h OR x.h = get(o, j + 1).h, x.i, null)), x -> x IS NOT NULL))").alias("p"))
    covered = F.expr(f"aggregate(transform(p, (x, j) -> least({WINDOW}, coalesce(get(p, j + 1) - x, {WINDOW}))), 0, (a, b) -> a + b)")
    return rows.select("doc_id", *counted, long(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"))


def votes() -> Column:
    """The rules' votes on a row of ``measures`` as an array of -1, 0, 1; all abstain on a text without words."""
    vote = [F.expr(f"CASE WHEN n_words = 0 THEN 0 WHEN {value} > {bad} THEN -1 WHEN {value} <= {good} THEN 1 ELSE 0 END") for _, value, bad, good in RULES]
    return F.array(*vote)


def estimate(counts: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, list[float], list[float]]:
    """Share of good documents, and by rule the chance that a vote is right on good and on bad documents, by expectation-maximisation.

    The first round takes a document for good with probability ``CLEAN`` if no rule votes bad, else ``DOUBTFUL``.
    """
    m = len(RULES)
    prior, good, bad = START_PRIOR, [START_GOOD] * m, [START_BAD] * m
    for k in range(rounds):
        total = weight = 0.0
        right, seen = [[0.0, 0.0] for _ in range(m)], [[0.0, 0.0] for _ in range(m)]
        for pattern, n in sorted(counts.items()):
            q = 1 / (1 + math.exp(-max(-500.0, min(500.0, log_odds(pattern, prior, good, bad))))) if k else DOUBTFUL if -1 in pattern else CLEAN
            total, weight = total + n, weight + n * q
            for j, vote in enumerate(pattern):
                if vote:
                    for side, share in ((0, n * q), (1, n * (1 - q))):
                        seen[j][side] += share
                        right[j][side] += share * (vote == (1, -1)[side])
        if not total:
            break
        # one vote is added at the start's odds, so that an estimate never becomes certain
        prior = (weight + START_PRIOR) / (total + 1)
        good = [(r[0] + START_GOOD) / (s[0] + 1) for r, s in zip(right, seen, strict=True)]
        bad = [(r[1] + START_BAD) / (s[1] + 1) for r, s in zip(right, seen, strict=True)]
    return prior, good, bad


def log_odds(pattern: tuple[int, ...], prior: float, good: list[float], bad: list[float]) -> float:
    odds = math.log(prior / (1 - prior))
    for vote, a, b in zip(pattern, good, bad, strict=True):
        if vote:
            odds += math.log(a / (1 - b)) if vote > 0 else math.log((1 - a) / b)
    return odds


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality (the posterior). Kept: at least ``least``."""
    rows = cut(measures(docs).withColumn("votes", votes()))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    counts = {tuple(r["votes"]): r["count"] for r in rows.groupBy("votes").count().collect()}
    prior, good, bad = estimate(counts)
    odds = F.lit(math.log(prior / (1 - prior)))
    for j, (a, b) in enumerate(zip(good, bad, strict=True)):
        odds = odds + F.when(F.col("votes")[j] > 0, F.lit(math.log(a / (1 - b)))).when(F.col("votes")[j] < 0, F.lit(math.log((1 - a) / b))).otherwise(F.lit(0.0))
    quality = 1 / (1 + F.exp(-odds))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(*base, failed.alias("base_failed"), (~failed & (quality >= least)).alias("kept"), F.round(quality, 6).alias("quality"))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The judgement as SQL: windows and positions as rows, expectation-maximisation as a recursive query over the vote patterns."""
    m = range(1, len(RULES) + 1)
    vote = ", ".join(f"CASE WHEN n_words = 0 THEN 0 WHEN {value} > {bad} THEN -1 WHEN {value} <= {good} THEN 1 ELSE 0 END" for _, value, bad, good in RULES)
    odds = "ln(prior / (1 - prior)) + list_sum(list_transform(range(1, len(v) + 1), lambda j: CASE v[j] WHEN 1 THEN ln(good[j] / (1 - bad[j])) WHEN -1 THEN ln((1 - good[j]) / bad[j]) ELSE 0.0 END))"
    chance = f"1 / (1 + exp(-greatest(-500.0, least(500.0, {odds}))))"
    share = lambda j, side, start, weight: f"(sum(CASE WHEN v[{j}] = {side} THEN {weight} ELSE 0 END) + {start}) / (sum(CASE WHEN v[{j}] <> 0 THEN {weight} ELSE 0 END) + 1)"
    good, bad = (", ".join(share(j, side, start, weight) for j in m) for side, start, weight in ((1, START_GOOD, "n * q"), (-1, START_BAD, "n * (1 - q)")))
    lists = lambda x: "[" + ", ".join([f"{x}::DOUBLE"] * len(RULES)) + "]"
    count = lambda p: f"len(regexp_extract_all(t, '{p}'))"
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
h AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS h FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
p AS (SELECT r, count(DISTINCT i + o)::BIGINT AS n FROM (SELECT r, i, unnest(range(0, {WINDOW})) AS o FROM (SELECT *, count(*) OVER (PARTITION BY r, h) AS c FROM h) WHERE c > 1) GROUP BY r),
m AS (SELECT w.r, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, {count("[#*$%&|<>]")} AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, len(l) AS n_lines,
 {count(r"\p{Lu}{2,}")} AS n_upper, len(list_filter(w, lambda x: NOT regexp_matches(x, '[\p{{L}}\p{{N}}]'))) AS n_bare, len(list_filter(w, lambda x: regexp_matches(x, '[^\p{{L}}\p{{N}}.,;:!?)"'']$'))) AS n_odd_ends, len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS n_stutter FROM w LEFT JOIN p ON p.r = w.r),
votes AS (SELECT *, [{vote}] AS v FROM m), pat AS (SELECT v, count(*) AS n FROM votes GROUP BY v),
em AS (SELECT 0 AS i, {START_PRIOR}::DOUBLE AS prior, {lists(START_GOOD)} AS good, {lists(START_BAD)} AS bad
 UNION ALL SELECT i + 1, (sum(n * q) + {START_PRIOR}) / (sum(n) + 1), [{good}], [{bad}] FROM (SELECT i, v, n, CASE WHEN i > 0 THEN {chance} WHEN list_contains(v, -1) THEN {DOUBTFUL} ELSE {CLEAN} END AS q FROM em, pat WHERE i < {ROUNDS}) GROUP BY i),
j AS (SELECT votes.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, 1 / (1 + exp(-({odds}))) AS q FROM votes, em WHERE i = {ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND q >= 0.5 AS kept, round(q, 6) AS quality FROM j
"""


SQL = _sql()
