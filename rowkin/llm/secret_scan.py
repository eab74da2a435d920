"""Secret scans with multipart credential linking. DataFrame functions only.

Strong kinds (assign, access, hex) are always reported. Weak candidates are parts of a credential that mean little alone: ``login`` (an access
identifier), ``phrase`` (a secret under a loose name) and ``endpoint`` (an address). Candidates, strong ones included, become intervals, one row each. Two intervals are in
one scope where at most ``SCOPE`` code points lie between the end of one and the start of the other, however long they are. An interval join over each document, by the furthest end
of each part so far and the nearest start of each part to come, tells which complementary parts are in a candidate's scope: a phrase is reported beside an identifier or
endpoint, a login or endpoint beside a secret. Only documents that hold complementary parts at all take part in that join; all others are decided where they are read, without a shuffle.

Spans count code points, the end exclusive. Matches are leftmost and do not overlap within a kind; their places come from the lengths of the matches and of the pieces between
them, summed by blocks, so that the work grows with the number of matches.

Defined cases: a null text counts as empty (``redact`` leaves it null); empty tables give empty results; rows that repeat id and text get the same
spans; a null id is carried; bytes that are no UTF-8 count as the replacement characters they decode to. All columns of the input are kept apart from the working columns, so their names cannot clash.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkin.llm._common import table

SCOPE = 256
MARK = "[SECRET]"
_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = rf"(?i:(password|passwd|secret|token|api_?key)){_VALUE}([A-Za-z0-9+/_.=-]+)"
#: Kind, pattern, part. A pattern with a repeat from a least number finds the same matches as one from 1 whose short matches are dropped.
STRONG = (("assign", ASSIGN, "secret"), ("access", r"AKIA[A-Z0-9]{16,}", "identifier"), ("hex", r"[0-9a-f]{24,}", "secret"))
WEAK = (
    ("login", rf"(?i:user_?name|user_?id|user|login|account|client_?id|key_?id){_VALUE}[A-Za-z0-9@._-]{{3,}}", "identifier"),
    ("phrase", rf"(?i:passphrase|passcode|pass|pwd|credential|private_?key){_VALUE}[^\x20\x09-\x0D\"'<>]{{4,}}", "secret"),
    ("endpoint", r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x20\x09-\x0D\"'<>]+|(?i:hostname|host|endpoint|server)" + _VALUE + r"[A-Za-z0-9.:_-]{3,}", "endpoint"),
)
#: Substrings of which any match of a kind has one; looking for them first is far cheaper than the pattern.
NEEDED = {"assign": (":", "="), "access": ("AKIA",), "login": (":", "="), "phrase": (":", "="), "endpoint": (":", "=")}
KINDS = {kind: k for k, (kind, _, _) in enumerate(STRONG + WEAK)}
_SPANS = "array<struct<start:int,k:int,end:int>>"
#: Elements whose running sums or maxima are taken one by one.
BLOCK = 128


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, merge, zero: Column) -> Column:
    """The values merged from the first up to each element, by blocks: time grows with the number of values, not with its square."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda j: F.aggregate(F.slice(values, j * BLOCK + 1, BLOCK), zero, merge))
    before = F.aggregate(blocks, F.array(zero), lambda done, x: F.concat(done, F.array(merge(F.element_at(done, -1), x))))
    each = lambda heads: F.transform(values, lambda v, i: F.aggregate(F.slice(values, i - i % BLOCK + 1, i % BLOCK + 1), F.get(heads, F.floor(i / BLOCK).cast("int")), merge))
    return F.when(F.size(values) == 0, values).otherwise(_let(before, each))


def _found(text: Column, kind: str, pattern: str) -> Column:
    """The spans of a pattern's matches in ``text``: struct(start, k, end), in order; empty where nothing matches."""
    matches, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    sizes = F.zip_with(matches, F.slice(between, 1, F.size(matches)), lambda m, gap: F.struct(F.length(m).alias("m"), (F.length(gap) + F.length(m)).alias("step"), m.alias("text")))
    good = lambda z: F.length(F.regexp_extract(z["text"], ASSIGN, 2)) >= 6 if kind == "assign" else F.lit(True)
    span = lambda z, end: F.struct((end - z["m"]).alias("start"), F.lit(KINDS[kind]).alias("k"), end.alias("end"), good(z).alias("good"))
    placed = lambda z: F.zip_with(z, _let(F.transform(z, lambda x: x["step"]), lambda steps: _running(steps, lambda a, b: a + b, F.lit(0))), span)
    found = F.transform(F.filter(_let(sizes, placed), lambda x: x["good"]), lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end")))
    likely = reduce(or_, (F.contains(text, F.lit(x)) for x in NEEDED[kind])) if kind in NEEDED else F.lit(True)
    return F.when(likely & text.rlike(pattern), found).otherwise(F.array().cast(_SPANS))


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """(r, t, spans): the input row as a struct, its text (null: empty), and its spans by start, then kind: array of struct(start, k, end)."""
    text = F.coalesce(F.col(f"r.{text_col}"), F.lit(""))
    rows = docs.select(F.struct("*").alias("r")).withColumn("t", text)
    rows = rows.withColumns({kind: _found(F.col("t"), kind, p) for kind, p, _ in STRONG + WEAK})
    any_of = lambda part, kinds: F.greatest(F.lit(0), *(F.size(kind) for kind, _, p in kinds if p == part)) > 0
    strong = F.concat(*(F.col(kind) for kind, _, _ in STRONG))
    apart = (any_of("secret", WEAK) & (any_of("identifier", STRONG + WEAK) | any_of("endpoint", WEAK))) | ((any_of("identifier", WEAK) | any_of("endpoint", WEAK)) & any_of("secret", STRONG + WEAK))
    rows = rows.withColumn("apart", apart)
    simple = rows.filter(~F.col("apart")).select("r", "t", F.array_sort(strong).alias("spans"))

    rest = rows.filter("apart").withColumns({"i": F.col(f"r.{id_col}").cast("string"), "s": F.sha2("t", 256)})
    part_of = F.element_at(F.array(*(F.lit(p) for _, _, p in STRONG + WEAK)), F.col("x.k") + 1)
    each = rest.select("i", "s", F.explode(F.concat(*(F.col(kind) for kind in KINDS))).alias("x")).distinct().select("i", "s", "x", part_of.alias("p"), F.col("x.start").alias("a"), F.col("x.end").alias("b"))
    row, parts = Window.partitionBy("i", "s"), ("identifier", "secret", "endpoint")
    # running values from the first interval on, and from the last one back; intervals of equal start see each other
    seen = each.withColumns({f"end_{p}": F.max(F.when(F.col("p") == p, F.col("b"))).over(row.orderBy("a").rangeBetween(Window.unboundedPreceding, 0)) for p in parts})
    seen = seen.withColumns({f"start_{p}": F.min(F.when(F.col("p") == p, F.col("a"))).over(row.orderBy(F.desc("a")).rangeBetween(Window.unboundedPreceding, 0)) for p in parts})
    near = lambda p: F.coalesce(F.col(f"end_{p}") >= F.col("a") - scope, F.lit(False)) | F.coalesce(F.col(f"start_{p}") <= F.col("b") + scope, F.lit(False))
    seen = seen.withColumns({f"is_{p}": near(p) for p in parts})
    linked = seen.filter((F.col("x.k") < len(STRONG)) | F.when(F.col("p") == "secret", F.col("is_identifier") | F.col("is_endpoint")).otherwise(F.col("is_secret")))
    spans = linked.groupBy("i", "s").agg(F.array_sort(F.collect_list("x")).alias("found"))
    joined = rest.join(spans.select(F.col("i").alias("j"), F.col("s").alias("z"), "found"), F.col("i").eqNullSafe(F.col("j")) & (F.col("s") == F.col("z")), "left")
    return simple.unionByName(joined.select("r", "t", F.coalesce("found", F.array().cast(_SPANS)).alias("spans")))


def _named(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["start"], x["end"])), ",")


def redact(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mark`` (overlapping spans by one); ``n_chars``, if there, counts the new text."""
    text, spans = F.col("t"), F.col("spans")
    # four bytes a code point: pieces are cut out by place without walking the text
    piece = lambda wide, a, size: F.decode(F.substring(wide, 4 * a + 1, 4 * size), "UTF-32")

    def cleaned(wide: Column) -> Column:
        """The text with a mark for each span that begins behind all spans before it."""

        def joined(ends: Column) -> Column:
            done = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
            parts = F.transform(spans, lambda x, i: F.when(x["start"] >= done(i), F.concat(piece(wide, done(i), x["start"] - done(i)), F.lit(mark))).otherwise(F.lit("")))
            return F.concat(F.array_join(parts, ""), piece(wide, F.element_at(ends, -1), F.length(text)))

        return _let(_let(F.transform(spans, lambda x: x["end"]), lambda ends: _running(ends, lambda a, b: F.greatest(a, b), F.lit(0))), joined)

    found = scan(docs).withColumn("c", F.when(F.size(spans) > 0, _let(F.encode(text, "UTF-32"), cleaned)).otherwise(F.col("r.text")))
    new = {"text": F.col("c")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size(spans) > 0, F.length("c").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("r.n_chars"))
    return found.select(*(new.get(c, F.col(f"r.{c}")).alias(c) for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs.select("doc_id", "text"))
    count = [F.expr(f"size(filter(spans, x -> x.k = {KINDS[kind]}))").cast("long").alias(f"n_{kind}") for kind, _, _ in STRONG]
    base = _named(F.filter("spans", lambda x: x["k"] < len(STRONG)))
    return found.select(F.col("r.doc_id").alias("doc_id"), *count, F.sha2(base, 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"))


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The report as SQL: places from the pieces between matches, scopes by the furthest end before and the nearest start behind."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    parts = ", ".join(f"({KINDS[kind]}, '{kind}', '{part}', {quoted(pattern)})" for kind, pattern, part in STRONG + WEAK)
    found = " UNION ALL ".join(
        f"SELECT doc_id, {KINDS[kind]} AS k, regexp_extract_all(t, {quoted(p)}) AS ms, string_split_regex(t, {quoted(p)}) AS ps FROM d WHERE regexp_matches(t, {quoted(p)})" for kind, p, _ in STRONG + WEAK
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), kinds(k, kind, part, pattern) AS (VALUES {parts}), f AS ({found}),
e AS (SELECT doc_id, k, ms[j] AS m, CAST(list_sum(list_transform(ps[:j], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[:j - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS j FROM f)),
g AS (SELECT doc_id, k, kind, part, a, a + length(m) AS b FROM e JOIN kinds USING (k) WHERE k <> 0 OR length(regexp_extract(m, {quoted(ASSIGN)}, 2)) >= 6),
n AS (SELECT *, {", ".join(f"coalesce(max(b) FILTER (part = '{p}') OVER u >= a - {SCOPE}, false) OR coalesce(min(a) FILTER (part = '{p}') OVER w <= b + {SCOPE}, false) AS is_{p}" for p in ("identifier", "secret", "endpoint"))} FROM g
 WINDOW u AS (PARTITION BY doc_id ORDER BY a RANGE UNBOUNDED PRECEDING), w AS (PARTITION BY doc_id ORDER BY a RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
r AS (SELECT *, kind || ':' || a || ':' || b AS s FROM n WHERE k < {len(STRONG)} OR (part = 'secret' AND (is_identifier OR is_endpoint)) OR (part <> 'secret' AND is_secret)),
o AS (SELECT doc_id, {", ".join(f"count(*) FILTER (k = {KINDS[kind]}) AS n_{kind}" for kind, _, _ in STRONG)}, string_agg(s, ',' ORDER BY a, k) FILTER (k < {len(STRONG)}) AS base, string_agg(s, ',' ORDER BY a, k) AS spans FROM r GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, _, _ in STRONG)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o ON d.doc_id = o.doc_id
"""


SQL = _sql()
