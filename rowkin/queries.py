"""The linkage operators as queries on the provided tables, and the same as SQL for DuckDB. Floats are rounded to six decimals on both sides."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkin.functions.scripts import BLOCKS, INDIC, romanised
from rowkin.functions.strings import similarities
from rowkin.operators import blocking, context, decide, evaluate, features, folds, normalize, profile, tokens
from rowkin.plans import models, pipeline
from rowkin.sources import tables
from rowkin.sources.fixture import VECTORS, WITH, Records, Vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --- sources and sinks ---


@query(WITH + " SELECT s, x FROM truth")
def truth_explode(spark, sf_dir):
    return tables.truth_pairs(Records(spark, sf_dir).lists)


@query(WITH + " SELECT substring(entity_id, 2, 1) AS source, count(*) AS n FROM o GROUP BY 1")
def concat_scan(spark, sf_dir):
    r = Records(spark, sf_dir)
    two, three = (r.secondary.filter(F.col("entity_id").startswith(p)) for p in ("S2", "S3"))
    return tables.concatenated(two, three).groupBy(F.substring("entity_id", 2, 1).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT l_returnflag) AS flags FROM lineitem")
def count_scan(spark, sf_dir):
    return tables.read_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_returnflag"]).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_returnflag").alias("flags"))


@query(VECTORS + ", b AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY x ORDER BY q DESC, s) = 1), m AS (SELECT s, string_agg(CAST(x AS VARCHAR), ',' ORDER BY CAST(x AS VARCHAR)) AS ids FROM b WHERE q > 0.7 GROUP BY s) SELECT keys.s AS source1_entity_id, coalesce(ids, '') AS matched_entity_ids FROM keys LEFT JOIN m USING (s)")
def matching_output(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    picked = decide.above(decide.exclusive(v.pairs)).withColumn("x", F.col("x").cast("string"))
    return tables.id_lists(picked, v.entities.select(F.col("s").alias("entity_id")))


@query(VECTORS + ", m AS (SELECT s, string_agg(CAST(x AS VARCHAR), ',' ORDER BY CAST(x AS VARCHAR)) AS ids FROM pairs GROUP BY s) SELECT keys.s AS source1_entity_id, coalesce(ids, '') AS candidate_entity_ids FROM keys LEFT JOIN m USING (s)")
def candidate_output(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return tables.id_lists(v.pairs.withColumn("x", F.col("x").cast("string")), v.entities.select(F.col("s").alias("entity_id")), "candidate_entity_ids")


# --- normalisation ---

_CLEAN = "trim(regexp_replace(regexp_replace(replace(strip_accents(lower({c})), '&', ' and '), '[^\\p{{L}}\\p{{N}} ]', ' ', 'g'), ' +', ' ', 'g'))"


def _words(column: str) -> str:
    return f"list_filter(string_split({column}, ' '), lambda t: t <> '')"


def _listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _without(column: str, words) -> str:
    return f"array_to_string(list_filter(string_split({column}, ' '), lambda t: t <> '' AND NOT list_contains({_listed(words)}, t)), ' ')"


def _phrases(column: str, table: dict[str, str]) -> str:
    out = f"' ' || replace({column}, ' ', '  ') || ' '"
    for a, b in table.items():
        out = f"replace({out}, ' {a.replace(' ', '  ')} ', ' {b} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _mapped(column: str, table: dict[str, str]) -> str:
    entries = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in table.items()) + "}"
    return f"array_to_string(list_transform({_words(column)}, lambda t: coalesce({entries}[t], t)), ' ')"


NORM = (
    WITH
    + f""", n1 AS (SELECT *, {_CLEAN.format(c='business_name')} AS nn0, {_CLEAN.format(c='business_address')} AS a0 FROM records),
n2 AS (SELECT *, {_without('nn0', normalize.WEB_WORDS)} AS nn, {_phrases('a0', normalize.STATES)} AS a1 FROM n1),
n3 AS (SELECT *, {_mapped('a1', normalize.STREETS)} AS a2, {_phrases('nn', dict.fromkeys(normalize.LEGAL_PHRASES, ' '))} AS nc0 FROM n2),
n4 AS (SELECT *, array_to_string(list_transform({_words('a2')}, lambda t: regexp_replace(t, '^0+([0-9])', '\\1')), ' ') AS an, {_without('nc0', normalize.LEGAL_WORDS)} AS nc FROM n3),
norm AS (SELECT entity_id, business_name, business_address, country, CAST(substring(entity_id, 2, 1) AS TINYINT) AS src, nn, an, nc, replace(nc, ' ', '') AS nsp, {_without('nc', normalize.GENERIC_WORDS)} AS ncc,
 array_to_string(list_transform({_words('nc')}, lambda t: substring(t, 1, 1)), '') AS init, list_filter(regexp_extract_all(an, '[0-9]+'), lambda t, i: list_position(regexp_extract_all(an, '[0-9]+'), t) = i) AS nums,
 false AS nonlatin, business_address = '' AS addr_empty, regexp_matches(business_name, '(?i)\\.(com|in|net|org|co|fr|biz|info)([^\\p{{L}}\\p{{N}}_]|$)') AS is_domain FROM n4)"""
)


def normalised(spark, sf_dir, kept: bool = False) -> tuple[Records, DataFrame, DataFrame]:
    """The records and both sides normalised; ``kept``: once, for plans that read them several times."""
    r = Records(spark, sf_dir)
    sides = normalize.normalise(r.primary), normalize.normalise(r.secondary)
    return r, *(df.persist(StorageLevel.MEMORY_AND_DISK) if kept else df for df in sides)


@query(NORM + " SELECT entity_id, country, src, nn, an, nc, nsp, ncc, init, array_to_string(nums, ',') AS nums, nonlatin, addr_empty, is_domain FROM norm")
def normalise_records(spark, sf_dir):
    n = normalize.normalise(Records(spark, sf_dir).every)
    return n.select("entity_id", "country", "src", "nn", "an", "nc", "nsp", "ncc", "init", F.array_join("nums", ",").alias("nums"), "nonlatin", "addr_empty", "is_domain")


#: Consonants and vowels of the Latin alphabet, and the places in an Indic block of letters that are romanised to them.
_LETTERS = dict(zip("kgjtdnpbmyrlvshaiueo", (0x15, 0x17, 0x1C, 0x24, 0x26, 0x28, 0x2A, 0x2C, 0x2E, 0x2F, 0x30, 0x32, 0x35, 0x38, 0x39, 0x05, 0x07, 0x09, 0x0F, 0x13), strict=True))
_ROMAN = "regexp_replace(lower(p_name), '([kgjtdnpbmyrlvsh])', '\\1a', 'g')"
for _from, _to in (("aa", "a"), ("ii", "i"), ("uu", "u"), ("sh", "s"), ("ph", "f"), ("chh", "ch")):
    _ROMAN = f"replace({_ROMAN}, '{_from}', '{_to}')"


@query(f"SELECT p_partkey, {_ROMAN} AS name, regexp_matches(lower(p_name), '[{''.join(_LETTERS)}]') AS nonlatin FROM part")
def romanised_names(spark, sf_dir):
    """Names spelled in each of the nine scripts by key, without vowel signs, so that every consonant carries its own a."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    spelled = [F.translate(F.lower("p_name"), "".join(_LETTERS), "".join(chr(block + place) for place in _LETTERS.values())) for block in BLOCKS]
    name = F.element_at(F.array(*spelled), (F.col("p_partkey") % len(BLOCKS) + 1).cast("int"))
    return part.select("p_partkey", name.alias("n")).select("p_partkey", romanised(F.col("n")).alias("name"), F.col("n").rlike(INDIC).alias("nonlatin"))


@query(f"SELECT doc_id, {_CLEAN.format(c='text')} AS clean FROM documents")
def norm_base(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", normalize.base_clean(F.col("text")).alias("clean"))


@query("SELECT page_id, regexp_matches(url, '(?i)\\.(com|in|net|org|co|fr|biz|info)([^\\p{L}\\p{N}_]|$)') AS is_domain FROM pages")
def domain_flag(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url").rlike(normalize.DOMAIN).alias("is_domain"))


@query(WITH + " SELECT entity_id, business_name || ' | ' || business_address AS text FROM records")
def pair_text(spark, sf_dir):
    return Records(spark, sf_dir).every.select("entity_id", normalize.pair_text(F.col("business_name"), F.col("business_address")).alias("text"))


_KEY = "array_to_string(list_sort(list_distinct(list_filter(string_split(" + _phrases("regexp_replace(lower(business_name), '[^a-z0-9 ]', ' ', 'g')", {"l l c": " "}) + f", ' '), lambda t: t <> '' AND NOT list_contains({_listed('llc inc corp corporation co company ltd limited pvt private llp pllc lp plc sa sas sarl group services service center centre the and of'.split())}, t)))), ' ')"


@query(WITH + f" SELECT entity_id, {_KEY} AS nk FROM records")
def name_key(spark, sf_dir):
    return Records(spark, sf_dir).every.select("entity_id", normalize.name_key(F.col("business_name")).alias("nk"))


_LOOSE = "trim(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}} ]', '', 'g'), ' +', ' ', 'g'))"


@query(WITH + f" SELECT entity_id, {_LOOSE.format(c='business_name')} AS loose FROM records")
def loose_norm(spark, sf_dir):
    return Records(spark, sf_dir).every.select("entity_id", normalize.loose_clean(F.col("business_name")).alias("loose"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}|[0-9]+'))), ' ') AS words FROM documents")
def word_sets(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(normalize.word_set(F.col("text"))), " ").alias("words"))


# --- tokens ---


def _idf(column: str, stop=(), name: str = "idf") -> str:
    stops = f" AND NOT list_contains({_listed(stop)}, t)" if stop else ""
    return f"""{name}_tok AS (SELECT DISTINCT entity_id, country, t FROM (SELECT entity_id, country, unnest(string_split({column}, ' ')) AS t FROM norm) WHERE t <> ''{stops}),
{name} AS (SELECT * FROM (SELECT country, t, count(*) AS df FROM {name}_tok GROUP BY ALL) JOIN (SELECT country, count(DISTINCT entity_id) AS n FROM {name}_tok GROUP BY ALL) USING (country)),
{name}_w AS (SELECT entity_id, t, ln(n / df) AS w FROM {name}_tok JOIN {name} USING (country, t)),
{name}_o AS (SELECT fp.s, fp.x, coalesce(i, 0) AS i, coalesce(m, 0) AS m, coalesce(a.w, 0) AS a, coalesce(b.w, 0) AS b FROM fp LEFT JOIN (SELECT fp.s, fp.x, sum(p.w) AS i, max(p.w) AS m FROM fp JOIN {name}_w p ON p.entity_id = fp.s JOIN {name}_w r ON r.entity_id = fp.x AND p.t = r.t GROUP BY ALL) USING (s, x)
 LEFT JOIN (SELECT entity_id, sum(w) AS w FROM {name}_w GROUP BY ALL) a ON a.entity_id = fp.s LEFT JOIN (SELECT entity_id, sum(w) AS w FROM {name}_w GROUP BY ALL) b ON b.entity_id = fp.x)"""


def _measures(name: str) -> str:
    return f"round(CASE WHEN a + b - i > 0 THEN i / (a + b - i) ELSE 0 END, 6) AS {name}_jac, round(CASE WHEN least(a, b) > 0 THEN i / least(a, b) ELSE 0 END, 6) AS {name}_cont, round(m, 6) AS {name}_max, round(i, 6) AS {name}_sum"


@query(NORM + f", {_idf('nn')} SELECT country, t, df, n, round(ln(n / df), 6) AS idf FROM idf")
def token_idf(spark, sf_dir):
    _, left, right = normalised(spark, sf_dir)
    return six(tokens.token_idf(left.unionByName(right), "nn").select("country", "t", "df", "n", "idf"), "idf")


def _overlap_query(name: str, column: str, stop: tuple):
    def run(spark, sf_dir):
        r, left, right = normalised(spark, sf_dir)
        out = tokens.overlap(r.pairs, tokens.weights(left.unionByName(right), column, stop), name)
        return six(out, *(f"{name}_{m}" for m in ("jac", "cont", "max", "sum")))

    run.__name__ = f"weighted_overlap_{column}"
    query(NORM + f", {_idf(column, stop)} SELECT s, x, {_measures(name)} FROM idf_o")(run)


for _name, (_column, _stop) in features.OVERLAPS.items():
    _overlap_query(_name, _column, _stop)

GENERIC = (
    NORM
    + f""", ptok AS (SELECT DISTINCT entity_id, country, t FROM (SELECT entity_id, country, unnest(string_split(nn, ' ')) AS t FROM norm WHERE src = 1) WHERE t <> ''),
gen AS (SELECT country, t FROM (SELECT country, t, count(*) AS df FROM ptok GROUP BY ALL) JOIN (SELECT country, count(DISTINCT entity_id) AS n FROM ptok GROUP BY ALL) USING (country) WHERE df / n >= 0.05),
tok AS (SELECT DISTINCT entity_id, country, t FROM (SELECT entity_id, country, unnest(string_split(nn, ' ')) AS t FROM norm) WHERE t <> ''),
dist AS (SELECT entity_id, coalesce(d, '') AS d, coalesce(gs, '') AS gs FROM norm LEFT JOIN (SELECT entity_id, string_agg(tok.t, ' ' ORDER BY tok.t) FILTER (gen.t IS NULL) AS d, string_agg(tok.t, ' ' ORDER BY tok.t) FILTER (gen.t IS NOT NULL) AS gs FROM tok LEFT JOIN gen USING (country, t) GROUP BY entity_id) USING (entity_id)),
ak AS (SELECT entity_id, country, array_to_string(list_sort(list_filter(string_split(an, ' '), lambda t: t <> '')), ' ') AS ak FROM norm WHERE src = 1),
same AS (SELECT entity_id, count(*) OVER (PARTITION BY country, ak) AS n_same_addr FROM ak)"""
)


@query(GENERIC + " SELECT country, t FROM gen")
def generic_tokens(spark, sf_dir):
    return tokens.generic_tokens(normalised(spark, sf_dir)[1], least=0.05)


@query(GENERIC + " SELECT entity_id, d, gs FROM dist")
def distinctive_parts(spark, sf_dir):
    _, left, right = normalised(spark, sf_dir)
    return tokens.distinctive(left.unionByName(right), tokens.generic_tokens(left, least=0.05))


@query(GENERIC + " SELECT entity_id, n_same_addr FROM same")
def same_address(spark, sf_dir):
    return tokens.same_address(normalised(spark, sf_dir)[1])


@query(GENERIC + " SELECT s, x, CAST(a.d = b.d AND a.d <> '' AS INT) AS d_eq, CAST(b.d = '' AS INT) AS d_empty_x, CAST(a.d = '' AS INT) AS d_empty_s, CAST(a.d = b.d AND a.d <> '' AND a.gs <> b.gs AS INT) AS g_only_diff, n_same_addr FROM fp JOIN dist a ON a.entity_id = s JOIN dist b ON b.entity_id = x JOIN same ON same.entity_id = s")
def generic_flags(spark, sf_dir):
    r, left, right = normalised(spark, sf_dir)
    return features.generic_features(r.pairs, left, right, 0.05).select("s", "x", "d_eq", "d_empty_x", "d_empty_s", "g_only_diff", "n_same_addr")


_SETS = WITH + ", w AS (SELECT entity_id, list_distinct(regexp_extract_all(lower(business_name), '[a-z]{3,}|[0-9]+')) AS n, list_distinct(regexp_extract_all(lower(business_address), '[a-z]{3,}|[0-9]+')) AS a, business_address = '' AS e FROM records)"


def _word_pairs(spark, sf_dir, pairs: DataFrame | None = None) -> DataFrame:
    r = Records(spark, sf_dir)
    sets = r.every.select("entity_id", normalize.word_set(F.col("business_name")).alias("n"), normalize.word_set(F.col("business_address")).alias("a"), (F.col("business_address") == "").alias("e"))
    both = features.gathered(r.pairs if pairs is None else pairs, sets, sets, ["n", "a", "e"])
    name, address = tokens.set_measures(F.col("s_n"), F.col("x_n")), tokens.set_measures(F.col("s_a"), F.col("x_a"))
    return both.select("s", "x", name["jaccard"].alias("nj"), address["jaccard"].alias("aj"), name["share_any"].alias("share_any"), address["share_number"].alias("share_number"), F.col("x_e").alias("addr_empty"))


_JACCARD = "len(list_intersect(p.{c}, q.{c})) / nullif(len(list_distinct(list_concat(p.{c}, q.{c}))), 0)"
_NUMS = "list_filter({c}, lambda t: regexp_matches(t, '^[0-9]+$'))"


@query(_SETS + f" SELECT s, x, round({_JACCARD.format(c='n')}, 6) AS nj, round({_JACCARD.format(c='a')}, 6) AS aj, len(list_intersect(p.n, q.n)) > 0 AS share_any, len(list_intersect({_NUMS.format(c='p.a')}, {_NUMS.format(c='q.a')})) > 0 AS share_number, q.e AS addr_empty FROM fp JOIN w p ON p.entity_id = s JOIN w q ON q.entity_id = x")
def list_jaccard(spark, sf_dir):
    return six(_word_pairs(spark, sf_dir), "nj", "aj")


# --- string similarity ---


def _name_pairs(spark, sf_dir) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type")
    ahead = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.concat_ws(" ", "p_type", "p_name").alias("b"))
    return part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("a")).join(ahead, "p_partkey").select("a", "b").distinct()


_PAIR = "pp AS (SELECT DISTINCT p.p_name || ' ' || p.p_type AS a, q.p_type || ' ' || q.p_name AS b FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1)"


def _lcs(a: str, b: str, source: str) -> str:
    """LCS by rows of the dynamic programme: state is the row of lengths."""
    return f"""rows AS (SELECT a, b, 0 AS i, list_transform(range(0, len({b}) + 1), lambda j: 0::BIGINT) AS r FROM {source}
 UNION ALL SELECT a, b, i + 1, list_reduce(list_transform(range(1, len({b}) + 1), lambda j: [CASE WHEN substring({a}, i + 1, 1) = substring({b}, j, 1) THEN r[j] + 1 ELSE r[j + 1] END]), lambda l, v: list_append(l, greatest(l[len(l)], v[1])), [0::BIGINT]) FROM rows WHERE i < len({a}))"""


@query("WITH RECURSIVE " + _PAIR + ", " + _lcs("a", "b", "pp") + " SELECT a, b, round(200.0 * r[len(r)] / (len(a) + len(b)), 6) AS score FROM rows WHERE i = len(a)")
def indel_ratio(spark, sf_dir):
    return six(_name_pairs(spark, sf_dir).withColumn("score", similarities({"r": ("ratio", F.col("a"), F.col("b"))})["r"]), "score")


@query("WITH RECURSIVE " + _PAIR.replace("pp AS (SELECT DISTINCT p.p_name || ' ' || p.p_type AS a, q.p_type || ' ' || q.p_name AS b", "pp AS (SELECT DISTINCT array_to_string(list_sort(string_split(p.p_name || ' ' || p.p_type, ' ')), ' ') AS a, array_to_string(list_sort(string_split(q.p_type || ' ' || q.p_name, ' ')), ' ') AS b") + ", " + _lcs("a", "b", "pp") + " SELECT a, b, round(200.0 * r[len(r)] / (len(a) + len(b)), 6) AS score FROM rows WHERE i = len(a)")
def token_sort_ratio(spark, sf_dir):
    pairs = _name_pairs(spark, sf_dir).withColumn("score", similarities({"r": ("token_sort_ratio", F.col("a"), F.col("b"))})["r"])
    ordered = lambda c: normalize.joined(F.array_sort(normalize.tokens(F.col(c)))).alias(c)
    return six(pairs.select(ordered("a"), ordered("b"), "score").distinct(), "score")


@query("WITH " + _PAIR + " SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS score FROM pp")
def jaro_winkler(spark, sf_dir):
    return six(_name_pairs(spark, sf_dir).withColumn("score", similarities({"r": ("jaro_winkler", F.col("a"), F.col("b"))})["r"]), "score")


_SETS_OF = "ts AS (SELECT a, b, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y FROM pp), tp AS (SELECT a, b, array_to_string(list_sort(list_filter(x, lambda t: list_contains(y, t))), ' ') AS c, array_to_string(list_sort(list_filter(x, lambda t: NOT list_contains(y, t))), ' ') AS l, array_to_string(list_sort(list_filter(y, lambda t: NOT list_contains(x, t))), ' ') AS r FROM ts), tq AS (SELECT *, trim(c || ' ' || l) AS one, trim(c || ' ' || r) AS two FROM tp)"
_BEGIN = "round(200.0 * length(c) / (length(c) + length({side})), 6)"  # the common words begin either side


@query("WITH RECURSIVE " + _PAIR + ", " + _SETS_OF + ", need AS (SELECT DISTINCT one AS a, two AS b FROM tq), " + _lcs("a", "b", "need") + f", found AS (SELECT a, b, round(200.0 * r[len(r)] / (len(a) + len(b)), 6) AS score FROM rows WHERE i = len(a)) SELECT tq.a, tq.b, CASE WHEN c <> '' AND (l = '' OR r = '') THEN 100.0 WHEN c = '' THEN score ELSE greatest(score, {_BEGIN.format(side='one')}, {_BEGIN.format(side='two')}) END AS score FROM tq JOIN found ON found.a = one AND found.b = two")
def token_set_ratio(spark, sf_dir):
    return six(_name_pairs(spark, sf_dir).withColumn("score", similarities({"r": ("token_set_ratio", F.col("a"), F.col("b"))})["r"]), "score")


_WINDOWS = "sp AS (SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS sh, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS lo FROM pp UNION ALL SELECT a, b, b, a FROM pp WHERE length(a) = length(b)), win AS (SELECT a, b, sh, unnest(list_transform(range(1, length(sh) + length(lo)), lambda e: substring(lo, greatest(0, e - length(sh)) + 1, least(e, length(lo)) - greatest(0, e - length(sh))))) AS w FROM sp)"


@query("WITH RECURSIVE " + _PAIR + f", {_WINDOWS}, need AS (SELECT DISTINCT sh AS a, w AS b FROM win), " + _lcs("a", "b", "need") + ", found AS (SELECT a, b, round(200.0 * r[len(r)] / (len(a) + len(b)), 6) AS score FROM rows WHERE i = len(a)) SELECT win.a, win.b, max(score) AS score FROM win JOIN found ON found.a = sh AND found.b = w GROUP BY ALL")
def partial_ratio(spark, sf_dir):
    return six(_name_pairs(spark, sf_dir).withColumn("score", similarities({"r": ("partial_ratio", F.col("a"), F.col("b"))})["r"]), "score")


_SIDES_OF = "FROM fp JOIN dist a ON a.entity_id = s JOIN dist b ON b.entity_id = x"
_ALL_SCORES = (
    f"dp AS (SELECT DISTINCT a.d AS a, b.d AS b {_SIDES_OF}), pp AS (SELECT * FROM dp UNION SELECT a.gs, b.gs {_SIDES_OF}), {_SETS_OF}, {_WINDOWS.replace('FROM pp', 'FROM dp')}, need AS (SELECT a, b FROM dp UNION SELECT one, two FROM tq UNION SELECT sh, w FROM win), "
    + _lcs("a", "b", "need")
    + f""", found AS (SELECT a, b, CASE WHEN a = b THEN 100.0 ELSE round(200.0 * r[len(r)] / (len(a) + len(b)), 6) END AS score FROM rows WHERE i = len(a)),
tset AS (SELECT tq.a, tq.b, CASE WHEN tq.a = '' OR tq.b = '' THEN 0.0 WHEN c <> '' AND (l = '' OR r = '') THEN 100.0 WHEN c = '' THEN score ELSE greatest(score, {_BEGIN.format(side='one')}, {_BEGIN.format(side='two')}) END AS v FROM tq JOIN found ON found.a = one AND found.b = two),
best AS (SELECT win.a, win.b, max(score) AS v FROM win JOIN found ON found.a = sh AND found.b = w GROUP BY ALL),
part AS (SELECT dp.a, dp.b, CASE WHEN dp.a = dp.b THEN 100.0 WHEN dp.a = '' OR dp.b = '' THEN 0.0 ELSE v END AS v FROM dp LEFT JOIN best ON best.a = dp.a AND best.b = dp.b)"""
)


@query(GENERIC.replace("WITH ", "WITH RECURSIVE ", 1) + f", {_ALL_SCORES} SELECT s, x, f.score::DOUBLE AS d_ratio, t.v::DOUBLE AS d_tset, p.v::DOUBLE AS d_part, g.v::DOUBLE AS g_tset {_SIDES_OF} JOIN found f ON f.a = a.d AND f.b = b.d JOIN tset t ON t.a = a.d AND t.b = b.d JOIN part p ON p.a = a.d AND p.b = b.d JOIN tset g ON g.a = a.gs AND g.b = b.gs")
def generic_scores(spark, sf_dir):
    r, left, right = normalised(spark, sf_dir)
    return six(features.generic_features(r.pairs, left, right, 0.05), "d_ratio", "d_tset", "d_part", "g_tset").select("s", "x", "d_ratio", "d_tset", "d_part", "g_tset")


# --- pair features ---

_DIFF = "list_min(flatten(list_transform(v1, lambda u: list_transform(v2, lambda w: abs(u - w) / greatest(1, u, w)))))"


@query(NORM + f", g AS (SELECT s, x, list_transform(p.nums, lambda t: CAST(substring(t, 1, 12) AS DOUBLE)) AS v1, list_transform(q.nums, lambda t: CAST(substring(t, 1, 12) AS DOUBLE)) AS v2, regexp_extract(p.an, '[0-9]+') AS f1, regexp_extract(q.an, '[0-9]+') AS f2 FROM fp JOIN norm p ON p.entity_id = s JOIN norm q ON q.entity_id = x), h AS (SELECT *, len(v1) AS n1, len(v2) AS nx, coalesce(list_sum(list_transform(v1, lambda u: len(list_filter(v2, lambda w: w = u)))), 0)::BIGINT AS i FROM g) SELECT s, x, n1 AS num_n1, nx AS num_nx, i AS num_inter, round(CASE WHEN n1 + nx - i > 0 THEN i / (n1 + nx - i) ELSE -1 END, 6) AS num_jac, round(coalesce({_DIFF}, -1), 6) AS num_reldiff, CAST(f1 = f2 AND f1 <> '' AS INT) AS fnum_eq, CAST(f2 = '' AS INT) AS fnum_miss FROM h")
def number_features(spark, sf_dir):
    r, left, right = normalised(spark, sf_dir)
    both = features.gathered(r.pairs, left, right, ["nums", "an"])
    out = both.select("s", "x", *(c.alias(n) for n, c in (features.number_scores(F.col("s_nums"), F.col("x_nums")) | features.first_number_flags(F.col("s_an"), F.col("x_an"))).items()))
    return six(out.withColumns({c: F.col(c).cast("long") for c in ("num_n1", "num_nx", "num_inter")}), "num_jac", "num_reldiff")


@query(NORM + " SELECT entity_id, src, CAST(nonlatin AS INT) AS nonlatin, CAST(addr_empty AS INT) AS addr_empty, CAST(is_domain AS INT) AS is_domain, len(nn) AS ln, len(an) AS la, len(nn) - len(replace(nn, ' ', '')) AS nw FROM norm")
def record_metadata(spark, sf_dir):
    _, left, right = normalised(spark, sf_dir)
    flags = ("nonlatin", "addr_empty", "is_domain")
    return features.metadata(left.unionByName(right)).select("entity_id", "src", *(F.col(c).cast("int").alias(c) for c in flags), *(F.col(c).cast("long").alias(c) for c in ("ln", "la", "nw")))


def _pair_features(spark, sf_dir) -> DataFrame:
    r, left, right = normalised(spark, sf_dir, kept=True)
    pairs = r.pairs.withColumns({"sim": F.lit(0.5), "rx": F.lit(0), "rs": F.lit(0)})
    return six(features.pair_features(pairs, left, right), *features.STAGE1)


@query()
def pair_features(spark, sf_dir):
    return _pair_features(spark, sf_dir)


_PLAIN = [c for c in features.STAGE1 if c not in features.SCORES or c == "n_jw"]
_OVERLAP_SQL = ", ".join(f"{n}m AS (SELECT s, x, {_measures(n)} FROM {n}_o)" for n in features.OVERLAPS)
_SIDES = """b1 AS (SELECT fp.s, fp.x, p.nn AS n1, q.nn AS n2, list_transform(p.nums, lambda t: CAST(substring(t, 1, 12) AS DOUBLE)) AS v1, list_transform(q.nums, lambda t: CAST(substring(t, 1, 12) AS DOUBLE)) AS v2,
 regexp_extract(p.an, '[0-9]+') AS f1, regexp_extract(q.an, '[0-9]+') AS f2, q.nonlatin AS x_nonlatin, q.addr_empty AS x_addr_empty, q.is_domain AS x_is_domain, q.src AS x_src, len(q.nn) AS x_ln, len(q.an) AS x_la, len(q.nn) - len(replace(q.nn, ' ', '')) AS x_nw,
 len(p.nn) AS s_ln, len(p.an) AS s_la, len(p.nn) - len(replace(p.nn, ' ', '')) AS s_nw FROM fp JOIN norm p ON p.entity_id = fp.s JOIN norm q ON q.entity_id = fp.x),
b2 AS (SELECT *, 0.5 AS sim, 0 AS rx, 0 AS rs, CASE WHEN n1 = '' AND n2 = '' THEN 1.0 ELSE jaro_winkler_similarity(n1, n2) END AS n_jw, len(v1) AS num_n1, len(v2) AS num_nx,
 coalesce(list_sum(list_transform(v1, lambda u: len(list_filter(v2, lambda w: w = u)))), 0) AS num_inter, CAST(f1 = f2 AND f1 <> '' AS INT) AS fnum_eq, CAST(f2 = '' AS INT) AS fnum_miss FROM b1),
b3 AS (SELECT *, CASE WHEN num_n1 + num_nx - num_inter > 0 THEN num_inter / (num_n1 + num_nx - num_inter) ELSE -1 END AS num_jac, coalesce(""" + _DIFF + """, -1) AS num_reldiff FROM b2)"""


@query(NORM + ", " + ", ".join(_idf(c, stop, n) for n, (c, stop) in features.OVERLAPS.items()) + f", {_OVERLAP_SQL}, {_SIDES} SELECT s, x, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in _PLAIN) + " FROM b3 " + " ".join(f"JOIN {n}m USING (s, x)" for n in features.OVERLAPS))
def pair_features_plain(spark, sf_dir):
    """All stage-1 columns but those that an LCS decides, whose kernels have queries of their own."""
    return _pair_features(spark, sf_dir).select("s", "x", *_PLAIN)


# --- retrieval ---


@query(VECTORS + " SELECT block, s, x, round(sim, 6) AS sim, rx, rs FROM dense")
def blocked_topk(spark, sf_dir):
    return six(Vectors(spark, sf_dir).dense, "sim").withColumns({c: F.col(c).cast("long") for c in ("rx", "rs")})


@query(VECTORS + " SELECT s, x, rx, rs FROM dense WHERE rx < 3 OR rs < 10")
def prune_candidates(spark, sf_dir):
    return blocking.prune(Vectors(spark, sf_dir).dense).select("s", "x", F.col("rx").cast("long").alias("rx"), F.col("rs").cast("long").alias("rs"))


@query(WITH + ", e AS (SELECT entity_id AS s, row_number() OVER (ORDER BY k) - 1 AS place, count(*) OVER () AS n FROM s1), t AS (SELECT s, x FROM truth ORDER BY CAST('0x' || md5(s || '|' || x)[:8] AS BIGINT) LIMIT 200000), f AS (SELECT e.s, x FROM (SELECT x, unnest([0, 1, 2]) AS j FROM t) JOIN e ON place = CAST('0x' || md5(x || '|' || j)[:8] AS BIGINT) % n) SELECT s, x, 0.5::DOUBLE AS sim, 0 AS rx, 0 AS rs FROM (SELECT * FROM t UNION SELECT * FROM f)")
def debug_candidates(spark, sf_dir):
    r = Records(spark, sf_dir)
    places = blocking.numbered(r.primary.select(F.col("entity_id").alias("s"), "k"), "k")
    return blocking.debug_candidates(tables.truth_pairs(r.lists), places)


_GRAMS = "list_transform(range(1, length(t) - 1), lambda i: (unicode(substring(t, i, 1)) * 961 + unicode(substring(t, i + 1, 1)) * 31 + unicode(substring(t, i + 2, 1))) % 64)"


@query(WITH + f", t AS (SELECT entity_id, lower(business_name || ' | ' || business_address) AS t FROM records), g AS (SELECT entity_id, unnest({_GRAMS}) AS d FROM t), n AS (SELECT entity_id, d, count(*) AS n FROM g GROUP BY ALL) SELECT entity_id, CAST(d AS INT) AS d, round(n / sqrt(sum(n * n) OVER (PARTITION BY entity_id)), 6) AS v FROM n")
def hashed_embedding(spark, sf_dir):
    embedded = models.embedded(Records(spark, sf_dir).every, blocking.NgramEmbedder())
    return embedded.select("entity_id", F.posexplode("e").alias("d", "v")).filter("v > 0").select("entity_id", "d", F.round("v", 6).alias("v"))


_EF = "fitted AS (SELECT d, 1 + ln((1 + any_value(c)) / (1 + count(*))) AS w FROM (SELECT DISTINCT entity_id, d FROM g), (SELECT count(*) AS c FROM t) GROUP BY d)"


@query(WITH + f", t AS (SELECT entity_id, lower(business_name || ' | ' || business_address) AS t FROM s1), g AS (SELECT entity_id, unnest({_GRAMS}) AS d FROM t), {_EF} SELECT CAST(d AS INT) AS d, round(w, 6) AS w FROM fitted")
def fitted_embedder(spark, sf_dir):
    """The rarity weights that the embedder learns, of the buckets that occur."""
    text = normalize.pair_text(F.col("business_name"), F.col("business_address"))
    r = Records(spark, sf_dir).primary
    fitted = blocking.NgramEmbedder().fit(r.select(F.lower(text).alias("text")))
    most = 1 + math.log(1 + r.count())  # the weight of a bucket that no text has
    return spark.createDataFrame([(d, round(w, 6)) for d, w in enumerate(fitted.weights) if w < most - 1e-9], "d int, w double")


# --- folds, samples, labels ---

_HASH = "CAST('0x' || md5({c})[:8] AS BIGINT)"


@query(WITH + f" SELECT entity_id, CAST({_HASH.format(c='entity_id')} % 5 AS INT) AS f, {_HASH.format(c=chr(39).join(['entity_id || ', '|drop', '']))} % 10000 < 1900 AS dropped FROM s1")
def fold_assign(spark, sf_dir):
    return Records(spark, sf_dir).primary.select("entity_id", folds.fold("entity_id").alias("f"), folds.dropped("entity_id").alias("dropped"))


@query(VECTORS + f" SELECT s, x FROM pairs WHERE {_HASH.format(c=chr(39).join(['s || ', '|', ' || x || ', '|', '']))} < 429496729")
def hash_sample(spark, sf_dir):
    return folds.sampled(Vectors(spark, sf_dir).pairs, ["s", "x"], share=0.1).select("s", "x")


@query(VECTORS + ", t AS (SELECT DISTINCT s, x, 1 AS y FROM truth) SELECT s, x, coalesce(y, 0) AS y FROM pairs LEFT JOIN t USING (s, x)")
def pair_labels(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return folds.labelled(v.pairs.select("s", "x"), v.truth)


@query(VECTORS + f" SELECT s, x FROM pairs WHERE {_HASH.format(c='CAST(s AS VARCHAR)')} % 5 IN (1, 2) AND (rx < 3 OR rs < 5)")
def hard_pairs(spark, sf_dir):
    return folds.hard_pairs(Vectors(spark, sf_dir).pairs.withColumn("f", folds.fold(F.col("s").cast("string")))).select("s", "x")


@query(VECTORS + ", l AS (SELECT s, x, q, max(q) OVER (PARTITION BY x) AS qm, row_number() OVER (PARTITION BY x ORDER BY q DESC, s) AS r FROM (SELECT s, x, round(1 / (1 + exp(sim * -40)), 9) AS q FROM pairs)) SELECT s, x, CASE WHEN qm > 0.97 AND r = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM l WHERE (qm > 0.97 AND r <= 3) OR (qm < 0.005 AND r <= 2)")
def pseudo_labels(spark, sf_dir):
    return folds.pseudo_labels(Vectors(spark, sf_dir).pairs.withColumn("q", F.round(1 / (1 + F.exp(F.col("sim") * -40)), 9)))


# --- context ---

_COMP = """, c1 AS (SELECT s, x, p, row_number() OVER (PARTITION BY x ORDER BY p DESC, s) AS p_rank_x, max(p) OVER (PARTITION BY x) AS p_max_x, sum(p) OVER (PARTITION BY x) AS p_sum_x, count(*) OVER (PARTITION BY x) AS n_x,
 row_number() OVER (PARTITION BY s ORDER BY p DESC, x) AS p_rank_s, max(p) OVER (PARTITION BY s) AS p_max_s, CAST(sum(CAST(p > 0.5 AS INT)) OVER (PARTITION BY s) AS BIGINT) AS n_hi_s, sum(p) OVER (PARTITION BY s) AS p_sum_s, count(*) OVER (PARTITION BY s) AS n_s FROM pairs),
c2 AS (SELECT *, max(CASE WHEN p_rank_x = 2 THEN p ELSE 0 END) OVER (PARTITION BY x) AS p2 FROM c1)"""


@query(VECTORS + _COMP + " SELECT s, x, round(p, 6) AS p, p_rank_x, round(p_max_x, 6) AS p_max_x, round(p_sum_x, 6) AS p_sum_x, n_x, p_rank_s, round(p_max_s, 6) AS p_max_s, n_hi_s, round(p_sum_s, 6) AS p_sum_s, n_s, round(p - p_max_x, 6) AS gap_x, round(p_sum_x - p, 6) AS other_x, round(CASE WHEN p_rank_x = 1 THEN p - p2 ELSE p - p_max_x END, 6) AS margin_x FROM c2")
def competition(spark, sf_dir):
    out = context.competition(Vectors(spark, sf_dir).pairs.select("s", "x", "p"))
    out = six(out, "p", "p_max_x", "p_sum_x", "p_max_s", "p_sum_s", "gap_x", "other_x", "margin_x")
    return out.withColumns({c: F.col(c).cast("long") for c in ("p_rank_x", "p_rank_s")})


@query(VECTORS + ", c AS (SELECT s, x, sim * 10 - 1 AS ce FROM pairs), d AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY ce DESC, s) AS rx, max(ce) OVER (PARTITION BY x) AS mx, row_number() OVER (PARTITION BY s ORDER BY ce DESC, x) AS rs, CAST(sum(CAST(ce > 0 AS INT)) OVER (PARTITION BY s) AS BIGINT) AS hi FROM c), g AS (SELECT *, max(CASE WHEN rx = 2 THEN ce ELSE -99 END) OVER (PARTITION BY x) AS c2 FROM d) SELECT s, x, rx AS ce_rank_x, round(mx, 6) AS ce_max_x, round(ce - mx, 6) AS ce_gap_x, round(CASE WHEN rx = 1 THEN ce - c2 ELSE ce - mx END, 6) AS ce_margin_x, rs AS ce_rank_s, hi AS ce_hi_s FROM g")
def scorer_competition(spark, sf_dir):
    out = context.scorer_competition(Vectors(spark, sf_dir).pairs.select("s", "x", (F.col("sim") * 10 - 1).alias("ce"))).drop("ce")
    return six(out, "ce_max_x", "ce_gap_x", "ce_margin_x").withColumns({c: F.col(c).cast("long") for c in ("ce_rank_x", "ce_rank_s")})


@query(VECTORS + " SELECT s, x, row_number() OVER (PARTITION BY x ORDER BY sim DESC, s) AS ce2_rank_x, round(sim - max(sim) OVER (PARTITION BY x), 6) AS ce2_gap_x, CAST(sum(CAST(sim > 0 AS INT)) OVER (PARTITION BY s) AS BIGINT) AS ce2_hi_s FROM pairs")
def extra_round(spark, sf_dir):
    out = context.extra_round(Vectors(spark, sf_dir).pairs.select("s", "x", F.col("sim").alias("ce2")), "ce2").drop("ce2")
    return six(out, "ce2_gap_x").withColumn("ce2_rank_x", F.col("ce2_rank_x").cast("long"))


_SIB = """, w AS (SELECT s, x, CASE WHEN p > 0.5 THEN p ELSE 0 END AS w, r.e AS ex FROM pairs JOIN r USING (x)),
c AS (SELECT s, list(c ORDER BY d) AS c FROM (SELECT s, d, sum(w * ex[d]) AS c FROM w, range(1, 65) t(d) GROUP BY s, d) GROUP BY s), t AS (SELECT s, sum(w) AS t FROM w GROUP BY s),
o AS (SELECT w.s, x, ex, e.e AS es, t - w AS sib_w, list_transform(range(1, 65), lambda d: c[d] - ex[d] * w) AS o FROM w JOIN c USING (s) JOIN t USING (s) JOIN e USING (s)),
f AS (SELECT s, x, sib_w, CASE WHEN sib_w > 0.001 THEN list_inner_product(ex, o) / greatest(sqrt(list_inner_product(o, o)), 1e-6) ELSE -1 END AS sib_cos, list_inner_product(es, o) / greatest(sqrt(list_inner_product(o, o)), 1e-6) AS s1_sib_cos FROM o)"""
#: Where nothing but rounding is left of the centroid, its direction is noise; below 1e-6 the cosine is bounded by its length.
_NEAR = "round(sib_w, 6) AS sib_w, round(sib_cos, 6) AS sib_cos, round(s1_sib_cos, 6) AS s1_sib_cos, round(sib_cos - s1_sib_cos, 6) AS sib_minus_s1"


def _siblings(v: Vectors) -> DataFrame:
    return context.sibling_consensus(v.pairs.select("s", "x", "p"), v.entities, v.records, least=0.5)


@query(VECTORS + _SIB + f" SELECT s, x, {_NEAR} FROM f")
def sibling_consensus(spark, sf_dir):
    return six(_siblings(Vectors(spark, sf_dir)), "sib_w", "sib_cos", "s1_sib_cos", "sib_minus_s1")


@query(VECTORS + _SIB + " SELECT s, x, row_number() OVER (PARTITION BY x ORDER BY round(sib_cos, 9) DESC, s) AS sib_rank_x FROM f")
def sib_rank(spark, sf_dir):
    found = _siblings(Vectors(spark, sf_dir)).withColumn("sib_cos", F.round("sib_cos", 9))
    return context.sibling_rank(found).select("s", "x", F.col("sib_rank_x").cast("long").alias("sib_rank_x"))


@query(VECTORS + ", ce AS (SELECT s, x, round(sim * 5, 6) AS ce FROM pairs WHERE p > 0.55), g AS (SELECT s, x, round(sim + 1, 6) AS extra FROM pairs WHERE x % 2 = 0) SELECT s, x, rx, round(p, 6) AS p, coalesce(ce, -12.0) AS ce, extra FROM pairs LEFT JOIN ce USING (s, x) LEFT JOIN g USING (s, x)")
def feature_assembly(spark, sf_dir):
    v = Vectors(spark, sf_dir).pairs
    logits, extra = v.filter("p > 0.55").select("s", "x", F.round(F.col("sim") * 5, 6).alias("ce")), v.filter("x % 2 = 0").select("s", "x", F.round(F.col("sim") + 1, 6).alias("extra"))
    return six(context.assembled(v.select("s", "x", F.col("rx").cast("long").alias("rx")), v.select("s", "x", "p"), {"ce": logits}, [extra]), "p")


_CES = {"ce": "sim * 10 - 1", "ce2": "sim * 7", "ce3": "1 - sim * 3", "ce4": "sim - 0.5"}
_ROUNDS = "".join(f", row_number() OVER (PARTITION BY x ORDER BY {n} DESC, s) AS {n}_rank_x, {n} - max({n}) OVER (PARTITION BY x) AS {n}_gap_x, CAST(sum(CAST({n} > 0 AS INT)) OVER (PARTITION BY s) AS BIGINT) AS {n}_hi_s" for n in _CES)
_STAGE3 = [c for c in features.STAGE2["v6"] if c not in features.KEPT2 and c not in features.GENERIC and c not in ("sib_rank_x", "s1_sib_cos", "sib_minus_s1", "ce", "ce2", "ce3", "ce4")] + ["sib_rank_x"]


@query(VECTORS + _COMP + _SIB.replace("p > 0.5 ", "p > 0.1 ") + ", cs AS (SELECT s, x, " + ", ".join(f"{e} AS {n}" for n, e in _CES.items()) + f" FROM pairs), k1 AS (SELECT *{_ROUNDS}, max(ce) OVER (PARTITION BY x) AS ce_max_x, row_number() OVER (PARTITION BY s ORDER BY ce DESC, x) AS ce_rank_s FROM cs), k2 AS (SELECT *, max(CASE WHEN ce_rank_x = 2 THEN ce ELSE -99 END) OVER (PARTITION BY x) AS c2 FROM k1), k3 AS (SELECT *, CASE WHEN ce_rank_x = 1 THEN ce - c2 ELSE ce_max_x * -1 + ce END AS ce_margin_x FROM k2), sr AS (SELECT s, x, sib_w, sib_cos, row_number() OVER (PARTITION BY x ORDER BY sib_cos DESC, s) AS sib_rank_x FROM f), all3 AS (SELECT * EXCLUDE (p2), p - p_max_x AS gap_x, p_sum_x - p AS other_x, CASE WHEN p_rank_x = 1 THEN p - p2 ELSE p - p_max_x END AS margin_x FROM c2) SELECT s, x, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in _STAGE3) + " FROM all3 JOIN k3 USING (s, x) JOIN sr USING (s, x)")
def stage3_features(spark, sf_dir):
    """All columns around the scores that the second model's last version reads; record features and generic words have queries of their own."""
    v = Vectors(spark, sf_dir)
    pairs = v.pairs.select("s", "x", "sim", F.col("p").alias("p1")).persist(StorageLevel.MEMORY_AND_DISK)  # read once for each score
    logits = {n: pairs.select("s", "x", F.expr(e).alias(n)) for n, e in _CES.items()}
    split = pipeline.Split(None, None, v.entities, v.records, None)
    return six(pipeline.stage2_columns(pairs.select("s", "x", "sim"), pairs.drop("sim"), logits, "v6", split, generic=False).select("s", "x", *_STAGE3), *_STAGE3)


# --- decisions ---

BEST = VECTORS + ", best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY x ORDER BY q DESC, s) = 1)"


@query(BEST + " SELECT s, x, round(q, 6) AS q FROM best")
def exclusive_assign(spark, sf_dir):
    return six(decide.exclusive(Vectors(spark, sf_dir).pairs).select("s", "x", "q"), "q")


@query(BEST + " SELECT s, x FROM best WHERE q > 0.6")
def threshold_decide(spark, sf_dir):
    return decide.above(decide.exclusive(Vectors(spark, sf_dir).pairs), 0.6).select("s", "x")


_LIMIT = "CASE country WHEN 'US' THEN 0.5 WHEN 'France' THEN 0.3 ELSE 0.7 END"


@query(BEST + f", k AS (SELECT s, count(*) AS n FROM best WHERE q > {_LIMIT} GROUP BY s) SELECT country, round(avg(coalesce(n, 0)), 6) AS matches, round(avg(CASE WHEN n IS NULL THEN 1.0 ELSE 0 END), 6) AS empty FROM keys LEFT JOIN k USING (s) GROUP BY country")
def country_threshold(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    picked = decide.above_by_group(decide.exclusive(v.pairs), {"US": 0.5, "France": 0.3})
    return six(decide.variant_report(picked, v.keys), "matches", "empty")


_TRUTHS = BEST.replace("WITH e AS", "WITH RECURSIVE e AS", 1) + """, g AS (SELECT s, list(q ORDER BY q DESC, x) AS qs, list(x ORDER BY q DESC, x) AS xs FROM best WHERE q > 0.02 GROUP BY s),
ks AS (SELECT s, qs, xs, unnest(range(0, len(qs) + 1)) AS k FROM g),
pm AS (SELECT s, qs, xs, k, 0 AS i, [1.0::DOUBLE] AS a, [1.0::DOUBLE] AS b FROM ks UNION ALL SELECT s, qs, xs, k, i + 1,
 CASE WHEN i < k THEN list_transform(range(1, len(a) + 2), lambda j: coalesce(a[j], 0) * (1 - qs[i + 1]) + CASE WHEN j > 1 THEN a[j - 1] ELSE 0 END * qs[i + 1]) ELSE a END,
 CASE WHEN i >= k THEN list_transform(range(1, len(b) + 2), lambda j: coalesce(b[j], 0) * (1 - qs[i + 1]) + CASE WHEN j > 1 THEN b[j - 1] ELSE 0 END * qs[i + 1]) ELSE b END FROM pm WHERE i < len(qs)),
ef AS (SELECT s, xs, qs, k, CASE WHEN k = 0 THEN b[1] ELSE list_sum(flatten(list_transform(range(0, len(a)), lambda u: list_transform(range(0, len(b)), lambda w: a[u + 1] * b[w + 1] * 1.25 * u / (k + 0.25 * (u + w)))))) END AS e FROM pm WHERE i = len(qs))"""


@query(_TRUTHS + " SELECT s, CAST(k AS INT) AS k, round(e, 6) AS e FROM ef")
def expected_scores(spark, sf_dir):
    out = decide.expected_scores(decide.exclusive(Vectors(spark, sf_dir).pairs))
    return six(out.select("s", F.posexplode("e").alias("k", "e")), "e")


@query(_TRUTHS + ", ch AS (SELECT s, xs, k FROM ef QUALIFY row_number() OVER (PARTITION BY s ORDER BY round(e, 12) DESC, k) = 1) SELECT s, unnest(xs[:k]) AS x FROM ch WHERE k > 0")
def expected_f05(spark, sf_dir):
    return decide.expected_f05(decide.exclusive(Vectors(spark, sf_dir).pairs)).select("s", "x")


_F05 = "CASE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (np + 0.25 * nt) END"


def _scored(source: str) -> str:
    return f"(SELECT avg({_F05}) FROM (SELECT keys.s, (SELECT count(*) FROM (SELECT DISTINCT s, x FROM truth) t WHERE t.s = keys.s) AS nt, (SELECT count(*) FROM {source} p WHERE p.s = keys.s) AS np, (SELECT count(*) FROM {source} p JOIN (SELECT DISTINCT s, x FROM truth) t ON p.s = t.s AND p.x = t.x WHERE p.s = keys.s) AS tp FROM keys))"


_METHODS = ", ".join(f"m{k} AS (SELECT s, x FROM best WHERE q > {t})" for k, t in enumerate((0.3, 0.4, 0.5, 0.6, 0.7, 0.8))) + ", m6 AS (SELECT s, unnest(xs[:k]) AS x FROM (SELECT s, xs, k FROM ef QUALIFY row_number() OVER (PARTITION BY s ORDER BY round(e, 12) DESC, k) = 1) WHERE k > 0)"


@query(_TRUTHS + f", {_METHODS}, sc AS (" + " UNION ALL ".join(f"SELECT {k} AS k, '{m}' AS method, {_scored(f'm{k}')} AS score" for k, m in enumerate(decide.METHODS)) + ") SELECT method, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 12) DESC, k) = 1 AS chosen FROM sc")
def choose_method(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return six(decide.choose_method(decide.exclusive(v.pairs), v.truth, v.keys), "score")


# --- evaluation ---


@query(BEST + f", m AS (SELECT s, x FROM best WHERE q > 0.5) SELECT round({_scored('m')}, 6) AS f05, (SELECT count(*) FROM keys) AS n")
def macro_f05(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return six(evaluate.macro_f05(decide.above(decide.exclusive(v.pairs), 0.5), v.truth, v.keys), "f05")


_CUTS = {**{f"rx<{k}": f"rx < {k}" for k in (1, 2, 3, 5, 10, 20)}, **{f"rx<{a}|rs<{b}": f"(rx < {a} OR rs < {b})" for a, b in ((2, 5), (3, 5), (3, 10), (5, 10), (5, 20))}}


@query(VECTORS + ", t AS (SELECT DISTINCT s, x FROM truth), h AS (SELECT t.*, rx, rs FROM t LEFT JOIN dense USING (s, x)) " + " UNION ALL ".join(f"SELECT '{n}' AS cut, round((SELECT avg(CASE WHEN {c} THEN 1.0 ELSE 0 END) FROM h), 6) AS recall, (SELECT count(*) FROM dense WHERE {c}) AS pairs" for n, c in _CUTS.items()))
def recall_grid(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return six(evaluate.recall_grid(v.dense, v.truth), "recall")


BREAK = (
    BEST
    + """, t AS (SELECT DISTINCT s, x, 1 AS t FROM truth), m AS (SELECT s, x, 1 AS p FROM best WHERE q > 0.5), j AS (SELECT s, x, coalesce(t, 0) AS t, coalesce(p, 0) AS p, CASE WHEN d.rx IS NULL THEN 0 ELSE 1 END AS c FROM t FULL JOIN m USING (s, x) LEFT JOIN dense d USING (s, x)),
b AS (SELECT s, sum(t)::BIGINT AS nt, sum(p)::BIGINT AS np, sum(t * p)::BIGINT AS tp, count(*) FILTER (t = 1 AND p = 0 AND c = 0) AS miss_cand, count(*) FILTER (t = 1 AND p = 0 AND c = 1) AS miss_model, count(*) FILTER (t = 0 AND p = 1) AS fp FROM j GROUP BY s),
br AS (SELECT keys.s, coalesce(nt, 0) AS nt, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp, coalesce(miss_cand, 0) AS miss_cand, coalesce(miss_model, 0) AS miss_model, coalesce(fp, 0) AS fp FROM keys LEFT JOIN b USING (s)),
bc AS (SELECT *, """
    + _F05
    + """ AS f05, CASE WHEN nt = 0 AND np > 0 THEN 'singleton_but_predicted' WHEN nt > 0 AND np = 0 THEN 'has_match_predicted_empty' WHEN fp > 0 THEN 'has_false_positive' WHEN miss_cand + miss_model > 0 THEN 'only_misses' ELSE 'perfect' END AS category FROM br)"""
)


def _breakdown(spark, sf_dir) -> DataFrame:
    v = Vectors(spark, sf_dir)
    return evaluate.error_breakdown(decide.above(decide.exclusive(v.pairs), 0.5), v.truth, v.dense, v.keys)


@query(BREAK + " SELECT s, nt, np, tp, miss_cand, miss_model, fp, round(f05, 6) AS f05, category FROM bc")
def error_breakdown(spark, sf_dir):
    return six(_breakdown(spark, sf_dir), "f05")


@query(BREAK + " SELECT category, count(*) AS n, round(sum(1 - f05) / (SELECT count(*) FROM bc), 6) AS loss_share FROM bc GROUP BY category")
def loss_shares(spark, sf_dir):
    return six(evaluate.loss_shares(_breakdown(spark, sf_dir)), "loss_share")


MISS = BEST + """, t AS (SELECT DISTINCT s, x FROM truth), ms AS (SELECT t.s, t.x, p.q, b.s AS best_s, b.q AS best_q, CASE WHEN p.q IS NULL THEN 'not_candidate' WHEN b.s <> t.s THEN 'lost_to_other_S1' WHEN p.q < 0.3 THEN 'own_best_q<0.3' WHEN p.q < 0.7 THEN 'own_best_q0.3-0.7' ELSE 'own_best_q>=0.7' END AS category FROM t LEFT JOIN pairs p ON p.s = t.s AND p.x = t.x LEFT JOIN best b ON b.x = t.x)"""


@query(MISS + " SELECT s, x, category, best_s, round(best_q, 6) AS best_q FROM ms")
def miss_categories(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return six(evaluate.miss_categories(v.truth, v.pairs).select("s", "x", "category", "best_s", "best_q"), "best_q")


@query(MISS + " SELECT category, count(*) AS n, round(quantile_cont(best_q, 0.1), 6) AS q10, round(quantile_cont(best_q, 0.5), 6) AS q50, round(quantile_cont(best_q, 0.9), 6) AS q90 FROM ms GROUP BY category")
def miss_report(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return six(evaluate.miss_report(evaluate.miss_categories(v.truth, v.pairs)), "q10", "q50", "q90")


_BIN = ", ".join(f"round(avg(CASE WHEN qm > {a} AND qm <= {b} THEN 1.0 ELSE 0 END), 6) AS bin{k}" for k, (a, b) in enumerate(evaluate.BINS))


@query(VECTORS + f", b AS (SELECT x, max(q) AS qm, count(*) FILTER (p > 0.3) AS rivals FROM pairs GROUP BY x), z AS (SELECT count(*)::DOUBLE AS n FROM keys) SELECT count(*) AS records, round(count(*) / any_value(n), 6) AS per_entity, {_BIN}, round(count(*) FILTER (qm > 0.5) / any_value(n), 6) AS strong, round(count(*) FILTER (qm > 0.2 AND qm < 0.8) / any_value(n), 6) AS ambiguous, round(count(*) FILTER (rivals > 1) / any_value(n), 6) AS contested FROM b, z")
def shift_report(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    out = evaluate.shift_report(v.pairs, v.keys.count())
    return six(out, *(c for c in out.columns if c != "records"))


@query(VECTORS + " SELECT strong, count(*) AS n FROM (SELECT least(count(*), 12)::BIGINT AS strong FROM pairs WHERE p > 0.5 GROUP BY s) GROUP BY strong")
def strong_histogram(spark, sf_dir):
    return evaluate.strong_histogram(Vectors(spark, sf_dir).pairs).withColumn("strong", F.col("strong").cast("long"))


@query(BEST + " SELECT country, round(avg(CASE WHEN q > 0.2 AND q < 0.8 THEN 1.0 ELSE 0 END), 6) AS ambig, round(avg(CASE WHEN q > 0.5 THEN 1.0 ELSE 0 END), 6) AS hi FROM best GROUP BY country")
def ambiguity(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return six(evaluate.ambiguity(v.pairs.select("s", "x", "q"), v.keys), "ambig", "hi")


@query(VECTORS + ", r3 AS (SELECT x, s, q, row_number() OVER (PARTITION BY x ORDER BY q DESC, s) AS r FROM pairs) SELECT x, s, round(q, 6) AS q, r FROM r3 WHERE r <= 3 AND x IN (SELECT x FROM r3 WHERE r = 1 AND q > 0.2 AND q < 0.8)")
def uncertain_cases(spark, sf_dir):
    return six(evaluate.uncertain_cases(Vectors(spark, sf_dir).pairs), "q").withColumn("r", F.col("r").cast("long"))


# --- profiles ---

_SHARE = "round(avg(CASE WHEN {c} THEN 1.0 ELSE 0 END), 6)"


def _sourced(df: DataFrame) -> DataFrame:
    return df.withColumn("src", F.substring("entity_id", 2, 1).cast("int"))


_SRC = "CAST(substring(entity_id, 2, 1) AS INT) AS src"


@query(WITH + f" SELECT {_SRC}, country, count(*) AS n, 0.0::DOUBLE AS name_indic, 0.0::DOUBLE AS addr_indic, {_SHARE.format(c=chr(39).join(['business_name = ', '', '']))} AS name_empty, {_SHARE.format(c=chr(39).join(['business_address = ', '', '']))} AS addr_empty FROM records GROUP BY ALL")
def source_shapes(spark, sf_dir):
    return six(profile.source_shapes(_sourced(Records(spark, sf_dir).every)), "name_indic", "addr_indic", "name_empty", "addr_empty")


@query(WITH + """, l AS (SELECT len(list_filter(string_split(matched_entity_ids, ','), lambda t: t <> '')) AS n FROM gt), tp AS (SELECT truth.*, o.country AS cx, s1.country, o.entity_id FROM truth LEFT JOIN o ON o.entity_id = x LEFT JOIN s1 ON s1.entity_id = s), mx AS (SELECT o.entity_id, substring(o.entity_id, 2, 1) AS src, o.entity_id IN (SELECT x FROM truth) AS m FROM o)
SELECT (SELECT count(*) FROM l) AS entities, (SELECT round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0 END), 6) FROM l) AS singleton_rate, (SELECT round(avg(n), 6) FROM l) AS mean_matches, (SELECT CAST(max(n) AS INT) FROM l) AS most_matches, (SELECT count(*) FROM truth) AS pairs, (SELECT count(*) - count(DISTINCT x) FROM truth) AS violations, (SELECT count(*) FILTER (entity_id IS NULL) FROM tp) AS missing_ids, (SELECT round(avg(CASE WHEN cx = country THEN 1.0 ELSE 0 END), 6) FROM tp) AS country_agree, (SELECT round(avg(CASE WHEN m THEN 1.0 ELSE 0 END), 6) FROM mx WHERE src = '2') AS matched_2, (SELECT round(avg(CASE WHEN m THEN 1.0 ELSE 0 END), 6) FROM mx WHERE src = '3') AS matched_3""")
def truth_profile(spark, sf_dir):
    r = Records(spark, sf_dir)
    out = profile.truth_profile(r.lists, tables.truth_pairs(r.lists), r.primary, _sourced(r.secondary))
    return six(out, "singleton_rate", "mean_matches", "country_agree", "matched_2", "matched_3")


@query(WITH + ", l AS (SELECT list_filter(string_split(matched_entity_ids, ','), lambda t: t <> '') AS m FROM gt) SELECT CAST(len(m) AS INT) AS n, CAST(len(list_filter(m, lambda t: starts_with(t, 'S2-'))) AS INT) AS n2, CAST(len(list_filter(m, lambda t: starts_with(t, 'S3-'))) AS INT) AS n3, count(*) AS entities FROM l GROUP BY ALL")
def match_counts(spark, sf_dir):
    return profile.match_counts(Records(spark, sf_dir).lists)


@query(WITH + f" SELECT CAST(substring(x, 2, 1) AS INT) AS src, a.country, {_SHARE.format(c=_LOOSE.format(c='a.business_name') + ' = ' + _LOOSE.format(c='b.business_name'))} AS name_eq, {_SHARE.format(c=_LOOSE.format(c='a.business_address') + ' = ' + _LOOSE.format(c='b.business_address'))} AS addr_eq FROM truth JOIN s1 a ON a.entity_id = s JOIN o b ON b.entity_id = x GROUP BY ALL")
def equality_rates(spark, sf_dir):
    r = Records(spark, sf_dir)
    both = features.gathered(tables.truth_pairs(r.lists), _sourced(r.primary), _sourced(r.secondary), ["business_name", "business_address", "country", "src"])
    return six(profile.equality_rates(both), "name_eq", "addr_eq")


DUP = WITH + f", nk AS (SELECT entity_id, country, business_name, business_address, {_KEY} AS nk FROM s1), nko AS (SELECT entity_id, country, {_KEY} AS nk FROM o)"


def _shared(keys: str) -> str:
    return f"(SELECT round(sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c), 6) FROM (SELECT count(*) AS c FROM nk GROUP BY {keys}))"


@query(DUP + f" SELECT {_shared('country, nk')} AS shared_key, {_shared('business_address')} AS shared_address, (SELECT count(*) FROM nk) - (SELECT count(*) FROM (SELECT DISTINCT business_name, business_address FROM nk)) AS exact_duplicates")
def dup_structure(spark, sf_dir):
    return six(profile.duplicate_structure(Records(spark, sf_dir).primary), "shared_key", "shared_address")


@query(DUP + " SELECT nk, count(*) AS n FROM nk GROUP BY nk ORDER BY n DESC, nk LIMIT 15")
def top_keys(spark, sf_dir):
    return profile.top_keys(Records(spark, sf_dir).primary)


@query(DUP + """ SELECT CASE WHEN entity_id IN (SELECT x FROM truth) THEN 'matched' ELSE 'unmatched' END AS part, count(*) AS n, count(*) FILTER ((country, nk) IN (SELECT (country, nk) FROM nk)) AS hits FROM nko GROUP BY 1
UNION ALL SELECT CASE WHEN entity_id IN (SELECT s FROM truth) THEN 'with_match' ELSE 'singleton' END, count(*), count(*) FILTER ((country, nk) IN (SELECT (country, nk) FROM nko)) FROM nk GROUP BY 1""")
def key_overlap(spark, sf_dir):
    r = Records(spark, sf_dir)
    return profile.key_overlap(r.primary, r.secondary, tables.truth_pairs(r.lists))


_FORMS = {
    "domain": "regexp_matches(business_name, '(?i)\\.(com|in|net|org|co)([^\\p{L}\\p{N}_]|$)')",
    "dba": "regexp_matches(business_name, '(?i)doing business as|(^|[^\\p{L}\\p{N}_])dba([^\\p{L}\\p{N}_]|$)|t/a|trading as')",
    "deva": "false",
    "allcaps": "regexp_matches(business_name, '^[^a-z]*$')",
    "junkpunct": "regexp_matches(business_name, '[\\[\\]()<>#\\-]{2,}|^[^A-Za-z0-9]')",
    "addr_empty": "business_address = ''",
}


@query(WITH + f" SELECT {_SRC}, country, " + ", ".join(f"{_SHARE.format(c=c)} AS {n}" for n, c in _FORMS.items()) + " FROM records GROUP BY ALL")
def name_form_rates(spark, sf_dir):
    return six(profile.name_forms(_sourced(Records(spark, sf_dir).every)), *_FORMS)


_QUANT = ", ".join([f"round(quantile_cont(aj, {p}) FILTER (NOT e), 6) AS aj_q{round(100 * p)}" for p in (0.01, 0.05, 0.1, 0.25, 0.5)] + [f"round(quantile_cont(nj, {p}), 6) AS nj_q{round(100 * p)}" for p in (0.01, 0.05, 0.1, 0.25, 0.5)])


@query(_SETS + f", v AS (SELECT {_JACCARD.format(c='n')} AS nj, {_JACCARD.format(c='a')} AS aj, len(list_intersect({_NUMS.format(c='p.a')}, {_NUMS.format(c='q.a')})) > 0 AS sn, q.e FROM truth JOIN w p ON p.entity_id = s JOIN w q ON q.entity_id = x) SELECT {_QUANT}, round(avg(CASE WHEN sn THEN 1.0 ELSE 0 END) FILTER (NOT e), 6) AS share_number, round(avg(CASE WHEN nj = 0 THEN 1.0 ELSE 0 END), 6) AS nj_zero, round(avg(CASE WHEN nj < 0.2 AND aj < 0.3 THEN 1.0 ELSE 0 END), 6) AS both_weak FROM v")
def jaccard_quantiles(spark, sf_dir):
    r = Records(spark, sf_dir)
    out = profile.weakness(_word_pairs(spark, sf_dir, tables.truth_pairs(r.lists)))
    return six(out, *out.columns)


@query(DUP + ", al AS (SELECT country, nk, count(*) AS c FROM nko WHERE entity_id NOT IN (SELECT x FROM truth) GROUP BY ALL) SELECT (SELECT round(avg(CASE WHEN nk.nk = nko.nk THEN 1.0 ELSE 0 END), 6) FROM truth JOIN nk ON nk.entity_id = s JOIN nko ON nko.entity_id = x) AS own_key, (SELECT round(sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c), 6) FROM al) AS unmatched_shared")
def key_rates(spark, sf_dir):
    r = Records(spark, sf_dir)
    return six(profile.key_rates(r.primary, r.secondary, tables.truth_pairs(r.lists)), "own_key", "unmatched_shared")


@query(_SETS + f", v AS (SELECT s, x, {_JACCARD.format(c='n')} AS nj, {_JACCARD.format(c='a')} AS aj FROM fp JOIN w p ON p.entity_id = s JOIN w q ON q.entity_id = x) SELECT s, x, round(nj, 6) AS nj, round(aj, 6) AS aj FROM v WHERE nj < 0.2 AND aj < 0.35 ORDER BY v.nj, v.aj, s, x LIMIT 15")
def weakest_pairs(spark, sf_dir):
    return six(profile.weakest(_word_pairs(spark, sf_dir)), "nj", "aj")


@query(BEST + ", m AS (SELECT s, x FROM best WHERE q > 0.3) SELECT m.s, m.x, coalesce(o.owner, -1) AS owner FROM m LEFT JOIN (SELECT x, min(s) AS owner FROM truth GROUP BY x) o USING (x) WHERE (m.s, m.x) NOT IN (SELECT (s, x) FROM truth)")
def false_positives(spark, sf_dir):
    v = Vectors(spark, sf_dir)
    return evaluate.false_positives(decide.above(decide.exclusive(v.pairs), 0.3), v.truth).fillna(-1, ["owner"])


# --- models ---


def _model_pairs(spark, sf_dir) -> DataFrame:
    v = Vectors(spark, sf_dir)
    known = folds.labelled(v.pairs.select("s", "x", "sim", "rx", "rs", "p"), v.truth)
    return known.withColumn("f", folds.fold(F.col("s").cast("string")))


@query()
def stage1_gbt(spark, sf_dir):
    rows = _model_pairs(spark, sf_dir)
    fitted = models.fit_folds(rows, ["sim", "rx", "rs"], maxIter=10, maxDepth=4, minInstancesPerNode=20)
    return fitted.score(rows, "q").select("s", "x", "y", "f", F.round("q", 6).alias("q"))


@query(VECTORS + f" SELECT s, x, round(CASE CAST({_HASH.format(c='CAST(s AS VARCHAR)')} % 5 AS INT) WHEN 3 THEN q WHEN 4 THEN p ELSE (p + q) / 2 END, 6) AS p1 FROM pairs")
def oof_score(spark, sf_dir):
    rows = Vectors(spark, sf_dir).pairs.withColumn("f", folds.fold(F.col("s").cast("string")))
    return six(rows.select("s", "x", models.out_of_fold(F.col("f"), F.col("p"), F.col("q")).alias("p1")), "p1")


@query()
def joint_scorer(spark, sf_dir):
    r = Records(spark, sf_dir)
    text = r.every.select("entity_id", normalize.pair_text(F.col("business_name"), F.col("business_address")).alias("text"))
    pairs = features.gathered(folds.labelled(r.pairs, tables.truth_pairs(r.lists)), text, text, ["text"]).select("s", "x", F.col("s_text").alias("text_s"), F.col("x_text").alias("text_x"), "y")
    return models.PairScorer(20).fit(pairs).score(pairs).select("s", "x", "y", F.round("ce", 6).alias("ce"))
