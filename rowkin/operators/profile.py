"""Profiles of sources and ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkin.functions.scripts import INDIC
from rowkin.operators.normalize import loose_clean, name_key

# The forms that are counted.
NAME_FORMS = {
    "domain": r"(?i)\.(com|in|net|org|co)(?![\p{L}\p{N}_])",
    "dba": r"(?i)doing business as|(?<![\p{L}\p{N}_])dba(?![\p{L}\p{N}_])|t/a|trading as",
    "deva": "[ऀ-ॿ]",
    "allcaps": "^[^a-z]*$",
    "junkpunct": r"[\[\]()<>#\-]{2,}|^[^A-Za-z0-9ऀ-ॿ]",
}


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def source_shapes(records: DataFrame) -> DataFrame:
    """(src, country, n, name_indic, addr_indic, name_empty, addr_empty)."""
    return records.groupBy("src", "country").agg(F.count(F.lit(1)).alias("n"), share(F.col("business_name").rlike(INDIC)).alias("name_indic"), share(F.col("business_address").rlike(INDIC)).alias("addr_indic"), share(F.col("business_name") == "").alias("name_empty"), share(F.col("business_address") == "").alias("addr_empty"))


def truth_profile(lists: DataFrame, truth: DataFrame, primary: DataFrame, records: DataFrame) -> DataFrame:
    """One row on the ground truth. ``lists``: source1_entity_id, matched_entity_ids; ``truth``: its pairs (s, x); sources: entity_id, country, records with src."""
    n = F.size(F.filter(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda t: t != ""))
    rows = lists.select(F.col("source1_entity_id").alias("s"), n.alias("n"))
    a = rows.agg(F.count(F.lit(1)).alias("entities"), share(F.col("n") == 0).alias("singleton_rate"), F.avg("n").alias("mean_matches"), F.max("n").alias("most_matches"))
    b = truth.agg(F.count(F.lit(1)).alias("pairs"), (F.count(F.lit(1)) - F.countDistinct("x")).alias("violations"))
    known = records.select(F.col("entity_id").alias("x"), F.col("country").alias("cx"), "src")
    c = truth.join(known, "x", "left").join(primary.select(F.col("entity_id").alias("s"), "country"), "s", "left").agg(F.count_if(F.col("src").isNull()).alias("missing_ids"), share(F.col("cx") == F.col("country")).alias("country_agree"))
    d = known.join(truth.select("x").distinct().withColumn("m", F.lit(1)), "x", "left").agg(*(F.avg(F.when(F.col("src") == k, F.col("m").isNotNull().cast("double"))).alias(f"matched_{k}") for k in (2, 3)))
    one = lambda df: df.withColumn("j", F.lit(1))  # noqa: E731  each has one row
    return one(a).join(one(b), "j").join(one(c), "j").join(one(d), "j").drop("j")


def match_counts(lists: DataFrame) -> DataFrame:
    """(n, n2, n3, entities): how many entities have so many matches of each secondary source."""
    ids = F.filter(F.split(F.coalesce("matched_entity_ids", F.lit("")), ","), lambda t: t != "")
    rows = lists.select(F.size(ids).alias("n"), F.size(F.filter(ids, lambda t: t.startswith("S2-"))).alias("n2"))
    return rows.groupBy("n", "n2").agg(F.count(F.lit(1)).alias("entities")).select("n", "n2", (F.col("n") - F.col("n2")).alias("n3"), "entities")


def equality_rates(both: DataFrame) -> DataFrame:
    """(src, country, name_eq, addr_eq): shares of true pairs with equal loose names and addresses. ``both``: gathered pairs."""
    same = lambda c: share(loose_clean(F.col(f"s_{c}")) == loose_clean(F.col(f"x_{c}")))
    return both.groupBy(F.col("x_src").alias("src"), F.col("s_country").alias("country")).agg(same("business_name").alias("name_eq"), same("business_address").alias("addr_eq"))


def duplicate_structure(primary: DataFrame) -> DataFrame:
    """One row: shares of rows that share their name key in the country or their address, and rows beyond the first of equal name and address."""
    keyed = primary.withColumn("nk", name_key(F.col("business_name")))
    shared = lambda keys, n: keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg((F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c")).alias(n)).withColumn("j", F.lit(1))
    exact = primary.groupBy("business_name", "business_address").count().agg((F.sum("count") - F.count(F.lit(1))).alias("exact_duplicates")).withColumn("j", F.lit(1))
    return shared(["country", "nk"], "shared_key").join(shared(["business_address"], "shared_address"), "j").join(exact, "j").drop("j")


def top_keys(primary: DataFrame, most: int = 15) -> DataFrame:
    """(nk, n): the most repeated name keys."""
    return primary.groupBy(name_key(F.col("business_name")).alias("nk")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "nk").limit(most)


def key_overlap(primary: DataFrame, records: DataFrame, truth: DataFrame) -> DataFrame:
    """(part, n, hits): matched and unmatched records whose name key is one of the primary source's, and entities with and without matches whose key is one of the records'."""
    key = lambda df: df.select("entity_id", "country", name_key(F.col("business_name")).alias("nk"))
    ours, theirs = key(primary), key(records)
    of = lambda df, other, name: df.join(other.select("country", "nk").distinct().withColumn("h", F.lit(1)), ["country", "nk"], "left").agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.count("h").alias("hits")).select("part", "n", "hits")
    x, s = truth.select(F.col("x").alias("entity_id")), truth.select(F.col("s").alias("entity_id"))
    return (
        of(theirs.join(x, "entity_id", "left_semi"), ours, "matched")
        .unionByName(of(theirs.join(x, "entity_id", "left_anti"), ours, "unmatched"))
        .unionByName(of(ours.join(s, "entity_id", "left_semi"), theirs, "with_match"))
        .unionByName(of(ours.join(s, "entity_id", "left_anti"), theirs, "singleton"))
    )


def name_forms(records: DataFrame) -> DataFrame:
    """(src, country, and the share of each name form and of empty addresses)."""
    return records.groupBy("src", "country").agg(*(share(F.col("business_name").rlike(p)).alias(n) for n, p in NAME_FORMS.items()), share(F.col("business_address") == "").alias("addr_empty"))


def weakness(pairs: DataFrame) -> DataFrame:
    """One row of quantiles and shares over true pairs with nj, aj, share_number, addr_empty."""
    points = (0.01, 0.05, 0.1, 0.25, 0.5)
    address = F.when(~F.col("addr_empty"), F.col("aj"))
    return pairs.agg(
        *(F.percentile(address, F.lit(p)).alias(f"aj_q{round(100 * p)}") for p in points),
        *(F.percentile("nj", F.lit(p)).alias(f"nj_q{round(100 * p)}") for p in points),
        F.avg(F.when(~F.col("addr_empty"), F.col("share_number").cast("double"))).alias("share_number"),
        share(F.col("nj") == 0).alias("nj_zero"),
        share((F.col("nj") < 0.2) & (F.col("aj") < 0.3)).alias("both_weak"),
    )


def key_rates(primary: DataFrame, records: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: the share of true pairs whose name keys are equal, and of unmatched records whose key another unmatched record of the country has."""
    key = lambda df, id_: df.select(F.col("entity_id").alias(id_), "country", name_key(F.col("business_name")).alias(f"nk_{id_}"))
    ours, theirs = key(primary, "s"), key(records, "x")
    own = truth.join(ours.drop("country"), "s").join(theirs.drop("country"), "x").agg(share(F.col("nk_s") == F.col("nk_x")).alias("own_key"))
    alone = theirs.join(truth.select("x"), "x", "left_anti").groupBy("country", "nk_x").agg(F.count(F.lit(1)).alias("c"))
    shared = alone.agg((F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("unmatched_shared"))
    return own.withColumn("j", F.lit(1)).join(shared.withColumn("j", F.lit(1)), "j").drop("j")


def weakest(pairs: DataFrame, most: int = 15) -> DataFrame:
    """(s, x, nj, aj): the true pairs with the least word overlap of names, then of addresses."""
    return pairs.filter((F.col("nj") < 0.2) & (F.col("aj") < 0.35)).orderBy("nj", "aj", "s", "x").limit(most).select("s", "x", "nj", "aj")
