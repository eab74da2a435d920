"""Metrics and diagnostics of linkage results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f05(tp: Column, predicted: Column, true: Column) -> Column:
    """1.25 PR / (0.25 P + R); 1 where nothing is true or predicted, 0 without a hit."""
    return F.when((predicted == 0) & (true == 0), 1.0).when(tp == 0, 0.0).otherwise(1.25 * tp / (predicted + 0.25 * true))


def per_entity(predicted: DataFrame, truth: DataFrame, keys: DataFrame) -> DataFrame:
    """(s, nt, np, tp) for every key: distinct true, predicted and common pairs. Each side is reduced to distinct pairs before the full join."""
    t, p = (df.select("s", "x").distinct().withColumn(n, F.lit(1)) for df, n in ((truth, "t"), (predicted, "p")))
    both = t.join(p, ["s", "x"], "full").groupBy("s").agg(F.count("t").alias("nt"), F.count("p").alias("np"), F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"))
    return keys.select("s").distinct().join(both, "s", "left").fillna(0)


def macro_f05(predicted: DataFrame, truth: DataFrame, keys: DataFrame) -> DataFrame:
    """(f05, n): the mean over the key entities, those without true matches included."""
    each = per_entity(predicted, truth, keys)
    return each.agg(F.avg(f05(F.col("tp"), F.col("np"), F.col("nt"))).alias("f05"), F.count(F.lit(1)).alias("n"))


def recall_grid(candidates: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 5, 10, 20), unions: tuple[tuple[int, int], ...] = ((2, 5), (3, 5), (3, 10), (5, 10), (5, 20))) -> DataFrame:
    """(cut, recall, pairs): share of true pairs kept, and pairs kept, by cuts rx<k and rx<a|rs<b. All cuts are counted in one pass over each side."""
    cuts = {f"rx<{k}": F.col("rx") < k for k in ks} | {f"rx<{a}|rs<{b}": (F.col("rx") < a) | (F.col("rs") < b) for a, b in unions}
    true = truth.select("s", "x").distinct()
    hit = true.join(candidates.select("s", "x", "rx", "rs"), ["s", "x"], "left").agg(*(F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(str(k)) for k, c in enumerate(cuts.values())))
    kept = candidates.agg(*(F.count_if(c).alias(f"n{k}") for k, c in enumerate(cuts.values())))
    table = F.array(*(F.struct(F.lit(name).alias("cut"), F.col(str(k)).alias("recall"), F.col(f"n{k}").alias("pairs")) for k, name in enumerate(cuts)))
    return hit.withColumn("j", F.lit(1)).join(kept.withColumn("j", F.lit(1)), "j").select(F.explode(table).alias("t")).select("t.*")


def error_breakdown(predicted: DataFrame, truth: DataFrame, candidates: DataFrame, keys: DataFrame) -> DataFrame:
    """Per key entity: nt, np, tp, miss_cand, miss_model, fp, f05 and the category of its error."""
    t, p, c = (df.select("s", "x").distinct().withColumn(n, F.lit(1)) for df, n in ((truth, "t"), (predicted, "p"), (candidates, "c")))
    pairs = t.join(p, ["s", "x"], "full").join(c, ["s", "x"], "left").fillna(0, ["t", "p", "c"])
    missed = (F.col("t") == 1) & (F.col("p") == 0)
    each = pairs.groupBy("s").agg(F.sum("t").alias("nt"), F.sum("p").alias("np"), F.sum(F.col("t") * F.col("p")).alias("tp"), F.count_if(missed & (F.col("c") == 0)).alias("miss_cand"), F.count_if(missed & (F.col("c") == 1)).alias("miss_model"), F.count_if((F.col("t") == 0) & (F.col("p") == 1)).alias("fp"))
    each = keys.select("s").distinct().join(each, "s", "left").fillna(0).withColumn("f05", f05(F.col("tp"), F.col("np"), F.col("nt")))
    category = (
        F.when((F.col("nt") == 0) & (F.col("np") > 0), "singleton_but_predicted")
        .when((F.col("nt") > 0) & (F.col("np") == 0), "has_match_predicted_empty")
        .when(F.col("fp") > 0, "has_false_positive")
        .when(F.col("miss_cand") + F.col("miss_model") > 0, "only_misses")
        .otherwise("perfect")
    )
    return each.withColumn("category", category)


def loss_shares(breakdown: DataFrame) -> DataFrame:
    """(category, n, loss_share): what each category costs of the mean score."""
    total = breakdown.agg(F.count(F.lit(1)).alias("total"))
    each = breakdown.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("f05")).alias("loss"))
    return each.withColumn("j", F.lit(1)).join(total.withColumn("j", F.lit(1)), "j").select("category", "n", (F.col("loss") / F.col("total")).alias("loss_share"))


def best_of_record(scores: DataFrame, q: str = "q") -> DataFrame:
    """(x, best_s, best_q): combined before the shuffle; of equal scores the smallest entity."""
    top = scores.groupBy("x").agg(F.max(q).alias("best_q"))
    at = scores.join(top, "x").filter(F.col(q) == F.col("best_q")).groupBy("x", "best_q").agg(F.min("s").alias("best_s"))
    return at.select("x", "best_s", "best_q")


def miss_categories(truth: DataFrame, scores: DataFrame) -> DataFrame:
    """(s, x, q, best_s, best_q, category) of every true pair: where it stands or was lost."""
    pairs = truth.select("s", "x").distinct().join(scores.select("s", "x", "q"), ["s", "x"], "left").join(best_of_record(scores), "x", "left")
    category = F.when(F.col("q").isNull(), "not_candidate").when(F.col("best_s") != F.col("s"), "lost_to_other_S1").when(F.col("q") < 0.3, "own_best_q<0.3").when(F.col("q") < 0.7, "own_best_q0.3-0.7").otherwise("own_best_q>=0.7")
    return pairs.withColumn("category", category)


def miss_report(misses: DataFrame) -> DataFrame:
    """(category, n, q10, q50, q90): exact quantiles of the winning score by category."""
    return misses.groupBy("category").agg(F.count(F.lit(1)).alias("n"), *(F.percentile("best_q", F.lit(p)).alias(f"q{round(100 * p)}") for p in (0.1, 0.5, 0.9)))


BINS = ((-1.0, 0.02), (0.02, 0.2), (0.2, 0.5), (0.5, 0.8), (0.8, 0.95), (0.95, 2.0))


def shift_report(scores: DataFrame, entities: int) -> DataFrame:
    """One row: records per entity, shares of the best score's bins, strong, ambiguous and contested records per entity. ``scores``: s, x, p, q."""
    of_x = scores.groupBy("x").agg(F.max("q").alias("qm"), F.count_if(F.col("p") > 0.3).alias("rivals"))
    per = lambda c: F.count_if(c) / F.lit(float(entities))
    bins = [F.avg(((F.col("qm") > a) & (F.col("qm") <= b)).cast("double")).alias(f"bin{k}") for k, (a, b) in enumerate(BINS)]
    return of_x.agg(F.count(F.lit(1)).alias("records"), (F.count(F.lit(1)) / F.lit(float(entities))).alias("per_entity"), *bins, per(F.col("qm") > 0.5).alias("strong"), per((F.col("qm") > 0.2) & (F.col("qm") < 0.8)).alias("ambiguous"), per(F.col("rivals") > 1).alias("contested"))


def strong_histogram(scores: DataFrame, cap: int = 12) -> DataFrame:
    """(strong, n): entities by their number of records with p over 0.5, capped."""
    each = scores.filter(F.col("p") > 0.5).groupBy("s").agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("strong"))
    return each.groupBy("strong").agg(F.count(F.lit(1)).alias("n"))


def ambiguity(scores: DataFrame, entities: DataFrame, group: str = "country") -> DataFrame:
    """(country, ambig, hi): shares of records whose best score is between .2 and .8, and above .5, by the country of their best entity."""
    best = best_of_record(scores).join(entities.select(F.col("s").alias("best_s"), group), "best_s")
    return best.groupBy(group).agg(F.avg(((F.col("best_q") > 0.2) & (F.col("best_q") < 0.8)).cast("double")).alias("ambig"), F.avg((F.col("best_q") > 0.5).cast("double")).alias("hi"))


def uncertain_cases(scores: DataFrame, top: int = 3) -> DataFrame:
    """(x, s, q, r): the top candidates of every record whose best score is between .2 and .8."""
    each = scores.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(F.desc("q"), "s"))).filter(F.col("r") <= top)
    unsure = each.filter((F.col("r") == 1) & (F.col("q") > 0.2) & (F.col("q") < 0.8)).select("x")
    return each.join(unsure, "x", "left_semi").select("x", "s", "q", "r")


def false_positives(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(s, x, owner): predicted pairs that are not true, with the record's true entity (null: none)."""
    wrong = predicted.select("s", "x").distinct().join(truth.select("s", "x").distinct(), ["s", "x"], "left_anti")
    return wrong.join(truth.groupBy("x").agg(F.min("s").alias("owner")), "x", "left").select("s", "x", "owner")
