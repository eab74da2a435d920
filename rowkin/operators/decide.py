"""Decisions: one entity per record, thresholds, and the expected-F0.5 prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("th0.3", "th0.4", "th0.5", "th0.6", "th0.7", "th0.8", "expF")


def exclusive(scores: DataFrame, q: str = "q") -> DataFrame:
    """Each record's best pair; of equal scores the smallest entity."""
    return scores.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy(F.desc(q), "s"))).filter("r = 1").drop("r")


def above(best: DataFrame, threshold: float = 0.7, q: str = "q") -> DataFrame:
    return best.filter(F.col(q) > threshold)


def above_by_group(best: DataFrame, thresholds: dict[str, float], default: float = 0.7, group: str = "country", q: str = "q") -> DataFrame:
    """Pairs over the threshold of their group; groups without one take the default."""
    limit = F.coalesce(*(F.when(F.col(group) == g, F.lit(t)) for g, t in thresholds.items()), F.lit(default)) if thresholds else F.lit(default)
    return best.filter(F.col(q) > limit)


def _convolved(qs: Column) -> Column:
    """The distribution of the number of successes: after each chance q, p'[i] = p[i] (1 - q) + p[i-1] q."""
    grow = lambda p, q: F.zip_with(F.concat(p, F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), p), lambda stay, came: stay * (1 - q) + came * q)
    return F.aggregate(qs, F.array(F.lit(1.0)), grow)


def _without(total: Column, q: Column) -> Column:
    """The distribution without one of its chances, of which it was convolved; from the side where errors shrink."""
    last = lambda done: F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0.0))
    n, none = F.size(total) - 1, F.array().cast("array<double>")
    up = F.aggregate(F.slice(total, 1, n), none, lambda done, p: F.concat(done, F.array((p - q * last(done)) / (1 - q))))
    down = F.aggregate(F.reverse(F.slice(total, 2, n)), none, lambda done, p: F.concat(done, F.array((p - (1 - q) * last(done)) / q)))
    return F.when(q <= 0.5, up).otherwise(F.reverse(down))


def expected_scores(best: DataFrame, q: str = "q", least: float = 0.02) -> DataFrame:
    """(s, qs, xs, e): each entity's candidates by falling score, and the exact expected F0.5 of keeping the first k of them, k from 0.

    Candidates are true independently with chance q; F0.5 = 1.25 tp / (k + 0.25 t). Each kept candidate contributes q times the mean of 1.25 / (k + 0.25 (1 + others)), where the
    others' number has the distribution of all without this one. These distributions, weighted by q, are summed up from prefix to prefix, so the work grows with the square of
    an entity's candidates.
    """
    some = best.filter(F.col(q) > least).groupBy("s").agg(F.array_sort(F.collect_list(F.struct((-F.col(q).cast("double")).alias("m"), "x"))).alias("l"))
    some = some.select("s", F.transform("l", lambda t: -t["m"]).alias("qs"), F.transform("l", lambda t: t["x"]).alias("xs"))
    # kept apart from the step below, which reads it once for each candidate
    some = some.withColumn("total", F.transform(F.array("qs"), _convolved)[0])
    zeros, empty = F.transform("qs", lambda _: F.lit(0.0)), F.array().cast("array<double>")

    def step(state: Column, chance: Column) -> Column:
        k = F.size(state["e"]) + 1
        hits = F.zip_with(state["hits"], _without(F.col("total"), chance), lambda m, r: m + chance * r)
        gain = lambda h: F.aggregate(F.transform(h, lambda m, t: 1.25 * m / (k + 0.25 * (t + 1))), F.lit(0.0), lambda s, v: s + v)
        return F.transform(F.array(hits), lambda h: F.struct(h.alias("hits"), F.concat(state["e"], F.array(gain(h))).alias("e")))[0]

    kept = F.aggregate("qs", F.struct(zeros.alias("hits"), empty.alias("e")), step, lambda state: state["e"])
    return some.select("s", "qs", "xs", F.concat(F.slice("total", 1, 1), kept).alias("e"))


def expected_f05(best: DataFrame, q: str = "q", least: float = 0.02) -> DataFrame:
    """(s, x, q) of the prefixes with the greatest expected F0.5; of equal ones the shorter."""
    chosen = expected_scores(best, q, least).withColumn("k", F.array_position(F.transform("e", lambda v: F.round(v, 12)), F.array_max(F.transform("e", lambda v: F.round(v, 12)))).cast("int") - 1)
    return chosen.filter("k > 0").select("s", F.explode(F.arrays_zip(F.slice("xs", 1, F.col("k")).alias("x"), F.slice("qs", 1, F.col("k")).alias("q"))).alias("t")).select("s", F.col("t.x").alias("x"), F.col("t.q").alias("q"))


def predictions(best: DataFrame, method: str, q: str = "q") -> DataFrame:
    """(s, x) by the name of a method: th<threshold> or expF."""
    return (expected_f05(best, q) if method == "expF" else above(best, float(method.removeprefix("th")), q)).select("s", "x")


def choose_method(best: DataFrame, truth: DataFrame, keys: DataFrame, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(method, score, chosen): macro F0.5 of every method over the given entities; the greatest is chosen, of equal ones the first listed.

    Every pair is flagged with the methods that pick it, and all methods are counted in one aggregation by entity.
    """
    true = truth.select("s", "x").distinct()
    rows = best.select("s", "x", "q").join(true.withColumn("hit", F.lit(1)), ["s", "x"], "left")
    if "expF" in methods:
        rows = rows.join(expected_f05(best).select("s", "x").withColumn("prefix", F.lit(True)), ["s", "x"], "left")
    picks = [F.coalesce("prefix", F.lit(False)) if m == "expF" else F.col("q") > float(m.removeprefix("th")) for m in methods]
    counts = rows.groupBy("s").agg(*(F.count_if(pick).alias(f"p{k}") for k, pick in enumerate(picks)), *(F.count_if(pick & (F.col("hit") == 1)).alias(f"t{k}") for k, pick in enumerate(picks)))
    every = keys.select("s").join(counts, "s", "left").join(true.groupBy("s").agg(F.count(F.lit(1)).alias("nt")), "s", "left").fillna(0)
    f05 = lambda k: F.when((F.col(f"p{k}") == 0) & (F.col("nt") == 0), 1.0).when(F.col(f"t{k}") == 0, 0.0).otherwise(1.25 * F.col(f"t{k}") / (F.col(f"p{k}") + 0.25 * F.col("nt")))
    means = every.agg(*(F.avg(f05(k)).alias(f"m{k}") for k in range(len(methods))))
    each = means.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(m).alias("method"), F.col(f"m{k}").alias("score")) for k, m in enumerate(methods)))).alias("e")).select("e.*")
    first = F.row_number().over(Window.orderBy(F.desc(F.round("score", 12)), "k")) == 1  # as many rows as methods
    return each.withColumn("chosen", first).drop("k")


def variant_report(picked: DataFrame, entities: DataFrame, group: str = "country") -> DataFrame:
    """(country, matches, empty): mean matches per entity and share of entities without any."""
    n = picked.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    return entities.select("s", group).join(n, "s", "left").fillna(0, ["n"]).groupBy(group).agg(F.avg("n").alias("matches"), F.avg((F.col("n") == 0).cast("double")).alias("empty"))
