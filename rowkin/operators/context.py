"""Competition features: where a pair stands among the pairs of its record (x) and of its entity (s).

A record has at most as many pairs as retrieval gives it (k), so windows by record are small. An entity's pairs have no such bound: every record may name it among its first. Sums,
counts and maxima by entity are therefore aggregated before they are shuffled, and joined; only the rank by entity sorts an entity's pairs, by id and score alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _record():
    return Window.partitionBy("x")


def _by_entity(pairs: DataFrame, rank: dict[str, str], **values: Column) -> DataFrame:
    """``pairs`` with aggregates by entity, and the rank by falling score of each named column."""
    out = pairs.join(pairs.groupBy("s").agg(*(c.alias(n) for n, c in values.items())), "s")
    for name, score in rank.items():
        out = out.withColumn(name, F.row_number().over(Window.partitionBy("s").orderBy(F.desc(score), "x")))
    return out


def _competition_x(pairs: DataFrame, p: str) -> DataFrame:
    by_record = _record()
    by_x = pairs.withColumn("p", F.col(p).cast("double")).withColumns({
        "p_rank_x": F.row_number().over(by_record.orderBy(F.desc("p"), "s")),
        "p_max_x": F.max("p").over(by_record),
        "p_sum_x": F.sum("p").over(by_record),
        "n_x": F.count(F.lit(1)).over(by_record),
    })
    by_x = by_x.withColumn("p2_x", F.max(F.when(F.col("p_rank_x") == 2, F.col("p")).otherwise(0.0)).over(by_record))
    first = F.col("p_rank_x") == 1
    return by_x.withColumns({"gap_x": F.col("p") - F.col("p_max_x"), "other_x": F.col("p_sum_x") - F.col("p"), "margin_x": F.col("p") - F.when(first, F.col("p2_x")).otherwise(F.col("p_max_x"))}).drop("p2_x")


def _competition_s() -> dict[str, Column]:
    return {"p_max_s": F.max("p"), "n_hi_s": F.count_if(F.col("p") > 0.5), "p_sum_s": F.sum("p"), "n_s": F.count(F.lit(1))}


def _scorer_x(pairs: DataFrame, e: str) -> DataFrame:
    by_record = _record()
    found = pairs.withColumns({f"{e}_rank_x": F.row_number().over(by_record.orderBy(F.desc(e), "s")), f"{e}_max_x": F.max(e).over(by_record)})
    second = F.max(F.when(F.col(f"{e}_rank_x") == 2, F.col(e)).otherwise(-99.0)).over(by_record)
    found = found.withColumns({f"{e}_gap_x": F.col(e) - F.col(f"{e}_max_x"), "second": second})
    return found.withColumn(f"{e}_margin_x", F.col(e) - F.when(F.col(f"{e}_rank_x") == 1, F.col("second")).otherwise(F.col(f"{e}_max_x"))).drop("second")


def _extra_x(pairs: DataFrame, e: str) -> DataFrame:
    by_record = _record()
    return pairs.withColumns({f"{e}_rank_x": F.row_number().over(by_record.orderBy(F.desc(e), "s")), f"{e}_gap_x": F.col(e) - F.max(e).over(by_record)})


def _high(e: str) -> dict[str, Column]:
    return {f"{e}_hi_s": F.count_if(F.col(e) > 0)}


def competition(pairs: DataFrame, p: str = "p") -> DataFrame:
    """13 columns around the score: p and its rank, maximum, sum and count by record and entity, high scores by entity, gaps and margin. Ties go to the smaller id."""
    return _by_entity(_competition_x(pairs, p), {"p_rank_s": "p"}, **_competition_s())


def scorer_competition(pairs: DataFrame, e: str = "ce") -> DataFrame:
    """A second scorer's standing: {e}_rank_x, _max_x, _gap_x, _margin_x (runner-up -99 if there is none), _rank_s, _hi_s (scores over 0)."""
    return _by_entity(_scorer_x(pairs, e), {f"{e}_rank_s": e}, **_high(e))


def extra_round(pairs: DataFrame, e: str) -> DataFrame:
    """A later scorer's three columns: {e}_rank_x, _gap_x, _hi_s."""
    return _by_entity(_extra_x(pairs, e), {}, **_high(e))


def all_rounds(pairs: DataFrame, p: str, scorers: tuple[str, ...]) -> DataFrame:
    """``competition``, ``scorer_competition`` of the first scorer and ``extra_round`` of the others together, with one aggregation by entity."""
    out, ranks, values = _competition_x(pairs, p), {"p_rank_s": "p"}, _competition_s()
    for k, e in enumerate(scorers):
        out, values = (_extra_x if k else _scorer_x)(out, e), values | _high(e)
        if not k:
            ranks[f"{e}_rank_s"] = e
    return _by_entity(out, ranks, **values)


def sibling_rank(pairs: DataFrame) -> DataFrame:
    """sib_rank_x: the rank of sib_cos among the record's pairs; a pair without it comes last."""
    return pairs.withColumn("sib_rank_x", F.row_number().over(_record().orderBy(F.desc_nulls_last("sib_cos"), "s")))


def assembled(features: DataFrame, scores: DataFrame, scorers: dict[str, DataFrame], others: list[DataFrame], missing: float = -12.0) -> DataFrame:
    """All columns of a pair by (s, x): scored pairs only; a missing scorer value becomes ``missing``, other misses stay null."""
    out = features.join(scores, ["s", "x"])
    for name, df in scorers.items():
        out = out.join(df, ["s", "x"], "left").fillna(missing, [name])
    for df in others:
        out = out.join(df, ["s", "x"], "left")
    return out


def sibling_consensus(pairs: DataFrame, entities: DataFrame, records: DataFrame, least: float = 0.1) -> DataFrame:
    """(s, x, sib_cos, sib_w, s1_sib_cos, sib_minus_s1): the record, and the entity, against the weighted centroid of the entity's other records.

    ``pairs``: s, x, p; ``entities``: s, e; ``records``: x, e. Weights are p over ``least``, else 0. Vector sums are partial by element before the shuffle. With a remaining
    weight of 0.001 or less sib_cos is -1.
    """
    w = F.when(F.col("p") > least, F.col("p").cast("double")).otherwise(0.0)
    base = pairs.select("s", "x", w.alias("w")).join(records.select("x", F.transform("e", lambda v: v.cast("double")).alias("ex")), "x")
    sums = base.select("s", "w", F.posexplode("ex").alias("d", "v")).groupBy("s", "d").agg(F.sum(F.col("w") * F.col("v")).alias("c"))
    centre = sums.groupBy("s").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "c"))), lambda t: t["c"]).alias("c"))
    total = base.groupBy("s").agg(F.sum("w").alias("t"))
    each = base.join(centre, "s").join(total, "s").join(entities.select("s", F.transform("e", lambda v: v.cast("double")).alias("es")), "s")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    each = each.withColumns({"o": F.zip_with("c", "ex", lambda c, v: c - v * F.col("w")), "sib_w": F.col("t") - F.col("w")})
    norm = F.greatest(F.sqrt(dot("o", "o")), F.lit(1e-6))
    each = each.withColumns({"sib_cos": F.when(F.col("sib_w") > 1e-3, dot("ex", "o") / norm).otherwise(-1.0), "s1_sib_cos": dot("es", "o") / norm})
    return each.select("s", "x", "sib_cos", "sib_w", "s1_sib_cos", (F.col("sib_cos") - F.col("s1_sib_cos")).alias("sib_minus_s1"))
