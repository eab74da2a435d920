"""Pair features of two normalised records: string scores, weighted overlap, numbers, metadata and generic words. See ``STAGE1`` for the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkin.functions.strings import similarities
from rowkin.operators import tokens
from rowkin.operators.normalize import ADDRESS_STOP

# Names and order of the models' columns, down to STAGE2.
#: Feature: (scorer, field).
SCORES = {
    "n_ratio": ("ratio", "nn"), "n_tset": ("token_set_ratio", "nn"), "n_tsort": ("token_sort_ratio", "nn"), "n_part": ("partial_ratio", "nn"), "n_jw": ("jaro_winkler", "nn"),
    "nc_ratio": ("ratio", "nc"), "nc_tset": ("token_set_ratio", "nc"), "ncc_ratio": ("ratio", "ncc"), "nsp_ratio": ("ratio", "nsp"), "nsp_part": ("partial_ratio", "nsp"),
    "init_ratio": ("ratio", "init"), "raw_ratio": ("ratio", "business_name"),
    "a_ratio": ("ratio", "an"), "a_tset": ("token_set_ratio", "an"), "a_tsort": ("token_sort_ratio", "an"), "a_part": ("partial_ratio", "an"),
}
OVERLAPS = {"wn": ("nn", ()), "wa": ("an", tuple(ADDRESS_STOP)), "wc": ("ncc", ())}
NUMBERS = ("num_n1", "num_nx", "num_inter", "num_jac", "num_reldiff", "fnum_eq", "fnum_miss")
METADATA = ("x_nonlatin", "x_addr_empty", "x_is_domain", "x_src", "x_ln", "x_la", "x_nw", "s_ln", "s_la", "s_nw")
GENERIC = ("d_ratio", "d_tset", "d_part", "g_tset", "d_eq", "d_empty_x", "d_empty_s", "g_only_diff", "n_same_addr")
RETRIEVAL = ("sim", "rx", "rs")
STAGE1 = (*RETRIEVAL, *SCORES, *(f"{n}_{m}" for n in OVERLAPS for m in ("jac", "cont", "max", "sum")), *NUMBERS, *METADATA)
COMPETITION = ("p", "p_rank_x", "p_max_x", "p_sum_x", "n_x", "p_rank_s", "p_max_s", "n_hi_s", "p_sum_s", "n_s", "gap_x", "other_x", "margin_x")
KEPT = (*RETRIEVAL, "wa_cont", "wn_cont", "n_jw", "a_tset", "nsp_part", "num_inter", "x_src", "x_addr_empty", "x_nonlatin")
KEPT2 = (*KEPT, "n_tset", "nc_ratio", "a_ratio", "wa_jac", "num_jac", "num_reldiff", "fnum_eq", "x_is_domain")
#: Columns of the second model by version, each adding to the one before.
STAGE2 = {"v1": (*KEPT, *COMPETITION), "v2": (*KEPT2, *COMPETITION, "ce", "ce_rank_x", "ce_max_x", "ce_rank_s", "ce_hi_s", "ce_gap_x", "ce_margin_x")}
STAGE2["v3"] = (*STAGE2["v2"], "ce2", "ce2_rank_x", "ce2_gap_x", "ce2_hi_s", "sib_cos", "sib_w", "s1_sib_cos", "sib_minus_s1", "sib_rank_x")
STAGE2["v4"] = (*STAGE2["v3"], "ce3", "ce3_rank_x", "ce3_gap_x", "ce3_hi_s")
STAGE2["v5"] = (*STAGE2["v4"], *GENERIC)
STAGE2["v6"] = (*STAGE2["v5"], "ce4", "ce4_rank_x", "ce4_gap_x", "ce4_hi_s")


def gathered(pairs: DataFrame, left: DataFrame, right: DataFrame, columns: list[str], key: str = "entity_id") -> DataFrame:
    """``pairs`` (s, x) with both records' columns as s_<column> and x_<column>: two equi-joins by id."""
    side = lambda df, p: df.select(F.col(key).alias(p), *(F.col(c).alias(f"{p}_{c}") for c in columns))
    return pairs.join(side(left, "s"), "s").join(side(right, "x"), "x")


def string_scores(both: DataFrame, wanted: dict[str, tuple[str, str]] = SCORES) -> DataFrame:
    """All string scores of gathered pairs, in one Python pass. Pairs are dealt evenly first: scoring one takes far longer than moving it."""
    both = both.repartition("s", "x")
    found = similarities({n: (scorer, F.col(f"s_{c}"), F.col(f"x_{c}")) for n, (scorer, c) in wanted.items()})
    return both.withColumn("scores", found).select(*both.columns, "scores.*")


def number_scores(a: Column, b: Column) -> dict[str, Column]:
    """num_n1, num_nx, num_inter, num_jac (-1: both empty) and num_reldiff, the least relative difference (-1: one is empty), of two arrays of digit strings.

    Values are the first 12 digits; equal values of different writing meet.
    """
    value = lambda w: F.transform(w, lambda t: F.substring(t, 1, 12).cast("double"))
    left, right = value(a), value(b)
    n1, nx = F.size(a), F.size(b)
    inter = F.aggregate(left, F.lit(0), lambda s, v: s + F.size(F.filter(right, lambda w: w == v)))
    union = n1 + nx - inter
    differences = F.flatten(F.transform(left, lambda v: F.transform(right, lambda w: F.abs(v - w) / F.greatest(F.lit(1.0), v, w))))
    return {"num_n1": n1, "num_nx": nx, "num_inter": inter, "num_jac": F.when(union > 0, inter / union).otherwise(-1.0), "num_reldiff": F.coalesce(F.array_min(differences), F.lit(-1.0))}


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, "([0-9]+)", 1)


def first_number_flags(a: Column, b: Column) -> dict[str, Column]:
    left, right = first_number(a), first_number(b)
    return {"fnum_eq": ((left == right) & (left != "")).cast("int"), "fnum_miss": (right == "").cast("int")}


def metadata(records: DataFrame) -> DataFrame:
    """ln, la and nw: lengths of name and address, and the name's spaces."""
    return records.withColumns({"ln": F.length("nn"), "la": F.length("an"), "nw": F.length("nn") - F.length(F.replace("nn", F.lit(" "), F.lit("")))})


def pair_features(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs`` (s, x, sim, rx, rs) with all stage-1 columns; ``left`` and ``right`` are normalised records.

    Everything that belongs to a record, its token weights included, is put in one row first, so that pairs are joined once by each side.
    """
    fields = sorted({c for _, c in SCORES.values()} | {"nums", "nonlatin", "addr_empty", "is_domain", "src", "ln", "la", "nw"})
    every = metadata(left.unionByName(right))
    every = every.join(tokens.all_weights(every, OVERLAPS), "entity_id", "left").select("entity_id", *fields, *OVERLAPS)
    out = string_scores(gathered(pairs, every, every, [*fields, *OVERLAPS]))
    out = out.withColumns({**number_scores(F.col("s_nums"), F.col("x_nums")), **first_number_flags(F.col("s_an"), F.col("x_an"))})
    for name in OVERLAPS:
        out = tokens.overlapped(out, f"s_{name}", f"x_{name}", name)
    return out.select("s", "x", *(F.col(c).cast("double").alias(c) for c in STAGE1))


def generic_features(pairs: DataFrame, left: DataFrame, right: DataFrame, least: float = 0.002) -> DataFrame:
    """(s, x) with the generic-word columns: the names compared by their distinctive and their generic words, and the entity's address sharers."""
    parts = tokens.distinctive(left.unionByName(right), tokens.generic_tokens(left, least=least))
    both = gathered(pairs.select("s", "x"), parts, parts, ["d", "gs"])
    wanted = {"d_ratio": ("ratio", "d"), "d_tset": ("token_set_ratio", "d"), "d_part": ("partial_ratio", "d"), "g_tset": ("token_set_ratio", "gs")}
    equal = (F.col("s_d") == F.col("x_d")) & (F.col("s_d") != "")
    flags = {"d_eq": equal, "d_empty_x": F.col("x_d") == "", "d_empty_s": F.col("s_d") == "", "g_only_diff": equal & (F.col("s_gs") != F.col("x_gs"))}
    out = string_scores(both, wanted).withColumns({n: c.cast("int") for n, c in flags.items()})
    return out.join(tokens.same_address(left).withColumnRenamed("entity_id", "s"), "s").select("s", "x", *GENERIC)
