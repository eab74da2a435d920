"""Token rarity, weighted overlap and generic-word operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkin.operators.normalize import joined, tokens


def exploded(records: DataFrame, text: str, stop: list[str] | tuple = (), key: str = "entity_id", group: str = "country") -> DataFrame:
    """(key, group, t): the distinct tokens of each row, stop words left out."""
    words = F.array_distinct(tokens(F.col(text)))
    return records.select(key, group, F.explode(F.filter(words, lambda t: ~t.isin(list(stop))) if stop else words).alias("t"))


def token_idf(records: DataFrame, text: str, stop: list[str] | tuple = (), key: str = "entity_id", group: str = "country") -> DataFrame:
    """(group, t, df, n, idf): ln(rows of the group that have a token / rows that have this one)."""
    each = exploded(records, text, stop, key, group)
    df = each.groupBy(group, "t").agg(F.count(F.lit(1)).alias("df"))
    n = each.groupBy(group).agg(F.countDistinct(key).alias("n"))
    return df.join(n, group).withColumn("idf", F.log(F.col("n") / F.col("df")))


def weights(records: DataFrame, text: str, stop: list[str] | tuple = (), key: str = "entity_id", group: str = "country") -> DataFrame:
    """(key, w): each row's tokens with their rarity as a map; rows without tokens are absent."""
    each = exploded(records, text, stop, key, group).join(token_idf(records, text, stop, key, group).select(group, "t", "idf"), [group, "t"])
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "idf")))).alias("w"))


def all_weights(records: DataFrame, fields: dict[str, tuple[str, tuple]], key: str = "entity_id", group: str = "country") -> DataFrame:
    """(key, a map for each name in ``fields``): ``weights`` of several fields, {name: (field, stop words)}, by one explosion and one table of rarities; every row is there."""
    words = lambda text, stop: F.filter(F.array_distinct(tokens(F.col(text))), lambda t: ~t.isin(list(stop))) if stop else F.array_distinct(tokens(F.col(text)))
    named = lambda name: F.transform(name, lambda t: F.struct(F.lit(name).alias("f"), t.alias("t")))
    rows = records.select(key, group, *(words(text, stop).alias(name) for name, (text, stop) in fields.items()))
    each = rows.select(key, group, F.explode(F.concat(*map(named, fields))).alias("z")).select(key, group, "z.f", "z.t")
    df = each.groupBy(group, "f", "t").agg(F.count(F.lit(1)).alias("df"))
    n = rows.groupBy(group).agg(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.count_if(F.size(name) > 0) for name in fields))).alias("n"))
    idf = df.join(n, group).select(group, "f", "t", F.log(F.element_at("n", F.col("f")) / F.col("df")).alias("idf"))
    found = each.join(idf, [group, "f", "t"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("f", "t", "idf"))).alias("l"))
    of_field = lambda name: F.map_from_entries(F.transform(F.filter("l", lambda z: z["f"] == name), lambda z: F.struct(z["t"], z["idf"])))
    return found.select(key, *(of_field(name).alias(name) for name in fields))


def overlap(pairs: DataFrame, of_row: DataFrame, name: str, key: str = "entity_id") -> DataFrame:
    """``pairs`` (s, x) with ``name``_jac, _cont, _max and _sum: weighted overlap of both sides' tokens; 0 where a side has no weight."""
    sides = pairs.join(of_row.select(F.col(key).alias("s"), F.col("w").alias("ws")), "s", "left").join(of_row.select(F.col(key).alias("x"), F.col("w").alias("wx")), "x", "left")
    return overlapped(sides, "ws", "wx", name).drop("ws", "wx")


def overlapped(sides: DataFrame, ws: str, wx: str, name: str) -> DataFrame:
    """The same from both sides' weights in two columns."""
    total = lambda m: F.aggregate(F.coalesce(F.map_values(m), F.array().cast("array<double>")), F.lit(0.0), lambda a, v: a + v)
    common = F.coalesce(F.array_intersect(F.map_keys(ws), F.map_keys(wx)), F.array().cast("array<string>"))
    sides = sides.withColumns({"c": F.transform(common, lambda t: F.try_element_at(ws, t)), "a": total(ws), "b": total(wx)})
    sides = sides.withColumns({"i": F.aggregate("c", F.lit(0.0), lambda a, v: a + v), "m": F.coalesce(F.array_max("c"), F.lit(0.0))})
    union, least = F.col("a") + F.col("b") - F.col("i"), F.least("a", "b")
    share = lambda of: F.when(of > 0, F.col("i") / of).otherwise(F.lit(0.0))
    return sides.withColumns({f"{name}_jac": share(union), f"{name}_cont": share(least), f"{name}_max": F.col("m"), f"{name}_sum": F.col("i")}).drop("c", "a", "b", "i", "m")


def generic_tokens(primary: DataFrame, text: str = "nn", least: float = 0.002, key: str = "entity_id", group: str = "country") -> DataFrame:
    """(group, t): tokens in at least ``least`` of the group's primary rows."""
    return token_idf(primary, text, (), key, group).filter(F.col("df") / F.col("n") >= least).select(group, "t")


def distinctive(records: DataFrame, generic: DataFrame, text: str = "nn", key: str = "entity_id", group: str = "country") -> DataFrame:
    """(key, d, gs): the sorted distinct tokens that are not generic, and those that are. Every row is there; none: empty."""
    each = exploded(records, text, (), key, group).join(generic.withColumn("g", F.lit(True)), [group, "t"], "left")
    words = lambda own: joined(F.array_sort(F.collect_set(F.when(own, F.col("t")))))
    found = each.groupBy(key).agg(words(F.col("g").isNull()).alias("d"), words(F.col("g").isNotNull()).alias("gs"))
    return records.select(key).join(found, key, "left").fillna("", ["d", "gs"])


def address_key(address: Column) -> Column:
    """All tokens of an address, sorted; repeats stay."""
    return joined(F.array_sort(tokens(address)))


def same_address(primary: DataFrame, key: str = "entity_id", group: str = "country") -> DataFrame:
    """(key, n_same_addr): primary rows of the group with the same address key; an empty address is a key too.

    Counts are taken before the join, so that a common key is not gathered in one window.
    """
    keyed = primary.select(key, group, address_key(F.col("an")).alias("ak"))
    return keyed.join(keyed.groupBy(group, "ak").agg(F.count(F.lit(1)).alias("n_same_addr")), [group, "ak"]).select(key, "n_same_addr")


def set_measures(a: Column, b: Column) -> dict[str, Column]:
    """jaccard (null if both are empty), share_any and share_number of two word arrays."""
    digits = lambda w: F.filter(w, lambda t: t.rlike("^[0-9]+$"))
    return {"jaccard": F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), "share_any": F.size(F.array_intersect(a, b)) > 0, "share_number": F.size(F.array_intersect(digits(a), digits(b))) > 0}
