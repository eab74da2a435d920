"""Business records derived from the ``part`` table, and scored pairs from ``embeddings``: inputs on which the linkage operators run.

The SQL text is valid in Spark and in other engines alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkin.operators.blocking import block_topk

_COUNTRY = "CASE p_partkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'France' END"
_SUFFIX = "CASE p_partkey % 4 WHEN 0 THEN ' LLC' WHEN 1 THEN ' Pvt. Ltd' WHEN 2 THEN ' & Co' ELSE ' Trading Group' END"
_STREET = "CASE p_partkey % 3 WHEN 0 THEN ' Street, New York' WHEN 1 THEN ' Nagar Road, West Virginia' ELSE ' Avenue, hno 007' END"
_KEY = "CAST(p_partkey AS STRING)"
_SIZE = "CAST(p_size AS STRING)"

PRIMARY = f"""SELECT p_partkey AS k, concat('S1-', {_KEY}) AS entity_id, concat(p_name, ' ', p_type, {_SUFFIX}) AS business_name,
 concat({_SIZE}, ' ', p_brand, {_STREET}) AS business_address, {_COUNTRY} AS country FROM part WHERE p_partkey % 5 <> 0"""


def _secondary(source: int, where: str, shift: int) -> str:
    v = f"(p_partkey + {shift})"
    return f"""SELECT p_partkey AS k, concat('S{source}-', {_KEY}) AS entity_id,
 CASE {v} % 7 WHEN 0 THEN upper(concat(p_name, ' ', p_type, {_SUFFIX})) WHEN 1 THEN concat(p_name, ' ', p_type) WHEN 2 THEN concat(replace(p_name, ' ', ''), '.com')
  WHEN 3 THEN concat(replace(p_name, 'e', 'é'), ' ', p_type, {_SUFFIX}) WHEN 4 THEN concat('The ', p_name, '; ', p_type, ' Doing Business As ', p_brand)
  ELSE concat(p_name, ' ', p_type, {_SUFFIX}) END AS business_name,
 CASE {v} % 6 WHEN 0 THEN '' WHEN 1 THEN concat(CAST(p_size + 1 AS STRING), ' ', p_brand, {_STREET}) WHEN 2 THEN concat('00', {_SIZE}, ' ', p_brand, {_STREET})
  WHEN 3 THEN concat(p_brand, {_STREET}, ' ', {_SIZE}) ELSE concat({_SIZE}, ' ', p_brand, {_STREET}) END AS business_address,
 {_COUNTRY} AS country FROM part WHERE {where}"""


SECONDARY = f"{_secondary(2, 'p_partkey % 2 = 0', 0)} UNION ALL {_secondary(3, 'p_partkey % 3 <> 1', 3)}"
TRUTH = """SELECT s.entity_id AS source1_entity_id, coalesce(t.ids, '') AS matched_entity_ids FROM s1 s LEFT JOIN (SELECT k, {join} AS ids FROM o GROUP BY k) t ON s.k = t.k"""
PAIRS = " UNION ALL ".join(f"SELECT s.entity_id AS s, o.entity_id AS x FROM s1 s JOIN o ON o.k = s.k + {d}" for d in (0, 15, 30))
#: The same views as common table expressions, for oracles.
WITH = f"""WITH s1 AS ({PRIMARY}), o AS ({SECONDARY}), records AS (SELECT * FROM s1 UNION ALL SELECT * FROM o),
gt AS ({TRUTH.format(join="string_agg(entity_id, ',' ORDER BY entity_id)")}), fp AS ({PAIRS}),
truth AS (SELECT source1_entity_id AS s, x FROM (SELECT source1_entity_id, unnest(string_split(matched_entity_ids, ',')) AS x FROM gt) WHERE x <> '')"""


class Records:
    """The derived record tables of a data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        part = spark.read.parquet(f"{sf_dir}/part.parquet")
        self.primary = spark.sql(PRIMARY.replace("FROM part", "FROM {part}"), part=part)
        self.secondary = spark.sql(SECONDARY.replace("FROM part", "FROM {part}"), part=part)
        ids = self.secondary.groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("entity_id")), ",").alias("ids"))
        self.lists = self.primary.join(ids, "k", "left").select(F.col("entity_id").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("matched_entity_ids"))
        left = self.primary.select(F.explode(F.array(*(F.col("k") + d for d in (0, 15, 30)))).alias("k"), F.col("entity_id").alias("s"))
        self.pairs = left.join(self.secondary.select("k", F.col("entity_id").alias("x")), "k").select("s", "x")

    @property
    def every(self) -> DataFrame:
        return self.primary.unionByName(self.secondary)


COUNTRY = "CASE s % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'India' WHEN 2 THEN 'France' ELSE 'Chile' END"


class Vectors:
    """Entities (vec_id divisible by 3) and records of ``embeddings``, their blocked candidates with scores, and a truth."""

    def __init__(self, spark: SparkSession, sf_dir: str, k: int = 20):
        every = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("label").alias("block"), F.transform("embedding", lambda v: v.cast("double")).alias("e"))
        self.entities = every.filter("vec_id % 3 = 0").withColumnRenamed("vec_id", "s")
        self.records = every.filter("vec_id % 3 <> 0").withColumnRenamed("vec_id", "x")
        self.dense = block_topk(self.entities, self.records, k)
        self.pairs = self.dense.withColumn("p", F.round(1 / (1 + F.exp(F.col("sim") * -8)), 12)).withColumn("q", F.round(1 / (1 + F.exp(F.col("sim") * -12 + 2)), 12)).withColumn("country", F.expr(COUNTRY))
        self.truth = self.records.select(F.expr("CASE WHEN x % 7 = 0 THEN 3 * ((x + 30) DIV 3) ELSE 3 * (x DIV 3) END").alias("s"), "x").join(self.entities.select("s"), "s", "left_semi")
        self.keys = self.entities.select("s").withColumn("country", F.expr(COUNTRY))


#: The same for oracles: e, r, dense, pairs, truth, keys.
VECTORS = f"""WITH e AS (SELECT vec_id AS s, label AS block, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 3 = 0),
r AS (SELECT vec_id AS x, label AS block, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 3 <> 0),
sims AS (SELECT e.block, s, x, list_inner_product(r.e, e.e) AS sim FROM e JOIN r ON e.block = r.block),
top AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY sim DESC, s) - 1 AS rx FROM sims QUALIFY rx < 20),
dense AS (SELECT *, least(row_number() OVER (PARTITION BY s ORDER BY sim DESC, x), 127) - 1 AS rs FROM top),
pairs AS (SELECT *, round(1 / (1 + exp(sim * -8)), 12) AS p, round(1 / (1 + exp(sim * -12 + 2)), 12) AS q, {COUNTRY} AS country FROM dense),
truth AS (SELECT CASE WHEN x % 7 = 0 THEN 3 * ((x + 30) // 3) ELSE 3 * (x // 3) END AS s, x FROM r WHERE s IN (SELECT s FROM e)),
keys AS (SELECT s, {COUNTRY} AS country FROM e)"""
