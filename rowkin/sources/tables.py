"""Sources and sinks: TSV records, Parquet tables, ground truth, results."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(c, T.StringType()) for c in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """A tab-separated file with a header, without quoting, every field a string and null as empty. Columns are taken by name."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("escape", "\0").csv(path)
    return raw.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in schema.names))


def write_tsv(df: DataFrame, path: str) -> None:
    """One directory of tab-separated parts with headers, without quoting."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("escape", "\0").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def concatenated(*sources: DataFrame) -> DataFrame:
    """Secondary sources as one table."""
    out = sources[0]
    for df in sources[1:]:
        out = out.unionByName(df)
    return out


def truth_pairs(lists: DataFrame) -> DataFrame:
    """(s, x) of comma-joined match lists; empty and null lists have none."""
    return lists.select(F.col("source1_entity_id").alias("s"), F.explode(F.split("matched_entity_ids", ",")).alias("x")).filter("x <> ''")


def id_lists(pairs: DataFrame, primary: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """One row per primary entity, those without pairs included: its distinct ids in order, joined by commas."""
    lists = pairs.groupBy("s").agg(F.array_join(F.array_sort(F.collect_set("x")), ",").alias(column))
    return primary.select(F.col("entity_id").alias("s")).join(lists, "s", "left").select(F.col("s").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


def write_lists(lists: DataFrame, path: str) -> None:
    """One tab-separated file of a header and the rows by entity, whatever their number: sorted and written in parts, the parts then joined in order by the file system."""
    spark = lists.sparkSession
    parts, (key, value) = f"{path}.parts", lists.columns
    # empty lists stay empty fields, and nothing is quoted
    lists.sort(key).select(F.concat_ws("\t", F.col(key), F.coalesce(value, F.lit("")))).write.mode("overwrite").text(parts)
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, source = hadoop.Path(path), hadoop.Path(parts)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(target, True)
    try:
        out.write(f"{key}\t{value}\n".encode())
        for part in sorted((f.getPath() for f in files.listStatus(source) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
            piece = files.open(part)
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(piece, out, 1 << 20, False)
            piece.close()
    finally:
        out.close()
    files.delete(source, True)


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def done(spark: SparkSession, path: str) -> bool:
    """Whether a stage's output is complete, by the marker that Spark leaves, in any file system."""
    marker, files = _files(spark, f"{path}/_SUCCESS")
    return files.exists(marker)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, in any file system."""
    place, files = _files(spark, path)
    out = files.create(place, True)
    out.write(text.encode())
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    place, files = _files(spark, path)
    if not files.exists(place):
        return None
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def fingerprint(*parts) -> str:
    """A digest of values, and of the content of tables: their columns, number of rows and sum of row hashes."""
    seen = []
    for p in parts:
        if isinstance(p, DataFrame):
            size, total = p.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*p.columns).cast("decimal(20,0)"))).first()
            p = (p.dtypes, size, str(total))
        seen.append(repr(p))
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()


def materialised(df: DataFrame, path: str, key: str = "") -> DataFrame:
    """``df`` written once and read again. A complete output of an earlier run is used as it is if it was written under the same key, the fingerprint of what it depends on."""
    spark = df.sparkSession
    mark = f"{path}.key"
    if not (done(spark, path) and read_text(spark, mark) == key):
        df.write.mode("overwrite").parquet(path)
        write_text(spark, mark, key)
    return spark.read.parquet(path)
