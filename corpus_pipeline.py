"""Corpus pipeline: language ID, exact dedup, near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and is written as Parquet and read again before the next.
All but the last return the columns of ``documents``.

Defined cases: a null or empty text is in no language and goes with the first stage, unless no row has a label to learn from; rows without an id stay, those of equal texts
but one; of rows that repeat id and text one stays; rows that repeat an id with other texts are decided by their own texts; ties go to the id, in exact dedup to the largest,
in near-dedup to the smallest; an empty table gives no pieces; extra columns are carried up to the last stage, which returns pieces.
"""

from __future__ import annotations

import uuid

from rowkin.llm import exact_dedup, langid, near_dedup, packing, secret_scan
from rowkin.llm._common import shared_folder


def language_id(spark, docs, sf_dir):
    """Documents in no known language go."""
    return langid.keep_known(docs)


def exact(spark, docs, sf_dir):
    """Of equal texts, the document with the largest id stays."""
    return exact_dedup.keep_exact(docs)


def near(spark, docs, sf_dir):
    """Of each group of near duplicates (SimHash candidates, five-word shingles of similarity 0.8 or more), the document with the smallest id stays."""
    return near_dedup.keep_similar(docs)


def secrets(spark, docs, sf_dir):
    """Secrets in the texts are replaced by a mark."""
    return secret_scan.redact(docs)


def packed(spark, docs, sf_dir):
    """The pieces of all documents in token windows."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash_near_dedup", near), ("secret_scans", secrets), ("packing", packed)]

#: SQL cannot express the n-gram filters, the shingle hashes and the tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir, folder=None):
    """The result of all stages over ``documents``; what a stage returns is written below ``folder`` and read again.

    Without a folder it is a new one in the shared folder of ``spark.checkpoint.dir``. With one, a run that was broken off goes on behind its last complete stage; use a
    folder for one input only. What a stage has read is deleted when its own result is complete. The last stage's result stays, as the returned DataFrame reads it.
    """
    folder = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = path("").getFileSystem(spark._jsc.hadoopConfiguration())
    names = [name for name, _ in STAGES]
    done = max((k for k, name in enumerate(names) if files.exists(path(f"{name}/_SUCCESS"))), default=-1)
    docs = spark.read.parquet(f"{folder}/{names[done]}" if done >= 0 else f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        if k > done:
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if k:
                files.delete(path(names[k - 1]), True)
    return docs
