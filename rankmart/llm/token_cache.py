"""Token counts through a digest cache.

A text's count depends only on its normalised content and on the tokenizer, so counts are kept in a table
keyed by (tokenizer version, content digest). A run joins the documents' digests to the stored counts,
encodes one document per distinct miss, appends those counts, and joins again. The tokenizer version is the
digest of its file, so another file never meets old counts.

Null text counts as empty and has a count like any other; null or repeated keys and repeated rows each keep
their row; an empty table adds nothing and returns no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmart.llm import tokenizing
from rankmart.llm.common import stored, whole_text

CACHE_SCHEMA = "version string, digest string, n_tokens long"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()[:32]


def normalised(text: Column) -> Column:
    """The content that is digested. Counts must be those of the given text, so nothing but the null is
    normalised away: case, white space and composition all matter to the tokenizers."""
    return F.coalesce(text.cast("string"), F.lit(""))


def _read_cache(spark, path: str, version: str) -> DataFrame:
    """The version's counts so far; no folder yet: none."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    cache = spark.read.schema(CACHE_SCHEMA).parquet(path) if there else spark.createDataFrame([], CACHE_SCHEMA)
    # two runs may have appended the same miss: one count per digest
    return cache.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_bytes, n_tokens) for all documents; the misses' counts are appended to the table ``cache``.

    Texts move once, and only those of the chosen documents: digests are (key, digest) rows, one key is chosen
    per missing digest by a partial aggregate, and the documents are semi-joined to the choice.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    rows = docs.select(F.col(key).alias("k"), normalised(F.col(text)).alias("t"))
    rows = rows.withColumn("digest", F.sha2("t", 256))
    known = _read_cache(spark, cache, version)
    asked = rows.groupBy("digest").agg(F.min("k").alias("chosen"))
    misses = stored(asked.join(known, "digest", "left_anti"), "token-misses")
    # the digest is part of the condition, so a key that is null or shared still picks the right text
    todo = rows.join(misses.select(F.col("digest").alias("miss"), "chosen"),
                     (F.col("digest") == F.col("miss")) & F.col("k").eqNullSafe(F.col("chosen")), "left_semi")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = tokenizing.loaded(tokenizing.PieceCounts, tokenizer)
        done: set[str] = set()  # repeated rows of the chosen key meet in one task
        for pdf in batches:
            pdf = pdf.drop_duplicates("digest")
            pdf = pdf[[d not in done for d in pdf["digest"]]]
            done.update(pdf["digest"])
            yield pd.DataFrame({"version": version, "digest": pdf["digest"],
                                "n_tokens": [counter.count(t) for t in pdf["t"]]})

    counted = todo.select("digest", "t").mapInPandas(encode, CACHE_SCHEMA)
    counted = counted.groupBy("version", "digest").agg(F.max("n_tokens").alias("n_tokens"))
    counted.write.mode("append").parquet(cache)
    counts = _read_cache(spark, cache, version).withColumnRenamed("digest", "cached")
    out = docs.select(F.col(key).alias(key), normalised(F.col(text)).alias("t"))
    out = out.select(key, F.octet_length("t").cast("long").alias("n_bytes"), F.sha2("t", 256).alias("digest"))
    return out.join(counts, out["digest"] == counts["cached"]).select(key, "n_bytes", "n_tokens")
