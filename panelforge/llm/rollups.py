"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A change of the corpus is a batch of signed rows: an inserted document adds one document and its
tokens, a deleted one takes them away, a revised count takes the old row away and adds the new one. A
batch is reduced to one row per key and written below the store as a folder named by the batch;
totals are the sum of all batches, so they never read documents again.

Commits are idempotent: a batch whose folder is complete is skipped, and one that was interrupted is
written over, so a batch may be sent any number of times, in any order. A batch is its name: one that is
complete is skipped whatever is sent under its name again. Totals read complete batches only.

Nulls, ties and repeats: null sources, languages and versions are keys like others. Repeated rows
count as often as they stand there. A null count is 0. Keys whose documents and tokens are all gone
are left out of the totals. An empty batch commits an empty folder; an empty store has no totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"

# Counters by version, on whole texts; a null text has no tokens.
WORDS, PIECES = "words_v1", "pieces_v2"
_PATTERNS = {WORDS: r"[^\x20\x09-\x0D]+", PIECES: r"[0-9A-Za-z]+|[^\x00-\x7F]+"}


def count_tokens(text: str, version: str) -> Column:
    found = F.regexp_count(F.col(text), F.lit(_PATTERNS[version]))
    return F.coalesce(found, F.lit(0)).cast("bigint")


def signed(rows: DataFrame, sign: int, tokens: Column, version: str) -> DataFrame:
    """One signed row per document."""
    return rows.select(
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.lit(version).alias("tokenizer"),
        F.lit(sign).cast("bigint").alias("n_docs"),
        (F.coalesce(tokens, F.lit(0)) * sign).cast("bigint").alias("n_tokens"),
    )


def revised(rows: DataFrame, old: Column, old_version: str, new: Column, new_version: str) -> DataFrame:
    """Two signed rows per document from one scan: the old count goes, the new one comes."""
    pair = F.array(
        *[
            F.struct(
                F.lit(version).alias("tokenizer"),
                F.lit(sign).cast("bigint").alias("n_docs"),
                (F.coalesce(tokens, F.lit(0)) * sign).cast("bigint").alias("n_tokens"),
            )
            for sign, tokens, version in ((-1, old, old_version), (1, new, new_version))
        ]
    )
    each = rows.select(
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.explode(pair).alias("r"),
    )
    return each.select("source", "lang", "r.*")


class Rollup:
    """Totals in a folder of batches that all executors can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path.rstrip("/")

    def _place(self, path: str):
        place = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self._spark._jsc.hadoopConfiguration())

    def _has(self, path: str) -> bool:
        place, files = self._place(path)
        return files.exists(place)

    def _complete(self) -> list[str]:
        """The folders of complete batches."""
        place, files = self._place(self._path)
        if not files.exists(place):
            return []
        found = [s.getPath().toString() for s in files.listStatus(place) if s.isDirectory()]
        return sorted(p for p in found if self._has(f"{p}/_SUCCESS"))

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Add a batch of signed rows; False if it was already there."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch is named by letters, digits, - and _")
        path = f"{self._path}/batch={batch}"
        if self._has(f"{path}/_SUCCESS"):
            return False
        delta = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        delta.write.mode("overwrite").parquet(path)
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens per key over all complete batches."""
        batches = self._complete()
        if not batches:
            return self._spark.createDataFrame([], _SCHEMA)
        deltas = self._spark.read.schema(_SCHEMA).parquet(*batches)
        sums = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 or n_tokens <> 0")
