"""What the operators of this subpackage share."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an Arrow batch holds at most (or one row).
BATCH_ROWS, BATCH_BYTES = 20_000, 2 << 20
#: Words whose hashes a worker remembers.
CACHE_WORDS = 500_000
#: Whether Spark deletes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
PRIME = np.uint64(0x9E3779B185EBCA87)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small by bytes: texts are long, and a worker holds one batch at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (doc_id long, text string): whatever else a table holds, and however it is named, stays out of the plans."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def partitions_for(df: DataFrame, mb_each: float = 8.0, text_col: str = "text") -> int:
    """Partitions for a shuffle of all texts of df, from Spark's estimate of its size; where Spark has none, from the texts."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # a plan of unknown size
        size = (df.agg(F.sum(F.length(text_col))).first()[0] or 0) // 2
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, int(size / 1e6 / mb_each))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one is set only where none is."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir("/tmp/spanloom-checkpoints")
        root = context.getCheckpointDir()
    return root.rstrip("/")


def shared_table(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read again: cuts the lineage, and a lost executor loses nothing.

    What was shuffled for it is deleted once it is written, not when the driver next collects garbage.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def drop_table(df: DataFrame | None) -> None:
    """Remove what shared_table has written, once nothing reads it any more."""
    if path := getattr(df, "shared_path", None):
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def word_hashes(data: bytes, cache: dict[bytes, int]) -> np.ndarray:
    """A 64-bit hash of each word of A-Z lower-cased text; words are parted by ASCII white space alone."""
    words = data.lower().split()
    if len(cache) > CACHE_WORDS:
        cache.clear()
    for w in set(words):
        if w not in cache:
            cache[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row; of the whole sequence where it has fewer; none without words."""
    if not len(words):
        return words
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * PRIME + words[i : len(words) - k + 1 + i]
    return mix64(out)
