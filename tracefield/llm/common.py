"""Helpers that the corpus operators share: the shared folder, staged tables
and checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes per Arrow batch for tasks that handle whole texts or
#: payloads; a row larger than that is a batch of its own.
TEXT_BATCH_ROWS = 1000
TEXT_BATCH_BYTES = 4 << 20
#: Stands for a null ``doc_id`` where rows have to be keyed; sorts first.
NULL_KEY = -(2**63)
#: Paths of the tables staged so far.
_STAGED: list[str] = []


def session(df: DataFrame) -> SparkSession:
    """The session of ``df`` with batches small enough for very long texts."""
    spark = df.sparkSession
    for name, most in (("maxRecordsPerBatch", TEXT_BATCH_ROWS), ("maxBytesPerBatch", TEXT_BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        found = int(re.match("-?[0-9]+", spark.conf.get(name))[0])
        if not 0 < found <= most:
            spark.conf.set(name, str(most))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A temporary folder is set only where the session names none and all runs
    on one machine, as in tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracefield-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: what follows survives a lost executor without
    running the earlier stages again.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    _STAGED.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def staged_so_far() -> int:
    return len(_STAGED)


def drop_staged_since(spark: SparkSession, count: int, keep: DataFrame) -> None:
    """Delete what was staged after ``count`` tables were, but for ``keep``:
    the workings of a step whose result is ``keep``."""
    for path in _STAGED[count:]:
        if path != keep._staged:
            _delete(spark, path)
    _STAGED[count:] = [keep._staged]


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that nothing later reads."""
    path = getattr(df, "_staged", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def in_order(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in ascending ``doc_id`` over ranges of it; rows that
    share an id, or have none, are in the order of their texts' start and hash
    and can be dealt to several ranges."""
    order = ["doc_id", F.substring("text", 1, 32), F.xxhash64("text")]
    return docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)


def broadcast_within(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it was counted at ``rows`` or fewer;
    beyond that the planner shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
