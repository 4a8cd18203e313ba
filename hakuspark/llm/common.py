"""Shared storage between jobs, and small helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has at most so many rows (of a few numbers each).
BROADCAST_ROWS = 100_000
#: Whole texts that Python workers get at once, and about so many bytes of them.
TEXT_ROWS = 1_000
TEXT_BYTES = 2_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent and the master is local, a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to TEXT_ROWS rows and TEXT_BYTES, as batches of whole texts would be large otherwise."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BYTES)):
        now = spark.conf.get(name)
        if not now.isdecimal() or not 0 < int(now) <= most:
            spark.conf.set(name, most)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to shared storage and read again: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a frame that stored() made, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast if it has few rows; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs and a number for each row, the same whenever and wherever it is read: that of its file, and its place there.

    A frame that doesn't come from files with such places is stored first.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")]
    try:
        found = docs.select("*", *place)
    except AnalysisException:
        found = stored(docs, "docs").select("*", *place)
    files = stored(found.select("_file").distinct().select("_file", F.row_number().over(Window.orderBy("_file")).cast("long").alias("_no")), "files")
    joined = found.join(small(files, files.count()), "_file")
    return joined.select(*docs.columns, (F.shiftleft("_no", 40) + F.col("_at")).alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A frame of literals, planned without any Python."""
    structs = [F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def masked(docs: DataFrame) -> DataFrame:
    """docs with columns named by position, so that they can't clash with an operator's own."""
    return docs.toDF(*(f"_doc{i}" for i in range(len(docs.columns))))


def mask_of(docs: DataFrame, name: str) -> str:
    return f"_doc{docs.columns.index(name)}"


def unmasked(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, under their names, from a frame made of masked(docs)."""
    return df.select(*(F.col(f"_doc{i}").alias(name) for i, name in enumerate(docs.columns)))
