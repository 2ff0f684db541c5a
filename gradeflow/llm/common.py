"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one where none is set and all runs on this machine, as in tests."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="gradeflow-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends there, and any executor can read it again."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/gradeflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def digest_of(text: Column) -> Column:
    """The SHA-256 of a text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id has a null fold."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(stem: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever its case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def _orderable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_orderable(f.dataType) for f in kind)
    return _orderable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, MapType | VariantType)


def only_kept(docs: DataFrame, keep: DataFrame, digest: Column, doc_id: str) -> DataFrame:
    """The rows of docs whose text digest and id are a pair (digest, keep_id) of ``keep``; of rows that repeat both, the least
    by its columns, or by the digest of its JSON if one of them has no order (maps).

    Rows meet by digest and id together, so the copies of a hot text are dealt over the tasks. No column of docs clashes.
    """
    pair = lambda d, i: F.concat(d, F.coalesce(i.cast("string"), F.lit("-")).cast("binary"))
    wanted = keep.select(pair(F.col("digest"), F.col("keep_id")).alias("pair"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    held = docs.select(pair(digest, F.col(doc_id).cast("long")).alias("pair"), row.alias("row")).join(wanted, "pair", "left_semi")
    least = F.min("row") if _orderable(held.schema["row"].dataType) else F.min_by("row", F.sha2(F.to_json("row"), 256))
    return held.groupBy("pair").agg(least.alias("row")).select("row.*")
