"""Makes the package importable in Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once per application, so that no install or shared path is needed there."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        package = Path(__file__).parent
        folder = tempfile.mkdtemp(prefix="gradeflow-ship-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = Path(folder) / "gradeflow"
        staged = base.parent / "staged"
        shutil.copytree(package, staged / "gradeflow", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(str(base), "zip", staged))
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; without that setting a local one, where all runs on one
    machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gradeflow-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: made once, read as often as it is used, and still there if an
    executor is lost."""
    path = f"{scratch_dir(df.sparkSession)}/gradeflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def version_of(spark: SparkSession, path: str) -> str:
    """What tells one state of the files below a path from another: their number, and a sum over names, sizes and times."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    told = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("h")).first()
    return f"{told.n}-{int(told.h or 0) % (1 << 64):016x}"
