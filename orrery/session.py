"""Session helpers."""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from tempfile import mkdtemp
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()
_KEPT: list[str] = []


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once per application.

    Nothing is done where workers find it anyway: by PYTHONPATH, by the working folder,
    or installed.  Otherwise the driver's file server hands out a zip of the sources.
    """
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or "site-packages" in str(ROOT) or str(ROOT) in map(os.path.abspath, filter(None, places)):
        return
    to = os.path.join(mkdtemp(), "orrery_sources.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted((ROOT / "orrery").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(to)
    _SHIPPED.add(app)


def ensure_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go where ``spark.checkpoint.dir`` says; where nothing is set, a local master gets a local folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(shared or mkdtemp(prefix="orrery-checkpoints-"))


#: Bytes of a table up to which its rows are dealt over the cores before costly work on them.
SMALL_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df``; a small table is dealt over all cores first, as its file may be one split only.

    Larger tables have splits enough, and are left as they lie.  Rows are the same either way.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if 0 < size <= SMALL_BYTES else df


def keep(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared checkpoint folder and read again: its lineage ends there."""
    spark = df.sparkSession
    ensure_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/kept-{uuid4()}"
    df.write.parquet(path)
    _KEPT.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Removes the files of a kept table that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables kept inside are removed at the end: what needs them must be written by then."""
    begin = len(_KEPT)
    try:
        yield
    finally:
        for path in _KEPT[begin:]:
            delete(spark, path)
        del _KEPT[begin:]
