"""SparkSession helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "tarnsearch", memory: str = "4g") -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE, ANSI left on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a local one only where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "tarnsearch-checkpoints")


#: Folders written in each open scope, the innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Shared folders written inside are deleted at the end; results that read them have to be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new name below the shared folder; the enclosing :func:`scratch` will remove it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet below the shared folder and read it back (columnar, compressed, prunable).

    The files survive the loss of executors.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the scan has fewer partitions than there are cores (a small file with costly rows).

    A large input has more partitions than cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Tables whose rows are texts.
TEXTS = frozenset({"crawled_document", "extracted_page", "documents"})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find the package where it isn't installed: its folder joins their search path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark
