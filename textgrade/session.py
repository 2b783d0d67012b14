"""Session helpers: a local session, and tables that outlive executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def local_session(
    app: str = "textgrade", cores: int | str = "*", shuffle_partitions: int = 8, document_partitions: int | None = None
) -> SparkSession:
    """A session for tests and the benchmark; on a cluster, bring your own.

    With ``document_partitions`` the queries deal out the documents first, for one small file is one task.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.textgrade.documentPartitions", str(document_partitions or ""))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``, or one of its own in a local session."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        folder = sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="textgrade-checkpoint-")
        sc.setCheckpointDir(folder)
    return folder


def _write(df: DataFrame) -> str:
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/textgrade-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, as a Parquet table in the shared folder, and go on from there.

    The table outlives any executor, is read by column, and tells the optimizer its size.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_write(df))


_KEPT: dict[tuple, tuple[str, StructType]] = {}


def _files(spark: SparkSession, path: str):
    """Hadoop file system and path."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _version(spark: SparkSession, path: str) -> tuple[int, int, int]:
    system, place = _files(spark, path)
    summary = system.getContentSummary(place)
    return system.getFileStatus(place).getModificationTime(), summary.getLength(), summary.getFileCount()


def kept(spark: SparkSession, name: str, source: str | Sequence[str], make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` derives from the files under ``source`` (one path or several), written once a session.

    It is made anew when the source has changed (time, bytes or number of files) and when its own files are gone.
    """
    sources = (source,) if isinstance(source, str) else tuple(source)
    version = tuple(_version(spark, path) for path in sources)
    key = spark.sparkContext.applicationId, name, sources
    held = _KEPT.get((*key, version))
    if held:
        system, place = _files(spark, held[0])
    if not held or not system.exists(place):
        for old in [k for k in _KEPT if k[:3] == key]:
            del _KEPT[old]
        df = make()
        held = _KEPT[(*key, version)] = _write(df), df.schema
    return spark.read.schema(held[1]).parquet(held[0])
