"""Session settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, name: str = "markwise", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. A temporary one where one machine names none.

    The temporary folder goes when the driver ends.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="markwise-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut at a checkpoint in the shared folder. Meant for small tables; see :func:`stored`."""
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


_STORED: dict[str, list[str]] = {}


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a Parquet table and read back: compressed, and read by column.

    The table stays until :func:`released` or the end of the driver, since any later action may read it.
    """
    spark = shipped(df.sparkSession)
    path = f"{shared_folder(spark).rstrip('/')}/markwise-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    application = spark.sparkContext.applicationId
    if application not in _STORED:
        atexit.register(released, spark)
    _STORED.setdefault(application, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> int:
    """Deletes the tables that :func:`stored` has written for this application; how many there were.

    For drivers that run on: call it when the results that read the tables have been written.
    """
    paths = _STORED.pop(spark.sparkContext.applicationId, []) if spark.sparkContext._jsc is not None else []
    jvm, configuration = spark._jvm, spark.sparkContext._jsc
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(configuration.hadoopConfiguration()).delete(folder, True)
    return len(paths)


_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """``spark`` with this package sent to its workers, once per application, so that they need no installation."""
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        root = Path(__file__).parent
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w") as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, f"{root.name}/{file.relative_to(root)}")
        # the driver serves this file to executors that join at any time, so it stays until the driver ends
        folder = tempfile.mkdtemp(prefix=f"{root.name}-package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = Path(folder) / f"{root.name}.zip"
        path.write_bytes(packed.getvalue())
        spark.sparkContext.addPyFile(str(path))
        _SHIPPED.add(application)
    return spark


def shipped_here() -> None:
    """The package sent to the workers of the active session, for column functions that know no table."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        shipped(spark)
