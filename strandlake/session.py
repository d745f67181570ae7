"""Session helpers: table access, staging of intermediate results, batch sizes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch handed to Python; texts can be long, so the batches are kept short.
ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20


def local_session(name: str = "strandlake", cores: int | str = 8, **conf: str) -> SparkSession:
    """A session for one machine, with the settings that tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores if cores != "*" else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> None:
    """Ship the package to the executors; bound the bytes of an Arrow batch, unless the session has its own settings."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    try:
        if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) > ARROW_BYTES:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    except Exception:  # the setting came with a later release
        pass


def prepare_active() -> None:
    """``prepare`` the active session, for functions of columns, which know no DataFrame."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        prepare(spark)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, as ``--py-files`` would."""
    sc = spark.sparkContext
    if getattr(sc, "_strandlake_shipped", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="strandlake-py-")) / "strandlake.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._strandlake_shipped = True
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    The setting is read from the session.  Where it is unset, a temporary folder
    serves local sessions only, as a cluster needs a folder that all executors share.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="strandlake-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


_staged: set[str] = set()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end of the block, the tables that operators staged within it.

    An operator may return a DataFrame that reads tables it has staged, so write or collect the
    results within the block.  Without a block they stay until the process ends.
    """
    before = set(_staged)
    try:
        yield
    finally:
        for path in _staged - before:
            _remove(spark, path)
            _staged.discard(path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and read it again.

    The written table is columnar and compressed, so it takes less room than a
    checkpoint of the rows.  It survives the loss of executors.  Call ``unstage``
    once nothing reads it any more; what is left goes when the process ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _staged:
        atexit.register(_unstage_all, spark)
    _staged.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Remove the table that ``stage`` wrote."""
    path = getattr(df, "_staged_path", None)
    if path:
        _remove(df.sparkSession, path)
        _staged.discard(path)


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(sc._jsc.hadoopConfiguration()).delete(jpath, True)


def _unstage_all(spark: SparkSession) -> None:
    for path in list(_staged):
        try:
            _remove(spark, path)
        except Exception:  # the session has ended; the folder is the cluster's to clean
            return
