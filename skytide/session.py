"""Sessions and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "skytide", cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the library relies on (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Folders of sessions that name none.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder of our own under the folder that all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a local master may go without it; a temporary
    folder then serves. On a cluster a missing setting is an error, as a machine-local folder would lose data with its
    executor. The folder is deleted when the driver ends.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or _own.get(context.applicationId)
    if not root:
        if context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="skytide-")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, p = filesystem(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)  # readers are lazy: what a query made may go only with the session
    return path


#: Applications whose executors have this package.
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, for Python stages: they may have neither the driver's folders nor its path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():
        at = Path(tempfile.mkdtemp(prefix="skytide-")) / "skytide.zip"
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(str(at))
        # the driver's own Python runners (stateful streams) get no files, but this
        context.environment["PYTHONPATH"] = ":".join(x for x in (str(package.parent), context.environment.get("PYTHONPATH")) if x)
    _shipped.add(context.applicationId)


def stage(df: DataFrame, name: str) -> DataFrame:
    """df, written once as a table in the shared folder and read back: for a result that several steps read, in place of
    computing it in each. It survives the loss of executors, and readers take only the columns they need."""
    at = shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours through Hadoop's file system."""
    fs, p = filesystem(spark, path)
    fs.delete(p, True)
