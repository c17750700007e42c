"""Session settings the operators rely on, and lineage cuts for iterative jobs."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
PACKAGE_FOLDER = os.path.dirname(os.path.abspath(__file__))

_shipped: set[str] = set()


def build_session(app: str = "folioscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC timestamps."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def package_zip() -> bytes:
    """The package's modules as a zip from which Python workers can import."""
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in sorted(os.walk(PACKAGE_FOLDER)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(PACKAGE_FOLDER)))
    return packed.getvalue()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application; the driver serves the file."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="folioscope-"), "folioscope.zip")
    with open(path, "wb") as out:
        out.write(package_zip())
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the session names; fall back to a scratch one in local mode only."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getConf().get(CHECKPOINT_SETTING)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="folioscope-ckpt-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder, which its file system deletes when the application ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def drop_table(df: DataFrame) -> None:
    """Delete the files behind ``df``, a table from ``cut_lineage`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in sorted({os.path.dirname(name) for name in df.inputFiles()}):
        target = jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs deleted now: Spark does so once the driver's JVM finds that nothing refers to them."""
    spark.sparkContext._jvm.System.gc()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back.

    A lost executor then does not replay earlier rounds, and, other than with ``checkpoint()``, the plan
    of the next round starts without the constraints of the earlier ones, which grow from round to round.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
