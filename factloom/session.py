"""Session construction and the places where lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDERS: list[str] = []


def local_session(cores: str = "*", app: str = "factloom", partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers of a session, once; on a cluster they have no copy of their own."""
    context = spark.sparkContext
    if getattr(context, "_factloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="factloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/factloom-code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(archive)
    context._factloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the cluster names one.

    Where it is unset (tests, a laptop) a temporary folder is made once and removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _OWN_FOLDERS:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _OWN_FOLDERS.append(tempfile.mkdtemp(prefix="factloom-"))
        atexit.register(shutil.rmtree, _OWN_FOLDERS[0], ignore_errors=True)
    return _OWN_FOLDERS[0]


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, null if there is none; on any file system Spark can reach."""
    target, files = _file(spark, path)
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return str(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file: a draft is written whole and then takes its name, so a reader never sees half of it."""
    target, files = _file(spark, path)
    draft, _ = _file(spark, f"{path}.{uuid.uuid4().hex}")
    stream = files.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(files.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(draft), files.makeQualified(target), over)


def delete_folder(spark: SparkSession, path: str) -> None:
    target, files = _file(spark, path)
    files.delete(target, True)


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def spool(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage, survives the loss of any executor and lets several consumers share one computation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_spooled(df: DataFrame) -> None:
    """Delete the files of a DataFrame that ``spool`` returned, once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        delete_folder(spark, file.rsplit("/", 1)[0])
