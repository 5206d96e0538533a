"""Sessions: shipping this package to executors, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own: dict[str, str] = {}
_written: list[str] = []


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def ship(spark: SparkSession | None = None) -> None:
    """Send the package to the executors once per application; Python workers then import it wherever they run."""
    spark = spark or session()
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    into = tempfile.mkdtemp(prefix="pagewright-ship-")
    atexit.register(shutil.rmtree, into, ignore_errors=True)
    target = os.path.join(into, "pagewright_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, which only a local master may leave, a folder of this application."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where.rstrip("/") + "/pagewright"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="pagewright-shared-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it has fewer partitions than they are, as one small file has; else as it is.

    For work that is dear for each row and follows without a shuffle. A large input has partitions enough and is never
    moved; filters and columns are still pushed into its scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def temporary(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder that is there until the driver ends or ``forget_written`` is called."""
    if not _written:
        atexit.register(forget_written)
    _written.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: a cut of lineage that survives lost executors.

    Results may read it at any time, so it stays as long as ``temporary`` has it.
    """
    path = temporary(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget_written() -> None:
    """Delete the intermediate files of this driver; results that read them must be done with."""
    jvm = SparkContext._jvm
    while _written and jvm is not None:
        path = _written.pop()
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)
        except Exception:  # the gateway may be gone when the driver ends
            return


def local_path(uri: str) -> str:
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


def open_output(uri: str):
    """A file to write, from a worker: plain paths directly, other stores by pyarrow's file systems."""
    if uri.startswith("file:") or "://" not in uri:
        path = local_path(uri)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path)


def open_input(uri: str):
    """A seekable file, from a worker."""
    if uri.startswith("file:") or "://" not in uri:
        return open(local_path(uri), "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
