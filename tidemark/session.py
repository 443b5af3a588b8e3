"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_local_folder: str | None = None
_app_folders: dict[tuple[str, str], str] = {}


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the engine relies on; `conf` wins over the defaults."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.ui.enabled": "false",
        "spark.python.unix.domain.socket.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Every position is UTC microseconds; pin a session made elsewhere to UTC too."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: `spark.checkpoint.dir`. Only a local master may go without."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    global _local_folder
    if _local_folder is None or not os.path.isdir(_local_folder):
        _local_folder = tempfile.mkdtemp(prefix="tidemark-")
    return _local_folder


def _hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, whatever store it is in."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def folder_exists(spark: SparkSession, path: str) -> bool:
    found, store = _hadoop_path(spark, path)
    return store.exists(found)


def folder_names(spark: SparkSession, path: str) -> set[str]:
    """Names of what lies in a folder. Raises if there is no such folder."""
    found, store = _hadoop_path(spark, path)
    if not store.exists(found):
        raise FileNotFoundError(f"no folder {path}")
    return {entry.getPath().getName() for entry in store.listStatus(found)}


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern with wildcards."""
    found, store = _hadoop_path(spark, pattern)
    statuses = store.globStatus(found)
    return [] if statuses is None else [status.getPath().toString() for status in statuses]


def move_files(spark: SparkSession, moves: list[tuple[str, str]], threads: int = 16) -> None:
    """Rename files one by one, replacing what is there. A file that is gone was moved before."""
    if not moves:
        return
    store = _hadoop_path(spark, moves[0][1])[1]
    path = spark._jvm.org.apache.hadoop.fs.Path
    for folder in {to.rsplit("/", 1)[0] for _, to in moves}:
        store.mkdirs(path(folder))

    def move(pair: tuple[str, str]) -> None:
        source, to = path(pair[0]), path(pair[1])
        if store.rename(source, to):
            return
        if store.exists(source):
            store.delete(to, False)
            if not store.rename(source, to):
                raise OSError(f"could not move {pair[0]} to {pair[1]}")
        elif not store.exists(to):
            raise FileNotFoundError(f"neither {pair[0]} nor {pair[1]} exists")

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(move, moves))


def remove_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete files or folders that this library has written and needs no more."""
    for name in paths:
        found, store = _hadoop_path(spark, name)
        store.delete(found, True)


def mark_done(spark: SparkSession, path: str) -> None:
    """Make an empty file."""
    found, store = _hadoop_path(spark, path)
    store.create(found, True).close()


# Local file systems write a file of checksums beside each file, and set the rights of each by a process of its own.
# Without them, a write of very many small files takes half the time. Other stores have no such files.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def plain_files(spark: SparkSession) -> Iterator[None]:
    """Streams that are started in the block write plain files; a stream takes no such options of its own."""
    usual = {key: spark.conf.get(key, None) for key in PLAIN_FILES}
    for key, value in PLAIN_FILES.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in usual.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def write_tasks(spark: SparkSession) -> int:
    """Tasks for a write that opens very many files: the usual number, but no core stays idle."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, spark.sparkContext.defaultParallelism)


@contextmanager
def listed_in_blocks(spark: SparkSession) -> Iterator[None]:
    """Reads that are set up in the block list many folders per task, instead of a few in each of 10,000 tasks."""
    usual = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(usual), 4 * write_tasks(spark))))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, usual)


_blocks = threading.local()


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """What this thread stages in the block is removed at its end: for jobs that go on for long.

    Nothing that leaves the block may read from a staged table.
    """
    stack = _blocks.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        remove_paths(spark, stack.pop())


def shared_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder nobody has used yet.

    All of an application's paths lie in one folder, which is removed when the application ends, or when the
    block of `cleared` ends.
    """
    app, base = spark.sparkContext.applicationId, shared_folder(spark)
    if (app, base) not in _app_folders:
        folder = f"{base}/tidemark/{app}-{uuid.uuid4().hex}"
        found, store = _hadoop_path(spark, folder)
        store.mkdirs(found)
        store.deleteOnExit(found)
        _app_folders[app, base] = folder
    path = f"{_app_folders[app, base]}/{label}-{uuid.uuid4().hex}"
    if _blocks.__dict__.get("stack"):
        _blocks.stack[-1].append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once and go on from the files.

    Cuts the lineage, survives the loss of executors, and gives the planner the true size.
    """
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
