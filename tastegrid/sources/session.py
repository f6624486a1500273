"""Session settings that the plans rely on, and the shared folder for checkpoints."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_OPTIONS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "tastegrid", master: str | None = None, **options: str) -> SparkSession:
    """Session with AQE and a UTC clock; ``options`` may use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        **_OPTIONS,
        "spark.sql.session.timeZone": "UTC",
        **{k.replace("__", "."): v for k, v in options.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Without that setting a session inside one process (``local[...]``) gets a temporary folder; any other
    gets an error, because executors cannot share a machine-local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        folder = tempfile.mkdtemp(prefix="tastegrid-")
        spark.conf.set("spark.checkpoint.dir", folder)
        return folder
    raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoints(spark: SparkSession) -> None:
    """Give the context a checkpoint folder unless it already has one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))


def _delete(spark: SparkSession, path) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_table(table: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote and that nothing reads any more, before its owner would."""
    spark = table.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        _delete(spark, spark._jvm.java.net.URI(folder))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``scratch_folder``, before its owner would."""
    _delete(spark, spark._jvm.java.net.URI(path))


_scratch = threading.local()


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread materializes inside the block are deleted at its end.

    For steps whose results have left Spark by then, such as the metrics of a fit, or are written with
    ``keep``: such a table outlives the block and belongs to the one around it, if there is one.
    """
    blocks = _scratch.__dict__.setdefault("blocks", [])
    blocks.append([])
    try:
        yield
    finally:
        for path in blocks.pop():
            _delete(spark, path)


def materialize(df: DataFrame, name: str, keep: bool = False, folders: str | list[str] | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back; ``folders``: a folder per value of this column or these columns.

    The table survives lost executors, cuts the lineage, and gives the planner real file
    sizes: later joins broadcast it only when it is small, and AQE can split skewed keys on
    the other side because a scan (not an aggregate) feeds the join.
    """
    path = work_folder(df.sparkSession, name)
    owners = getattr(_scratch, "blocks", [])[: -1 if keep else None]
    if owners:
        owners[-1].append(path)
    df.write.parquet(path, partitionBy=folders)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """The address of a new folder in the shared one, for files that tasks write with pyarrow; deleted with the tables of ``scratch_tables``."""
    path = work_folder(spark, name)
    owners = getattr(_scratch, "blocks", [])
    if owners:
        owners[-1].append(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(target)
    return system.makeQualified(target).toUri().toString().rstrip("/")


def files_by_folder(table: DataFrame, names: Sequence[str]) -> dict[tuple, list[str]]:
    """The files of a table in folders of these columns, by their values: a few addresses per folder for the driver."""
    pattern = re.compile("/".join(f"{n}=(-?\\d+)" for n in names))
    found: dict[tuple, list[str]] = {}
    for file in table.inputFiles():
        found.setdefault(tuple(map(int, pattern.search(file).groups())), []).append(file)
    return found


def read_files(files: Sequence[str], columns: Sequence[str]) -> pa.Table:
    """Written files, read by a task itself; their address must be one that pyarrow knows (a path, ``file:``, ``hdfs:``, ``s3:``, ``gs:``)."""
    parts = []
    for uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as file:
            parts.append(pq.ParquetFile(file).read(columns=list(columns)))
    return pa.concat_tables(parts)
