"""The cluster's shared folder: written tables that cut lineage, and plain files read and written by tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset: one of our own on a local master, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        path = spark._jvm.org.apache.hadoop.fs.Path(named)  # a path without scheme is the default file system's
        full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark.sparkContext, "_weftline_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext._weftline_dir = own
        spark.sparkContext.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/weftline/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, *by: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and it outlives any executor. by: partition columns."""
    path = new_path(df.sparkSession, label)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_output(uri: str):
    """A new file in the shared folder (any file system that pyarrow knows), from an executor."""
    from pyarrow.fs import FileSystem, FileType, LocalFileSystem

    fs, path = FileSystem.from_uri(uri)
    folder = path.rpartition("/")[0]
    if isinstance(fs, LocalFileSystem) or fs.get_file_info(folder).type == FileType.NotFound:
        fs.create_dir(folder, recursive=True)
    return fs.open_output_stream(path, compression=None)


def open_input(uri: str):
    from pyarrow.fs import FileSystem

    fs, path = FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def parquet_files(uri: str) -> list[str]:
    """Paths of the Parquet files under a folder, in order, for tasks that read them by themselves; with open_input's file system."""
    from pyarrow.fs import FileSelector, FileSystem

    fs, path = FileSystem.from_uri(uri)
    return sorted(f.path for f in fs.get_file_info(FileSelector(path, recursive=True)) if f.base_name.endswith(".parquet"))


#: Inputs of fewer bytes for each core are dealt out anew before costly work on rows: their files may have a single row group.
SMALL = 64 << 20
#: They are dealt out in parts of so many bytes, or in two for each core if those are smaller: a task doesn't grow with its input.
PIECE = 8 << 20


def spread(df: DataFrame, always: bool = False) -> DataFrame:
    """df, over all cores also where it is a small file that one task would read; large inputs have row groups enough and stay as they are, unless always."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(max(2 * cores, -(-size // PIECE))) if always or size < SMALL * cores else df
