"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fieldloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach; a temporary one only in local mode."""
    known = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="fieldloom-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back: cuts the lineage."""
    path = f"{shared_dir(df.sparkSession)}/fieldloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()


def path_exists(spark: SparkSession, path: str) -> bool:
    target, conf = _path(spark, path)
    return target.getFileSystem(conf).exists(target)


def is_folder(spark: SparkSession, path: str) -> bool:
    target, conf = _path(spark, path)
    fs = target.getFileSystem(conf)
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it does not exist."""
    target, conf = _path(spark, path)
    fs = target.getFileSystem(conf)
    return [s.getPath().getName() for s in fs.listStatus(target)] if fs.exists(target) else []


def put_text(spark: SparkSession, path: str, text: str, replace: bool = True) -> None:
    """Write a small file as a whole: readers find the old text or the new one.

    Without ``replace`` a file that is there already is an error, so of two writers one wins.
    """
    target, conf = _path(spark, path)
    fs = target.getFileSystem(conf)
    fs.mkdirs(target.getParent())
    staged, _ = _path(spark, f"{target.getParent()}/_{uuid.uuid4().hex}")  # readers pass over names with an underscore
    out = fs.create(staged, True)
    out.write(text.encode())
    out.close()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    rename = hadoop.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE if replace else rename.NONE
    hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(staged, target, options)
