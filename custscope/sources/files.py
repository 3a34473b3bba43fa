"""Small files and folders in whatever store the tables lie in, through the session's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _filesystem(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _filesystem(spark, path)
    return fs.exists(hadoop_path)


def bytes_on_disk(spark: SparkSession, path: str) -> int:
    fs, hadoop_path = _filesystem(spark, path)
    return fs.getContentSummary(hadoop_path).getLength()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, hadoop_path = _filesystem(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop_path)) if fs.exists(hadoop_path) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, hadoop_path = _filesystem(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    fs, hadoop_path = _filesystem(spark, path)
    stream = fs.create(hadoop_path, overwrite)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def rename_new(spark: SparkSession, path: str, target: str) -> bool:
    """Gives `path` the name `target` in one step; False if that name is taken."""
    fs, source = _filesystem(spark, path)
    _, wanted = _filesystem(spark, target)
    return not fs.exists(wanted) and fs.rename(source, wanted)


def delete(spark: SparkSession, path: str) -> None:
    fs, hadoop_path = _filesystem(spark, path)
    fs.delete(hadoop_path, True)
