"""Files on whatever storage the session reads and writes: local paths and URIs alike, through Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path, or one that its pattern matches, is there."""
    fs, p = _at(spark, path)
    return bool(fs.globStatus(p))


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def promote(spark: SparkSession, staged: str, path: str) -> None:
    """Put what is staged in the place of ``path``; both lie on the same storage."""
    fs, p = _at(spark, path)
    if fs.exists(p):
        fs.delete(p, True)
    if not fs.rename(_at(spark, staged)[1], p):
        raise OSError(f"{staged} cannot be renamed to {path}")


def join_files(spark: SparkSession, head: bytes, pattern: str, path: str) -> int:
    """Write ``head`` and the bytes of all files of the pattern, in order of their names, as one file; the number of files.

    Bytes are streamed inside the JVM of the driver and never held.
    """
    fs, p = _at(spark, pattern)
    found = sorted((s.getPath() for s in fs.globStatus(p) or []), key=lambda x: x.getName())
    to, target = _at(spark, path)
    out = to.create(target, True)
    try:
        out.write(bytearray(head))
        for x in found:
            part = fs.open(x)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
            finally:
                part.close()
    finally:
        out.close()
    return len(found)
