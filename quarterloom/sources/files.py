"""Files by the cluster's own file systems: digests, whole texts, publishing by rename."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class DigestMismatch(ValueError):
    """A file isn't the one that was pinned."""


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it doesn't exist."""
    fs, p = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside ``path`` and rename, so that it is whole or absent."""
    side = f"{path}.partial"
    fs, p = _path(spark, side)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    publish(spark, side, path)


def publish(spark: SparkSession, side: str, path: str) -> None:
    """Replace ``path`` by ``side``; what was there is only deleted once the new one is in place.

    The old table or file steps aside first and comes back if the rename fails. A reader
    between the two renames finds nothing, never a mixture.
    """
    fs, src = _path(spark, side)
    dst, old = _path(spark, path)[1], _path(spark, f"{path}.replaced")[1]
    fs.delete(old, True)
    had = fs.exists(dst)
    if had and not fs.rename(dst, old):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(src, dst):
        if had:
            fs.rename(old, dst)
        raise OSError(f"could not publish {path}")
    fs.delete(old, True)


def md5(spark: SparkSession, path: str) -> str:
    """The digest of a file, streamed; of a table's folder, of its files' digests in order of their names."""
    fs, p = _path(spark, path)
    digest = spark._jvm.org.apache.commons.codec.digest.DigestUtils
    if not fs.getFileStatus(p).isFile():
        each = [f"{n}:{md5(spark, f'{path}/{n}')}" for n in children(spark, path) if not n.startswith(("_", "."))]
        return digest.md5Hex("\n".join(each))
    stream = fs.open(p)
    try:
        return digest.md5Hex(stream)
    finally:
        stream.close()


def verify_md5(spark: SparkSession, path: str, expected: str) -> None:
    """Raise DigestMismatch unless the file is the pinned one."""
    got = md5(spark, path)
    if got != expected.lower():
        raise DigestMismatch(f"{path} has digest {got}, expected {expected}")


def read_json(spark: SparkSession, path: str) -> dict:
    """A JSON object; anything else is an error that names the file."""
    try:
        doc = json.loads(read_text(spark, path))
    except ValueError as e:
        raise ValueError(f"{path} is no JSON document: {e}") from e
    if not isinstance(doc, dict):
        raise ValueError(f"{path} holds no JSON object")
    return doc
