"""Folders of written tables, through Hadoop's file systems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession


def drop_folders(spark: SparkSession, path: str, old: Callable[[str], bool]) -> list[str]:
    """Delete the folders in ``path`` whose names are ``old``; return their names, sorted. No such path: none.

    Spark has no call for it, so the driver's Hadoop client is used; a session without one (Spark Connect)
    cannot, and has to leave this to the store's own rules of expiry.
    """
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        raise NotImplementedError("folders can be dropped only where the driver has a Hadoop client")
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(root):
        return []
    gone = [s.getPath() for s in fs.listStatus(root) if s.isDirectory() and old(s.getPath().getName())]
    for folder in gone:
        fs.delete(folder, True)
    return sorted(folder.getName() for folder in gone)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; needs what drop_folders needs."""
    names: list[str] = []
    drop_folders(spark, path, lambda name: bool(names.append(name)))
    return names
