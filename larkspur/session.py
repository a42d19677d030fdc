"""Session settings that every entry point shares."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: UTC so that dates agree on every executor; AQE so that skewed joins are split and small
#: shuffle partitions are merged at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(app: str = "larkspur", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with DEFAULTS; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one that is set, or what spark.checkpoint.dir names.

    Where neither is given, a session on this machine (local master, as in tests) gets a temporary
    folder; a cluster gets an error, for its executors and driver share no local folders.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp("-larkspur"))
    return sc.getCheckpointDir()


_SHIPPED = "larkspur.shipped"


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, for functions that run there.

    Nothing is done where workers find it anyway: started from its folder, or through PYTHONPATH.
    Otherwise a zip of its sources goes out with the application, once.
    """
    root = Path(__file__).resolve().parents[1]
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(Path(p).resolve() == root for p in known if p) or spark.sparkContext.getLocalProperty(_SHIPPED):
        return
    archive = Path(tempfile.mkdtemp()) / "larkspur.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted((root / "larkspur").rglob("*.py")):
            out.write(source, source.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext.setLocalProperty(_SHIPPED, "1")
