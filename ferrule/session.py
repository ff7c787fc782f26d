"""A local session with the settings that results rely on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def get_session(app: str = "ferrule", cores: str = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """AQE on, UTC, ANSI.  On a cluster the session comes from its own configuration; nothing in
    the library sets partitions or memory."""
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    settings = {
        "spark.sql.shuffle.partitions": shuffle_partitions,
        "spark.sql.adaptive.enabled": True,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": True,
        "spark.ui.enabled": False,
        "spark.ui.showConsoleProgress": False,
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, str(v).lower() if isinstance(v, bool) else v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (`spark.checkpoint.dir`).  Where it is
    unset, a session of one machine gets a local one; on a cluster that would lose data, so it is an
    error there."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ferrule-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
