"""Session settings that the engine relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "tarnwick", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ANSI errors, adaptive execution and UTC; ``conf`` adds or overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC"} | conf
    return builder.config(map=settings).getOrCreate()


def ensure_checkpoints(spark: SparkSession) -> None:
    """Make checkpoint() usable; a folder of our own only on local masters without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tarnwick-"))


def ship(spark: SparkSession) -> None:
    """Let Python workers on this machine, or with the same folders, import this package.

    On a cluster without the folder, submit the package with --py-files.
    """
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (here, known) if x)
