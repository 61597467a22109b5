"""Stages called by themselves from a driver whose workers start elsewhere, without the package on their path."""

import os
import subprocess
import sys

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
REPO = os.path.dirname(os.path.abspath(pipeline.__file__))

ALONE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
import corpus_pipeline
docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
print("rows", dict(corpus_pipeline.STAGES)["quality_classifier"](spark, docs, "/root/testdata/sf0.001").count())
"""


def test_a_stage_by_itself_ships_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith(("PYSPARK_GATEWAY", "SPARK_ENV"))}
    done = subprocess.run([sys.executable, "-c", ALONE.format(repo=REPO, shared=str(tmp_path / "shared"))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("rows")[1]) > 100
