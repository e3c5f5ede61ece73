"""Where tables that outlive a stage are written: the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from winnow.plans.errors import ConfigError

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a local session gets a folder of this machine, and any other an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ConfigError("On a cluster, spark.checkpoint.dir must name a folder that driver and executors share", option="spark.checkpoint.dir")
    if "dir" not in _local:
        _local["dir"] = "file://" + tempfile.mkdtemp(prefix="winnow-scratch-")
    return _local["dir"]
