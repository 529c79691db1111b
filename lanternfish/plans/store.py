"""Tables that several queries share, written once a session and read again.

Keyed titles, resolved entities, the name index and the token index are made from the
catalogue alone; a query that needs one reads its Parquet, so the title parser and the
normaliser run once, not at every use in a plan. A table is made anew when the file it
comes from has another size or time.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEPT: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a session on one machine may do without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lanternfish-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _state(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p)
    return status.getLen(), status.getModificationTime()


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], source: str = "part") -> DataFrame:
    """make(), from the first call on read from the shared folder."""
    path = f"{sf_dir}/{source}.parquet"
    key = (spark.sparkContext.applicationId, path, _state(spark, path), name)
    if key not in _KEPT:
        to = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        make().write.parquet(to)
        _KEPT[key] = to
    return spark.read.parquet(_KEPT[key])
