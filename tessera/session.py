"""Session helpers: configuration defaults and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults we want for every run; a cluster's own settings win because we only
# fill in keys that are unset.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def get_session(master: str | None = None, app: str = "tessera",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session; used by tests, bench and examples."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/S3/ABFS) folder
    and is used as is.  Only when nothing is configured and the master is local
    (unit tests, local runs) do we create a private folder under the system
    temp directory; on a cluster that would be a different disk for every
    executor, so it is an error there.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tessera-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably (survives executor loss) and cut lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Per-key side tables (one row per class, category, model ...) up to this many
# rows are broadcast when joined back to the rows.
SMALL_SIDE_MAX = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = SMALL_SIDE_MAX) -> DataFrame:
    """Mark ``df`` for broadcast when an exact count shows it within
    ``max_rows``; otherwise leave the join strategy to the planner (AQE).

    Used for joins on low-cardinality keys (class labels): there every key is
    hot, and a shuffle join would put a whole class into one task.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def local_path(p: str) -> str:
    """Strip a ``file:`` scheme for local checks in tests."""
    return p[5:] if p.startswith("file:") else p


__all__ = ["get_session", "ensure_checkpoint_dir", "scratch_path", "cut_lineage",
           "broadcast_if_small",
           "shuffle_partitions", "local_path"]
