"""Spark session settings for the shop jobs.

Everything that matters for scale is a session setting, not code: AQE re-plans
joins from runtime sizes (broadcast only under ``autoBroadcastJoinThreshold``,
a size Spark measures), coalesces small shuffle partitions and splits skewed
ones. Timestamps are compared in UTC so both engines agree.
"""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every shop job relies on.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Static estimates come from compressed file sizes and run low, so the planner never
    # broadcasts on its own; AQE broadcasts a side only when the shuffle size it measured at
    # run time is under 10 MB. (Explicit hints remain for results with a proven bound.)
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files are removed once the DataFrame that wrote them is unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

# Suggested for a large cluster reading ~100 TB: many initial shuffle
# partitions that AQE coalesces, ~256 MB target partitions, 256 MB file splits.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
    # existence checks screen the stored tables at their scan (plans/lookups.py)
    "spark.cobbler.screenLookups": "true",
}


def build_session(master: str | None = "local[8]", shuffle_partitions: int = 8,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the shop settings.

    ``master=None`` leaves the master to spark-submit (cluster runs).
    """
    builder = SparkSession.builder.appName("cobbler")
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in conf.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def apply_sql_conf(spark: SparkSession) -> SparkSession:
    """Apply the shop's SQL settings to an existing session (they are all runtime settings)."""
    for k, v in BASE_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str = "/tmp/cobbler-checkpoints") -> str:
    """Return the cluster's shared checkpoint folder; set ``fallback`` only if none is configured.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/...); without it this raises,
    since a machine-local folder would lose files. The fallback is for ``local[...]`` sessions only.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server's spark.checkpoint.dir applies
        target = spark.conf.get("spark.checkpoint.dir", None)
        if not target:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share") from None
        return target
    target = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not target:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        target = fallback
    sc.setCheckpointDir(target)
    return target


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``cobbler`` importable in executors' Python workers (once per application).

    Steps that run Python on executors (``mapInPandas``/``applyInPandas``) pickle
    their functions by module reference, so the workers need the package: it is
    zipped on the driver and distributed with ``addPyFile`` (what ``--py-files`` does).
    """
    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # Spark Connect
        sc, app = None, f"connect-{id(spark)}"
    if app in _SHIPPED:
        return
    if sc is not None and "cobbler" in (sc.getConf().get("spark.submit.pyFiles", "") or ""):
        _SHIPPED.add(app)                   # submitted with --py-files: executors already have it
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="cobbler-pkg-"), "cobbler.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    if sc is not None:
        sc.addPyFile(target)
    else:
        spark.addArtifacts(target, pyfile=True)
    _SHIPPED.add(app)
