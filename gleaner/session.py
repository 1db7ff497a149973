"""Spark session helpers.

The library never creates its own cluster settings on a real cluster: it reads
what the session already has and only fills in defaults for local runs/tests; where the
session names no Arrow batch size, ``bound_batches`` gives it one.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "gleaner") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # small single-file inputs: deal the parse over all cores
        .config("spark.gleaner.parsePartitions", str(2 * (os.cpu_count() if cores == "*" else int(cores))))
        # pages are wide rows: keep Arrow batches small so a batch of pages fits in a worker
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
        .config("spark.sql.execution.pythonUDF.arrow.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when the session has none (local runs, tests) a scratch folder is
    created and registered; on a cluster the setting must point to shared storage.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage (HDFS/S3/ABFS)")
    local = tempfile.mkdtemp(prefix="gleaner-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Most rows and bytes of an Arrow batch between executor and Python worker, where the session
#: names none. Pages, texts and a page's rules are wide rows: of Spark's 10,000 rows or 64 MB both
#: sides hold two batches at a time, in every task. The rows are a multiple of ``pieces``.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": "1m"}


def bound_batches(spark: SparkSession) -> None:
    """Give the session the Arrow batch sizes of ``BATCHES``; those it has set stay."""
    for k, v in BATCHES.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


_SHIPPED: set = set()


def ensure_shipped(spark: SparkSession) -> None:
    """Make this package importable in Python workers (what ``--py-files`` does), in batches
    that fit in them (``bound_batches``).

    Shipped once per SparkContext; skipped when the workers can already import it
    from an installed location.
    """
    import pathlib
    import zipfile

    bound_batches(spark)
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = pathlib.Path(__file__).resolve().parent
    if any(str(pkg.parent) == p for p in (os.environ.get("PYTHONPATH") or "").split(os.pathsep)):
        _SHIPPED.add(key)
        return
    out = pathlib.Path(tempfile.mkdtemp(prefix="gleaner-pyfiles-")) / "gleaner.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for f in pkg.rglob("*.py"):
            zf.write(f, f.relative_to(pkg.parent).as_posix())
    sc.addPyFile(str(out))
    _SHIPPED.add(key)
