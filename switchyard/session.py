"""Session helpers: table loading, checkpointing in the shared folder, checked broadcasts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows a side may have to be sent to every executor. The rows are counted before.
BROADCAST_ROWS = 200_000
#: Most bytes of text in such a side, where its texts have no bound of their own.
BROADCAST_BYTES = 32 << 20


def build_session(app: str = "switchyard", master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and single machines. A cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """The folder named by spark.checkpoint.dir. A temporary one stands in on a single machine only: on a cluster, others could not read it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    return tempfile.mkdtemp(prefix=f"switchyard-{purpose}-")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoint"))


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, which outlives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most limit rows. A plain count, which reads only the footers of a table's files."""
    return df.count() <= limit


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its files are fewer than these and costly work follows; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the package to the executors' Python workers, once per application, wherever they run.

    The archive is read on the driver only; Spark's file server hands it out.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="switchyard-")) / f"{home.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(home.rglob("*.py")):
            z.write(path, path.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
