"""Session helpers: building, shipping the package, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast by ``broadcast_if_small``.
BROADCAST_ROWS = 50_000

_PACKAGE = Path(__file__).resolve().parent


def build_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under."""
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoints that nothing refers to any more are deleted
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    return SparkSession.builder.master(f"local[{cpus}]").appName("shutterstack").config(map=settings).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_shutterstack_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="shutterstack-")) / "shutterstack.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(_PACKAGE.rglob("*.py")):
            archive.write(source, source.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(target))
    sc._shutterstack_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``checkpoint()`` usable. The cluster's ``spark.checkpoint.dir`` is used where it is set.

    Where it is unset, a local session gets a temporary folder; on a cluster a machine-local folder
    would not survive the loss of an executor, so that raises instead.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shutterstack-checkpoint-")
    sc.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder; its lineage starts there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def drawn(df: DataFrame, by: Column, n: int, total: int) -> DataFrame:
    """The about ``n`` rows of ``total`` with the smallest hashes ``by`` (long): a random sample that is the same every time.

    Rows beyond a bound that half as many again stay below are filtered where they are, so the one task that
    orders them gets a bounded number however many partitions there are.
    """
    share = min(1.0, (1.5 * n + 20) / max(1, total))
    few = df if share == 1 else df.where(by <= int(-(2**63) + share * (2**64 - 1)))
    return few.orderBy(by).limit(n)
