"""Session defaults for local runs and the shared scratch folder."""

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, wherever the driver was started; once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="ticketloom-package-")) / "ticketloom.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        context.addPyFile(str(archive))  # Spark serves the file to every executor
        _SHIPPED.add(context.applicationId)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8,
                  app: str = "ticketloom", **config: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for name, value in config.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for intermediate tables and stream checkpoints.

    It lies in the folder the cluster names in `spark.checkpoint.dir`, which every executor can
    reach. Only a session that runs in one process may fall back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="ticketloom-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
