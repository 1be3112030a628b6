"""What a session needs before Python code of this package runs on executors."""

from __future__ import annotations

import hashlib
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_BATCH_KEY, _DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
BATCH = 2000  # rows of an Arrow batch; Spark's own default suits short rows, not documents


def local_dir(spark: SparkSession) -> str:
    """A temporary folder of this machine, for local sessions only: on a cluster other machines
    can't see it, so spark.checkpoint.dir must name a shared one."""
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tessellate-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session; in a
    local session, where that may be unset, one of our own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return top.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(local_dir(spark))
    return sc.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: cuts the lineage, and what is read back
    survives the loss of the executors that made it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shipped(spark: SparkSession) -> None:
    """Gives the executors this package, once for each SparkContext: they need not have it
    installed.  The archive is written to the folder in spark.checkpoint.dir, which driver and
    executors share; to a temporary one only in a local session where that is unset.  Bounds
    the rows of a batch that a Python worker holds, unless the session sets such a bound."""
    if spark.conf.get(_BATCH_KEY, None) == _DEFAULT and _BATCH_KEY not in {k for k, _ in spark.sparkContext.getConf().getAll()}:
        spark.conf.set(_BATCH_KEY, BATCH)
    sc = spark.sparkContext
    if getattr(sc, "_tessellate_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted((root / "tessellate").rglob("*.py")):
            z.write(f, f.relative_to(root))
    top = spark.conf.get("spark.checkpoint.dir", None) or f"file://{local_dir(spark)}"
    place = f"{top.rstrip('/')}/tessellate_{hashlib.sha256(packed.getvalue()).hexdigest()[:16]}.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(place)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(packed.getvalue())
    out.close()
    sc.addPyFile(fs.makeQualified(path).toString())
    sc._tessellate_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than the cluster has cores (one large row group, say) dealt to
    all of them.  What is shuffled is at most that many splits; a larger scan stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, count: int, rows: int) -> DataFrame:
    """df of `count` rows dealt to tasks of about `rows` each, for work that is dear in each row:
    splits of a scan may be empty, as a row group is read by one of them."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-count // rows)))


def session(name: str = "tessellate", cores: str = "*", partitions: int | None = None) -> SparkSession:
    """A local session for the command line; on a cluster pass your own to the functions."""
    conf = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    if SparkSession.getActiveSession() is None:
        conf = conf.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", partitions or 8)
    return conf.getOrCreate()
