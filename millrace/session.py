"""Session helpers: a local session for tests, the shared scratch folder, tables written once and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Setting that names the folder all executors share.
SHARED_DIR = "spark.checkpoint.dir"


#: Bytes of a method the JVM still compiles. Spark's own limit is 8 times as high: long programs would then run interpreted.
METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def compile_in_pieces(spark: SparkSession) -> None:
    """Lets Spark generate code in pieces that the JVM compiles, unless the session has a limit of its own."""
    if spark.conf.get(METHOD_LIMIT, "65535") == "65535":
        spark.conf.set(METHOD_LIMIT, "8000")


def local_session(cpus: str | int = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    b = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    for k, v in ({"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"} | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables.

    It is read from ``spark.checkpoint.dir``. Only a local session, where that is unset, gets a temporary folder; on a
    cluster a machine's own folder would be lost with the machine, so there an unset value is an error.
    """
    named = spark.conf.get(SHARED_DIR, None) or spark.sparkContext.getConf().get(SHARED_DIR, None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError(f"set {SHARED_DIR} to a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        holder = tempfile.TemporaryDirectory(prefix="millrace-")
        shared_dir.holder = holder  # type: ignore[attr-defined]  # removed when the process ends
        own = shared_dir.own = f"file://{holder.name}"  # type: ignore[attr-defined]
    return own


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df`` as a table written once to the shared folder: later uses read it instead of computing it again.

    The table survives the loss of executors. It is removed when the driver ends. Hashes and numbers don't get smaller by `zstd`: `snappy` costs less for them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-tables/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    def drop() -> None:
        try:
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the session may be gone already
            pass

    atexit.register(drop)


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per session: they need not have it installed."""
    sc = spark.sparkContext
    if getattr(ship, "sent", None) == sc.applicationId:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="millrace-ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    ship.sent = sc.applicationId  # type: ignore[attr-defined]
