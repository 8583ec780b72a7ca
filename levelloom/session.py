"""Session defaults and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "levelloom", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench. On a cluster, use the session you are given."""
    b = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LEVELLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.extraJavaOptions", "-Dderby.system.home=/tmp")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the operators profit from; values set by the user stay.

    HotSpot never compiles methods above 8000 bytes of bytecode, so fused stages larger
    than that run interpreted; below the limit Spark splits them instead. Batches handed to
    Python are kept small in bytes, as a batch exists several times at once (Arrow, strings,
    results) and a row may hold a very long text. While a query runs, Spark would broadcast
    what took few bytes in a shuffle; sorted rows pack to a hundredth of what they take in the
    driver, so only tables that are small as files are broadcast. Shuffle files go when the
    action that wrote them ends, not when the driver happens to collect garbage.
    """
    for key, default, better in (("spark.sql.codegen.hugeMethodLimit", "65535", "8000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"), ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false", "true")):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, better)
    small, runtime = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(small, "10485760b") == "10485760b" and spark.conf.get(runtime, "-1") == "-1":
        spark.conf.set(runtime, "-1")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    On a cluster this is storage all executors share. Only where the session has none
    and runs in local mode is one made here.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path for intermediate data of this application."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table under ``path``, or an empty one where nothing is stored yet."""
    p, fs = _file(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(p) else spark.createDataFrame([], schema)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _file(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    p, fs = _file(spark, path)
    if not fs.rename(p, _file(spark, to)[0]):
        raise OSError(f"cannot move {path} to {to}")


def age_by_name(spark: SparkSession, path: str) -> None:
    """Give the files of a folder, in the order of their names, modification times a second apart."""
    p, fs = _file(spark, path)
    files = sorted((f.getPath() for f in fs.listStatus(p)), key=lambda f: f.getName())
    for i, f in enumerate(files):
        at = fs.getFileStatus(files[0]).getModificationTime() if i == 0 else at + 1000
        fs.setTimes(f, at, -1)
        if fs.getFileStatus(f).getModificationTime() // 1000 != at // 1000:
            raise OSError(f"cannot set the time of {f}")


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that still read them must be stored first."""
    remove(spark, f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return it read back.

    Chained two-level scans read their input twice, so a long chain would read its
    source exponentially often; cutting between stages keeps every stage linear. A
    written table survives lost executors, is compressed, and lets later stages prune
    columns and see its true size.
    """
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """Tables of a chain of steps: each one written is read by the next, and deleted once nothing reads it.

    Written tables survive lost executors, so what they were made from is not needed again.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, tuple[str, str | None]] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """``cut`` under a name."""
        path = scratch(self.spark, name)
        df.write.parquet(path)
        self.tables[name] = (path, None)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucket(self, name: str, df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
        """``cut`` under a name into ``n`` buckets by ``keys``: windows and joins on them leave the rows where they lie."""
        path, table = scratch(self.spark, name), f"levelloom_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(n, *keys).option("path", path).saveAsTable(table)
        self.tables[name] = (path, table)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        for name in names:
            path, table = self.tables.pop(name)
            if table:
                self.spark.sql(f"DROP TABLE {table}")
            remove(self.spark, path)
