"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings every plan here relies on; all can be set on a live session.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

#: Shuffle files go when the query that wrote them ends, not when the driver happens to collect its garbage.
CLEANED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Tables dealt out by one key are joined where they lie, whatever other keys the join has.
IN_PLACE = ("spark.sql.requireAllClusterKeysForCoPartition", "false")
#: Generated methods over 8000 bytes of code are never compiled by the JVM; such a stage is run an operator at a time instead.
COMPILED = ("spark.sql.codegen.hugeMethodLimit", "8000")


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("revlens").config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.ui.enabled", "false")
    for key, value in RUNTIME.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


class Scratch:
    """Tables written to the folder named by ``spark.checkpoint.dir``.

    Writing a table and reading it back cuts the lineage: a lost executor costs
    the re-read of the file, not the recomputation. Where the session names no
    folder (tests on one machine) a temporary one is made and set. Files go when
    the JVM ends, or earlier through :meth:`drop`.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='revlens-')}"
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        path = self._path(self.root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def save(self, frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(frame.schema).parquet(f"{self.root}/{name}")

    def save_by(self, frame: DataFrame, name: str, key: str, parts: int) -> DataFrame:
        """Like :meth:`save`, dealt into ``parts`` by the hash of ``key``: what joins, groups or ranks by the key reads it without a shuffle.

        The catalog knows the table only until it is read; its files go like all others.
        """
        table = f"{name}_{uuid.uuid4().hex}"
        with settings(self.spark, {"spark.sql.shuffle.partitions": str(parts), **CLEANED}):
            frame.write.format("parquet").bucketBy(parts, key).option("path", f"{self.root}/{name}").saveAsTable(table)
        saved = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")
        return saved

    def drop(self, *names: str) -> None:
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = self._path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for the jobs run inside."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def arrow_rows(spark: SparkSession, rows: int):
    """Rows per Arrow batch for the jobs run inside, where single rows are large."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)})


_SHIPPED: set[str] = set()
#: Bytes of a batch that a Python worker reads, and the setting it replaces where the session has Spark's default.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m", "67108864b")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that Python workers can import it anywhere, and bounds their batches."""
    key, small, default = BATCH_BYTES
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, small)
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="revlens-code-")) / "revlens_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(application)
