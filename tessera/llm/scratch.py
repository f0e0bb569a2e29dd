"""Tables that cut lineage, in the shared folder named by spark.checkpoint.dir.

Every operator that has to use a costly intermediate result twice writes it here as Parquet and
reads it back, so a lost executor costs a re-read, never a recomputation of the whole lineage.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from tessera.session import ship

KEY = "spark.checkpoint.dir"
#: Rows of an Arrow batch. Spark's own default suits numbers; so many texts fill memory on both sides of the pipe.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def prepare(spark: SparkSession) -> None:
    """Ship the package, and use smaller Arrow batches where the session has Spark's default."""
    ship(spark)
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. One on this machine is made only where none is named and nothing else runs (tests, laptops)."""
    path = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{KEY} must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set(KEY, path)
    return path.rstrip("/")


def slim(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage and hand what it freed back to the system.

    Shuffle files of finished steps stay until their handles are collected; and each of the many threads of a driver
    keeps native memory of its own that it has freed.
    """
    jvm = spark._jvm
    jvm.System.gc()
    try:
        server, arguments = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), spark.sparkContext._gateway.new_array(jvm.Object, 4)
        arguments[0], arguments[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(server, arguments)  # by reflection, since the server's own class is not exported
    except Py4JError:  # another virtual machine, or one without this command
        pass


class Scratch:
    """A private folder below the shared one. drop() removes it; so does the end of the session."""

    def __init__(self, spark: SparkSession, name: str = "scratch"):
        prepare(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"
        fs, path = self._fs(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        self._n = 0

    def _fs(self, where: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str = "table", compression: str | None = None) -> DataFrame:
        """df, written once and read back."""
        where = self.path(name)
        writer = df.write.option("compression", compression) if compression else df.write
        writer.parquet(where)
        slim(self.spark)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._tessera_path = where  # noqa: SLF001
        return out

    def forget(self, df: DataFrame) -> None:
        """Delete a table made by keep() that nothing reads any more."""
        if where := getattr(df, "_tessera_path", None):
            fs, path = self._fs(where)
            fs.delete(path, True)

    def drop(self) -> None:
        fs, path = self._fs(self.root)
        fs.delete(path, True)
