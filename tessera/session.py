"""Shipping this package to the workers of a session."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "_tessera_shipped"


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, _SHIPPED, False):
        return
    here = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="tessera-ship-")) / "tessera_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, Path("tessera") / p.relative_to(here))
    context.addPyFile(str(target))
    setattr(context, _SHIPPED, True)


class Memo:
    """make(text), made once for equal short texts as long as these fit in `room` characters, then anew."""

    def __init__(self, make: Callable[[str], Any], room: int = 1 << 17, longest: int = 1 << 12):
        self.make, self.room, self.longest, self.held, self.used = make, room, longest, {}, 0

    def __call__(self, text: str) -> Any:
        if text in self.held:
            return self.held[text]
        made = self.make(text)
        if len(text) <= self.longest:
            if self.used > self.room:
                self.held, self.used = {}, 0
            self.held[text] = made
            self.used += len(text) + 1
        return made


class Tables:
    """Tables that cut lineage, in the shared folder of the session."""

    def __init__(self, spark: SparkSession, name: str = "tables"):
        ship(spark)
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tessera-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark, self.root, self._n = spark, f"{base.rstrip('/')}/tessera-{name}-{uuid.uuid4().hex[:12]}", 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df, written once and read back."""
        self._n += 1
        where = f"{self.root}/{self._n:03d}-{name}"
        df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)
