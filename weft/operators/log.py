"""Logs of rows in a shared folder: batches are appended, readers take the last row of each key, and merges keep the number of files small.

An append is a folder of its own, which counts once it is whole. A merge writes what is current as a new base, with the names of the appends that are in it, and
counts once both are whole; so a reader sees all of a batch or nothing, before, while and after logs are merged, and an append that ends during a merge stays. What a merge replaces
is deleted by the next one, so readers that have begun find their files.
"""

from __future__ import annotations

import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Appends that readers put together before they are merged.
MERGE_AT = 32
# Fixed value: in the name of an append, what is followed by that of its run.
_RUN = "-of-"


def hadoop(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of a path, and the path, as Hadoop has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = hadoop(spark, path)
    fs.delete(at, True)


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share, below one of the application's own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root}/weft-rounds-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Deletes all such folders of the application; results that are not written yet need them."""
    delete(spark, scratch(spark).rpartition("/")[0])


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, written to a folder of its own and read from there: its lineage ends, and a lost executor costs nothing of it."""
    path = path or scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class MergeLog:
    """schema: of rows, in SQL; key: the columns by which a later row replaces an earlier one. A column `deleted` that is true takes its key out."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], merge_at: int = MERGE_AT) -> None:
        self.spark, self.path, self.key, self.merge_at = spark, path.rstrip("/"), key, merge_at
        self.schema = f"{schema}, _seq long, _nth long"
        self.fields = spark.createDataFrame([], schema).schema
        self.columns = self.fields.names
        self.appends = 0

    def _whole(self, name: str) -> bool:
        fs, at = hadoop(self.spark, f"{self.path}/{name}/_SUCCESS")
        return bool(fs.exists(at))

    def _parts(self) -> tuple[str | None, list[str], list[str]]:
        """The base, the appends that it lacks, and what it has replaced."""
        fs, at = hadoop(self.spark, self.path)
        if not fs.exists(at):
            return None, [], []
        names = sorted(f.getPath().getName() for f in fs.listStatus(at))
        bases = [n for n in names if n.startswith("base-") and self._whole(f"{n}/rows") and self._whole(f"{n}/merged")]
        base = bases[-1] if bases else None
        merged = {r.name for r in self.spark.read.schema("name string").parquet(f"{self.path}/{base}/merged").collect()} if base else set()  # a name for each append since the merge before
        live = [n for n in names if n.startswith("part-") and n not in merged and self._whole(n)]
        return base, live, [n for n in names if n in merged or (n.startswith("base-") and n < (base or ""))]

    def empty(self) -> bool:
        """Whether nothing was ever added."""
        base, live, _ = self._parts()
        return not base and not live

    def append(self, rows: DataFrame, run: str = "") -> DataFrame:
        """Adds rows as one batch, and gives them back as they are stored. Of rows of one key in a batch any may become the last.

        run: a name, of batches that have no key twice, neither in one of them nor in two; while there are no others, readers needn't look for the last row of a key.
        """
        seq = time.time_ns()
        path = f"{self.path}/part-{seq:020d}-{uuid.uuid4().hex}{_RUN if run else ''}{run}"
        self._dated(rows, seq).write.parquet(path)
        self.appends += 1
        if self.appends % self.merge_at == 0:
            self.merge()
        return self.spark.read.schema(self.schema).parquet(path).select(*self.columns)

    def replace(self, rows: DataFrame) -> None:
        """Makes rows, one for each key, all that is current; readers see the old rows until the new ones are whole."""
        _, live, replaced = self._parts()
        self._base(self._dated(rows, time.time_ns()), live, replaced)

    def _dated(self, rows: DataFrame, seq: int) -> DataFrame:
        return rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.fields), F.lit(seq).alias("_seq"), F.monotonically_increasing_id().alias("_nth"))

    def rows(self) -> DataFrame:
        """All rows that are there, older ones of a key as well."""
        return self._rows(*self._parts()[:2])

    def _rows(self, base: str | None, live: list[str]) -> DataFrame:
        paths = [f"{self.path}/{n}" for n in ([f"{base}/rows"] if base else []) + live]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def current(self) -> DataFrame:
        """The last row of each key, in the columns of the schema; a base has one of each, as the batches of one run have, so these are only read."""
        base, live, _ = self._parts()
        return self._current(base, live).select(*self.columns)

    def _current(self, base: str | None, live: list[str]) -> DataFrame:
        rows = self._rows(base, live)
        if not live:
            return rows
        runs = {n.partition(_RUN)[2] for n in live}
        return _there(rows) if base is None and len(runs) == 1 and runs != {""} else _there(_last(rows, self.key))

    def merge(self) -> None:
        """Makes a new base of what is current, and deletes what the base before had replaced."""
        base, live, replaced = self._parts()
        if not live:
            return
        self._base(self._current(base, live), live, replaced)

    def _base(self, rows: DataFrame, live: list[str], replaced: list[str]) -> None:
        """Puts rows in the place of the base and of the appends that are live."""
        name = f"base-{time.time_ns():020d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}/rows")
        self.spark.createDataFrame([(n,) for n in [*live, *(n for n in replaced if n.startswith("part-"))]], "name string").coalesce(1).write.parquet(f"{self.path}/{name}/merged")
        for n in replaced:
            delete(self.spark, f"{self.path}/{n}")


def _last(rows: DataFrame, key: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_seq", "_nth")).alias("_last")).select(*key, "_last.*")


def _there(rows: DataFrame) -> DataFrame:
    return rows.where("not coalesce(deleted, false)") if "deleted" in rows.columns else rows
