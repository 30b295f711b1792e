"""Digests of files and tables that are kept, so that a later fingerprint reads only what has changed.

A data file is known by its path, length and time of modification. For a table each file has its row count and two sums of row hashes, as in table_summary(), and
those of the table are the sums over its files: the fingerprint is that of the rows, whatever files they are in. Other files have a digest of their content, and a tree of digests, by
ranges of a hash of their paths below the folder, leads to that of the folder; two trees are compared from the root down.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.log import MergeLog, hadoop
from .fingerprint import fingerprint_of, table_fingerprint

#: Bytes of a file whose content is read as one value; the digest of a larger one is of its length and time.
MOST_BYTES = 1 << 30
#: Changed files that are named in a filter; if more have changed, all are read.
MOST_PATHS = 10_000
#: Children of a node of a tree, as bits.
BITS = 8
_BIG = "decimal(38,0)"
_SCHEMA = "kind string, path string, size long, modified timestamp, digest string, n long, h1 decimal(38,0), h2 decimal(38,0)"


@dataclass
class Read:
    """What fingerprints have listed and read so far."""

    files: int = 0
    files_read: int = 0
    bytes_read: int = 0


class Digests:
    """Digests kept in a shared folder. read counts what fingerprints made through it have read."""

    def __init__(self, spark: SparkSession, place: str) -> None:
        self.spark, self.read = spark, Read()
        self.log = MergeLog(spark, place, _SCHEMA, ["kind", "path"])

    def _listed(self, path: str) -> DataFrame:
        """path, size, modified of the files below a folder; nothing of them is read. Files without content do not count, as Spark passes them over."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))

    def _current(self, kind: str, listed: DataFrame, made: DataFrame) -> DataFrame:
        """Digests of the listed files: those that are kept, and new ones for files that are new or have changed, of which made(path, digest, n, h1, h2) is read."""
        kept = self.log.current().where(F.col("kind") == kind).drop("kind")
        rows = listed.join(kept, ["path", "size", "modified"], "left").withColumn("known", F.col("digest").isNotNull() | F.col("n").isNotNull())
        counts = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("known")).alias("new"), F.coalesce(F.sum(F.when(~F.col("known"), F.col("size"))), F.lit(0)).alias("bytes")).first()
        self.read.files += counts.n
        self.read.files_read += counts.new
        self.read.bytes_read += counts.bytes
        if not counts.new:
            return rows.drop("known")
        new = rows.where("not known").select("path", "size", "modified")
        if counts.new <= MOST_PATHS:
            made = made.where(F.col("_metadata.file_path").isin([r.path for r in new.select("path").collect()]))  # files are left out before they are opened
        digests = new.join(self._made(kind, made), "path", "left")
        digests = digests.withColumns({"n": F.coalesce("n", F.lit(0)), "h1": F.coalesce("h1", F.lit(0).cast(_BIG)), "h2": F.coalesce("h2", F.lit(0).cast(_BIG))})  # files without rows
        self.log.append(digests.withColumn("kind", F.lit(kind)).coalesce(8))
        return listed.join(self.log.current().where(F.col("kind") == kind).drop("kind"), ["path", "size", "modified"])

    @staticmethod
    def _made(kind: str, rows: DataFrame) -> DataFrame:
        path = F.col("_metadata.file_path").alias("path")
        none = F.lit(None)
        if kind == "content":
            large = F.concat_ws("|", "length", F.unix_micros("modificationTime"))
            small = rows.where(F.col("length") <= MOST_BYTES).select(path, F.sha2("content", 256).alias("digest"))
            own = small.union(rows.where(F.col("length") > MOST_BYTES).select(path, F.sha2(large, 256)))
            return own.select("path", "digest", none.cast("long").alias("n"), none.cast(_BIG).alias("h1"), none.cast(_BIG).alias("h2"))
        row = [F.col(f"`{c}`") for c in sorted(rows.columns)]
        sums = [F.count("*").alias("n"), F.sum(F.xxhash64(*row).cast(_BIG)).alias("h1"), F.sum(F.xxhash64(F.lit(1), *row).cast(_BIG)).alias("h2")]
        return rows.groupBy(path).agg(*sums).select("path", none.cast("string").alias("digest"), "n", "h1", "h2")

    def table_files(self, name: str) -> DataFrame | None:
        """path, size, modified, n, h1, h2 of each file of a table; None for views, which have none."""
        place = location(self.spark, name)
        return None if place is None else self._row_files(self.spark.table(name), place)

    def _row_files(self, df: DataFrame, place: str) -> DataFrame:
        return self._current(hashlib.sha256(df.schema.json().encode()).hexdigest(), self._listed(place), df).drop("digest")

    def table(self, name: str) -> str:
        """What table_fingerprint() gives for the table."""
        place = location(self.spark, name)
        return table_fingerprint(self.spark.table(name)) if place is None else self.rows(self.spark.table(name), place)

    def rows(self, df: DataFrame, place: str) -> str:
        """What table_fingerprint() gives for df, which has all rows of the files in a folder."""
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(_BIG)
        s = self._row_files(df, place).agg(total("n").alias("n_rows"), total("h1").alias("h1"), total("h2").alias("h2")).first()
        return fingerprint_of(df.schema, s)

    def files(self, path: str) -> DataFrame:
        """path (below the folder), size, modified, digest of each file."""
        rows = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        found = self._current("content", self._listed(path), rows)
        fs, at = hadoop(self.spark, path)
        root = self.spark.sparkContext._jvm.org.apache.spark.paths.SparkPath.fromPath(fs.makeQualified(at)).urlEncoded().rstrip("/") if not any(c in path for c in "*?[{") else ""
        below = F.regexp_replace("path", r"^file:/+", "/")
        start = len("/" + root.removeprefix("file:").lstrip("/")) + 1 if root.startswith("file:") else len(root) + 1
        return found.select((F.substring(below, start + 1, 1 << 20) if root.startswith("file:") else F.substring("path", start + 1, 1 << 20)).alias("path") if root else "path", "size", "modified", "digest")

    def folder(self, path: str) -> str:
        """The digest at the root of a folder's tree; of a fixed text for no files."""
        top = tree(self.files(path)).where("level = 0").first()
        return top.digest if top else hashlib.sha256(b"").hexdigest()


def location(spark: SparkSession, name: str) -> str | None:
    """The folder of a table; None for views."""
    rows = {r.col_name: r.data_type for r in spark.sql(f"describe formatted {name}").where("col_name in ('Location', 'Type')").collect()}
    return None if "VIEW" in rows.get("Type", "") else rows.get("Location")


def _place(path: Column, level: int) -> Column:
    """Which node of a level a path is below: the first bits of a hash of it."""
    return F.shiftrightunsigned(F.xxhash64(path), 64 - BITS * level).cast("int") if level else F.lit(0)


def tree(files: DataFrame, levels: int = 2) -> DataFrame:
    """files(path, digest) to level, node, digest: the nodes that have files, down to the level whose nodes are of files; the root is at level 0."""
    text = F.concat(F.lpad(F.length("path").cast("string"), 10, "0"), "path", "digest")
    nodes = files.groupBy(_place(F.col("path"), levels).alias("node")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n"), 256).alias("digest"))
    out = nodes.select(F.lit(levels).alias("level"), "node", "digest")
    for level in range(levels - 1, -1, -1):
        text = F.concat(F.lpad("node", 10, "0"), "digest")
        parent = F.shiftrightunsigned("node", BITS).cast("int")
        nodes = nodes.groupBy(parent.alias("node")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n"), 256).alias("digest"))
        out = out.union(nodes.select(F.lit(level), "node", "digest"))
    return out


def changed(before: DataFrame, after: DataFrame, levels: int = 2) -> DataFrame:
    """before(path, digest), after(path, digest) to path, change (added, removed, changed). Only files below nodes that differ are compared."""
    a, b = tree(before, levels).where(F.col("level") == levels), tree(after, levels).where(F.col("level") == levels)
    differ = a.select("node", F.col("digest").alias("was")).join(b.select("node", "digest"), "node", "full").where("not (was <=> digest)").select("node")
    own = lambda df, name: df.withColumn("node", _place(F.col("path"), levels)).join(differ, "node", "left_semi").select("path", F.col("digest").alias(name))
    rows = own(before, "was").join(own(after, "now"), "path", "full").where("not (was <=> now)")
    return rows.select("path", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed").alias("change"))
