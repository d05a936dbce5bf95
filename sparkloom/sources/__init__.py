"""Readers and writers with defaults and limits around Spark's own."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

RANGE_CAP = 10_000_000


class PathNotAllowed(ValueError):
    """A path outside the base folder."""


def confine(path: str, base: str | None) -> str:
    """The path, if it lies below `base` (any scheme, on the same store); without a base any path.

    Parent steps are refused, whatever they lead to.
    """
    if base is None:
        return path
    p, b = urlsplit(path), urlsplit(base)
    root = b.path.rstrip("/") + "/"
    if ".." in p.path.split("/") or (p.scheme or b.scheme, p.netloc or b.netloc) != (b.scheme, b.netloc):
        raise PathNotAllowed(path)
    full = p.path if p.path.startswith("/") else root + p.path
    if not (full.rstrip("/") + "/").startswith(root):
        raise PathNotAllowed(path)
    return f"{b.scheme}://{b.netloc}{full}" if b.scheme else full


@dataclass
class Files:
    """File reads and writes below one base folder."""

    spark: SparkSession
    base: str | None = None

    def csv(self, path: str, schema: str | None = None, **options) -> DataFrame:
        """CSV with a header; types are inferred only if no schema is given, since that reads the data twice."""
        given = {"header": "true", "inferSchema": str(schema is None).lower()} | {k: str(v) for k, v in options.items()}
        reader = self.spark.read.options(**given)
        return (reader.schema(schema) if schema else reader).csv(confine(path, self.base))

    def json(self, path: str, schema: str | None = None, **options) -> DataFrame:
        """JSON lines."""
        reader = self.spark.read.options(**options)
        return (reader.schema(schema) if schema else reader).json(confine(path, self.base))

    def parquet(self, path: str) -> DataFrame:
        """Parquet, scanned lazily."""
        return self.spark.read.parquet(confine(path, self.base))

    def load(self, path: str, kind: str | None = None) -> DataFrame:
        """Any of these by format or file ending."""
        kind = kind or (m[1] if (m := re.search(r"\.(csv|json|parquet|orc)(\.\w+)?/?$", path)) else "parquet")
        return {"csv": self.csv, "json": self.json, "parquet": self.parquet}.get(kind, lambda p: self.spark.read.format(kind).load(confine(p, self.base)))(path)

    def write(self, df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options) -> None:
        """A folder of part files, with k=v folders below it if partitioned.

        Rows are dealt by the partition columns and a salt first, so that a
        value's files are few and a frequent value is still written by many tasks.
        """
        if partition_by:
            from pyspark.sql import functions as F

            df = df.repartition(*partition_by, F.floor(F.rand(17) * 8))
        writer = df.write.mode(mode).options(**options)
        (writer.partitionBy(*partition_by) if partition_by else writer).format(kind).save(confine(path, self.base))


def working_folder(spark: SparkSession) -> str:
    """The folder for files that all executors share, from spark.checkpoint.dir.

    Where it is unset, a session within one process gets a temporary folder; on
    a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sparkloom-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def single_column(spark: SparkSession, values: Iterable, kind: str) -> DataFrame:
    """One column called value; values are wrapped, so strings, numbers and nulls may come from any iterable."""
    return spark.createDataFrame([(v,) for v in values], f"value {kind}")


def capped_range(spark: SparkSession, start: int, end: int, step: int = 1, cap: int = RANGE_CAP) -> DataFrame:
    """spark.range with a cap on its rows."""
    if len(range(start, end, step)) > cap:
        raise ValueError(f"a range of more than {cap} rows")
    return spark.range(start, end, step)


@dataclass
class Jdbc:
    """Options of a JDBC read or write; SQL of the caller's own can be forbidden."""

    url: str
    properties: dict[str, str] = field(default_factory=dict)
    trust_sql: bool = False

    CALLER_SQL = ("query", "sessionInitStatement", "prepareQuery")

    def options(self, **more) -> dict[str, str]:
        """All options, checked."""
        out = {"url": self.url} | self.properties | {k: str(v) for k, v in more.items()}
        if not self.trust_sql and (bad := [k for k in out if k.lower() in {x.lower() for x in self.CALLER_SQL}]):
            raise PermissionError(f"statements of the caller's own are not allowed: {', '.join(bad)}")
        if ("partitionColumn" in out) != all(k in out for k in ("lowerBound", "upperBound", "numPartitions")):
            raise ValueError("partitionColumn, lowerBound, upperBound and numPartitions go together")
        return out

    def read(self, spark: SparkSession, table: str, **more) -> DataFrame:
        """Read a table, in parallel if partition bounds are given."""
        return spark.read.format("jdbc").options(**self.options(dbtable=table, **more)).load()

    def write(self, df: DataFrame, table: str, mode: str = "errorifexists", **more) -> None:
        """Write a table."""
        df.write.format("jdbc").mode(mode).options(**self.options(dbtable=table, **more)).save()

    def __str__(self) -> str:
        return re.sub(r"(?i)(password|user)=[^&;]*", r"\1=***", re.sub(r"//[^/@]*@", "//***@", self.url))


def delta_options(version: int | None = None, timestamp: str | None = None, merge_schema: bool = False) -> dict[str, str]:
    """Options of a Delta read or write; the format itself needs its jar on the cluster."""
    if version is not None and timestamp is not None:
        raise ValueError("a version or a timestamp, not both")
    out = {"versionAsOf": version, "timestampAsOf": timestamp, "mergeSchema": "true" if merge_schema else None}
    return {k: str(v) for k, v in out.items() if v is not None}
