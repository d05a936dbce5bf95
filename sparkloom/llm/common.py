"""What the corpus operators share: tables, the shared folder, written intermediates, maps over texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast
from pyspark.sql.types import StructType

#: Texts that a task holds as Python strings at once; Arrow batches are cut into such parts.
PART_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan that has fewer partitions than the session has cores, dealt evenly over these; any other as it is.

    A small file may be one row group, which one task would read and work on
    alone.  Work on texts in Python costs far more than moving them.  For
    scans only: of a frame with shuffles the count would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir or the context's checkpoint folder.

    Where neither is set, a session within one process (tests, a notebook) gets
    a temporary folder; on a cluster that is an error, since executors would
    write where the driver can't read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sparkloom-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_side(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """Mark a narrow table for broadcast if it has no more than `most_rows` rows; else leave the join to be dealt by key."""
    return broadcast(df) if df.count() <= most_rows else df


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet to the shared folder, read them back.

    Written files survive lost executors and, unlike a cache, are computed once.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(*frames: DataFrame) -> None:
    """Delete the files of tables made by written() that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_texts(df: DataFrame, text_col: str, keep: list[str], new: dict[str, tuple[str, pa.DataType]], begin: Callable[[], Callable[[list], list[list]]]) -> DataFrame:
    """Columns `keep` and `new` (name -> Spark type, Arrow type) of every row, the new ones from its whole text.

    `begin` is called once in a task, so caches live no longer than it; what it
    returns takes the texts of PART_ROWS rows and gives the lists of the new
    columns.  Kept columns pass through as they are; one that has the name of a
    new one is left out.  Rows map one to one and nothing is shuffled.
    """
    keep = [c for c in keep if c.lower() not in {n.lower() for n in new}]
    used = keep if text_col in keep else [*keep, text_col]
    frame, at_text = df.select(*[F.col(f"`{c}`") for c in used]), used.index(text_col)
    added = StructType.fromDDL(", ".join(f"`{n}` {kind}" for n, (kind, _) in new.items()))
    schema = StructType([*frame.schema.fields[: len(keep)], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts_of = begin()
        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(at, PART_ROWS)
                made = texts_of(part.column(at_text).to_pylist())
                columns = [pa.array(values, kind) for values, (_, kind) in zip(made, new.values())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *columns], names=schema.names)

    return frame.mapInArrow(run, schema)
