"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters the records uniformly into buckets small enough for one
task's memory, by a seeded hash.  Pass two shuffles each bucket and writes it:
the bucket's records are scattered once more, into cells of about CELL_ROWS
records in a row, and each cell, put into a defined order, is shuffled by
Fisher-Yates with draws from the seed, the bucket, the cell and the step.  The
draws depend on nothing else, so one seed gives one shuffle on any cluster and
with any number of partitions.  A record's place in the whole shuffle is its
bucket's offset plus its place in the bucket; shards are equal ranges of
places, so their counts differ by one at most and most buckets lie in one
shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import removed, small_side, table, written

COPIES = 1000  # of a repeated row that one row of a chunk stands for
CELL_ROWS = 16  # of a bucket that are shuffled together; a swap copies a cell's references
BLOCK = 1000  # buckets whose offsets are added up together


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, none for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _keyed(rows: DataFrame, seed: int) -> DataFrame:
    """Rows with a seeded key of id and text, and of the copy's number where both repeat."""
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), "id", "text"))
    repeated = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "repeated")
    if repeated.isEmpty():
        return rows
    repeated = small_side(repeated)
    copies = rows.join(repeated, "key", "left_semi").groupBy("id", "text", "size", "key").agg(F.count(F.lit(1)).alias("n"))
    chunks = copies.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})"))).repartition("key", "chunk")
    each = chunks.withColumn("copy", F.explode(F.expr(f"sequence(chunk * {COPIES}, least(n, (chunk + 1) * {COPIES}) - 1)")))
    each = each.select("id", "text", "size", F.xxhash64("key", "copy").alias("key"))
    return rows.join(repeated, "key", "left_anti").select(each.columns).union(each)


def fisher_yates(rows: Column, *draw: Column) -> Column:
    """An array in random order: element i goes to a drawn place j of 0 to i, and the one that stood there to the end.

    The draws are hashes of `draw` and i, so they repeat.
    """

    def put(done: Column, row: Column) -> Column:
        i = F.size(done)
        j = F.pmod(F.xxhash64(*draw, i), i + 1).cast("int")
        swapped = F.concat(F.slice(done, F.lit(1), j), F.array(row), F.slice(done, j + 2, F.greatest(i - j - 1, F.lit(0))), F.array(F.get(done, j)))
        return F.when(j == i, F.array_append(done, row)).otherwise(swapped)

    return F.aggregate(rows, F.slice(rows, F.lit(1), F.lit(0)), put)


def shuffled_buckets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, bucket_bytes: int = 16 << 20) -> DataFrame:
    """Both passes; returns (id, text, size, text_crc32, bucket, place in the bucket) as written.

    The number of buckets follows the bytes of the input, so that a bucket
    stays near `bucket_bytes` at any scale.  Nulls are kept; a null text
    counts 8 bytes.  Rows are placed by seed, id and text alone, and rows equal
    in both are each kept and spread by their number among their equals.  Other
    columns of the input don't take part.  An empty input gives no rows.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("size", text_bytes(F.col("text")) + F.lit(8))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    buckets = max(1, -(-total["bytes"] // bucket_bytes))
    cells = max(1, total["rows"] // (buckets * CELL_ROWS))
    bucket = F.pmod(F.col("key"), F.lit(buckets)).cast("int")
    cell = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(cells)).cast("int")
    scattered = _keyed(rows, seed).select(bucket.alias("bucket"), cell.alias("cell"), F.struct("key", "id", "size", "text").alias("r"))
    gathered = scattered.repartition("bucket").groupBy("bucket", "cell").agg(F.array_sort(F.collect_list("r")).alias("own"))
    before = Window.partitionBy("bucket").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = gathered.withColumn("start", F.coalesce(F.sum(F.size("own")).over(before), F.lit(0)))
    mixed = placed.select("bucket", "start", F.posexplode(fisher_yates(F.col("own"), F.lit(seed), F.col("bucket"), F.col("cell"))).alias("place", "r"))
    crc = F.crc32(F.coalesce(F.col("r.text"), F.lit(""))).alias("text_crc32")
    return written(mixed.select("r.id", "r.text", "r.size", crc, "bucket", (F.col("start") + F.col("place")).alias("place")), "shuffle")


def assign_shards(buckets: DataFrame, shards: int) -> DataFrame:
    """Give each row of shuffled_buckets() its shard and its gapless slot there."""
    counts = written(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.expr(f"bucket div {BLOCK}")), "counts")
    # One row for BLOCK buckets, that is for 16 GB of input; within a block, one task for each.
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("block", "base")
    offsets = counts.join(blocks, "block").select("bucket", (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("start"))
    rows = counts.agg(F.sum("n")).first()[0] or 1
    placed = buckets.join(small_side(offsets), "bucket").withColumn("at", F.col("start") + F.col("place"))
    placed = placed.withColumn("shard", F.expr(f"cast((at * {shards}) div {rows} as int)"))
    first = F.expr(f"(cast(shard as bigint) * {rows} + {shards - 1}) div {shards}")
    return placed.withColumn("slot", F.col("at") - first).drop("start", "at", "place", "bucket")


def write_shards(df: DataFrame, path: str, shards: int = 24, **options) -> None:
    """Write the shuffled rows as one folder per shard, in slot order within each file."""
    placed = assign_shards(shuffled_buckets(df, **options), shards)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)


def op9_external_shuffle(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law `rows`; see the contract's columns."""
    placed = assign_shards(shuffled_buckets(table(spark, sf_dir, "documents")), 24)
    return placed.select(
        F.col("id").alias("doc_id"),
        F.col("size"),
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
