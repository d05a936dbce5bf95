"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

Documents with equal shingle sets are one class from the start.  Classes that
share a band of their sketches are candidates.  First every class is compared
with the best-connected class of each of its bands (the hub), which joins
nearly all members of a group by one comparison each.  Then, in each band that
still has several components, the members outside the hub's component are
compared with all others of another component, in blocks, inside tasks; a pair
is looked at in its first common band only.  All comparisons that make links
are of full shingle sets, and pairs that are already connected are skipped, so
the components are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, removed, small_side, spread, table, written
from .components import connected_components
from .shingles import WordHashes, fast_similarity_sketch, shingle_set

WIDTH, PERCENT = 5, 75
#: A pair of similarity 0.75 misses all bands with a chance of (1 - 0.75 ** 3) ** 40 = 3e-10,
#: and one coordinate in two at least agrees but for 2e-9.
BANDS, PER_BAND = 40, 3
LEAST_AGREEING = 60
BLOCK = 2000


def linked(common, a, b, percent: int = PERCENT):
    """The exact rule: 100 times the intersection is at least `percent` times the union."""
    return 100 * common >= percent * (a + b - common)


def _sid(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def sketches(df: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(id, n_shingles, sid, sketch) of every whole text; sid is the 128-bit hash of the shingle set, null without shingles."""

    def begin():
        hashes = WordHashes()

        def sketch(texts: list[str | None]) -> list[list]:
            sets = [shingle_set(t, width, hashes) for t in texts]
            low = fast_similarity_sketch(sets, BANDS * PER_BAND).astype("<u2")
            return [[len(s) for s in sets], [_sid(s) for s in sets], [x.tobytes() if len(s) else None for x, s in zip(low, sets)]]

        return sketch

    new = {"n_shingles": ("long", pa.int64()), "sid": ("binary", pa.binary()), "sketch": ("binary", pa.binary())}
    return map_texts(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", ["id"], new, begin)


def shingle_sets_of(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(sid, shingles): the full sets of the classes in `wanted` (id, sid), from the text of one document each.

    An id that is null stands for all documents without an id.
    """
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = wanted.select("id").distinct()
    texts = own.join(small_side(ids.filter("id IS NOT NULL")), "id", "left_semi")
    if not ids.filter("id IS NULL").isEmpty():
        texts = texts.union(own.filter("id IS NULL"))  # not a join by key: all of them would be dealt to one task

    def begin():
        hashes = WordHashes()

        def full(texts: list[str | None]) -> list[list]:
            sets = [shingle_set(t, width, hashes) for t in texts]
            return [[_sid(s) for s in sets], [s.tobytes() for s in sets]]

        return full

    found = map_texts(texts, "text", [], {"sid": ("binary", pa.binary()), "shingles": ("binary", pa.binary())}, begin)
    # A repeated id may bring texts of other classes, or one class more than once.
    return found.join(small_side(wanted.select("sid")), "sid", "left_semi").dropDuplicates(["sid"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are linked."""
    first = pairs.join(sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x")), "a")
    both = first.join(sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):  # views of the batch, no copies
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(bool(linked(common, len(x), len(y), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows of equal keys, across batches; a block of BLOCK + BLOCK rows at most."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        change = np.flatnonzero((rows[keys] != rows[keys].shift()).any(axis=1).to_numpy())
        for a, b in zip(change, change[1:]):
            yield rows.iloc[a:b]
        held = rows.iloc[change[-1] :] if len(change) else None
    if held is not None and len(held):
        yield held


KEYS = ["key", "lb", "mb"]


def _blocks(members: DataFrame) -> DataFrame:
    """Pair up blocks of a band's left-over classes with blocks of all its classes.

    members: (key, size, left, sid, comp, is_left), of bands with several
    components.  Rows come out once for each block on the other side.
    """
    cut = lambda n: F.ceil(F.col(n) / F.lit(BLOCK)).cast("int")
    at = lambda n: F.pmod(F.xxhash64("sid"), cut(n)).cast("int")
    names = ["key", "sid", "comp"]
    every = members.select(*names, F.lit(False).alias("role"), F.explode(F.sequence(F.lit(0), cut("left") - 1)).alias("lb"), at("size").alias("mb"))
    left = members.filter("is_left").select(*names, F.lit(True).alias("role"), at("left").alias("lb"), F.explode(F.sequence(F.lit(0), cut("size") - 1)).alias("mb"))
    return every.union(left)


def _promising(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a block that are in some pair of different components, whose sketches agree enough and first meet here."""
    held = []
    for rows in _groups(batches, KEYS):
        role = rows["role"].to_numpy(bool)
        if not role.any():
            continue
        sk = np.frombuffer(b"".join(rows["sketch"]), "<u2").reshape(len(rows), -1)
        comp, sid = rows["comp"].to_numpy(object), rows["sid"].to_numpy(object)
        band = int(rows["band"].iloc[0])
        mine, others = np.flatnonzero(role), np.flatnonzero(~role)
        use = np.zeros(len(rows), bool)
        other = sk[others].reshape(len(others), BANDS, PER_BAND)
        for i in mine:
            same = other == sk[i].reshape(BANDS, PER_BAND)
            near = (same.sum((1, 2)) >= LEAST_AGREEING) & (same.all(2).argmax(1) == band) & (comp[others] != comp[i])
            if near.any():
                use[i] = True
                use[others[near]] = True
        if use.any():
            held.append(rows.loc[use, [*KEYS, "role", "sid", "comp"]])
        if len(held) >= 200:
            yield pd.concat(held)
            held = []
    if held:
        yield pd.concat(held)


def _compare(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """Links between the two sides of each block, by the full sets: matching shingles are counted per pair."""
    for rows in _groups(batches, KEYS):
        left, right = rows[rows["role"]], rows[~rows["role"]]
        if not len(left) or not len(right):
            continue
        a = [np.frombuffer(s, np.uint64) for s in left["shingles"]]
        b = [np.frombuffer(s, np.uint64) for s in right["shingles"]]
        na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        items, owner = np.concatenate(b), np.repeat(np.arange(len(b)), nb)
        order = np.argsort(items, kind="stable")
        items, owner = items[order], owner[order]
        common = np.zeros((len(a), len(b)), np.int64)
        for i, x in enumerate(a):
            low, high = np.searchsorted(items, x, "left"), np.searchsorted(items, x, "right")
            n = high - low
            at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            common[i] = np.bincount(owner[at], minlength=len(b))
        ca, cb = left["comp"].to_numpy(object), right["comp"].to_numpy(object)
        ok = linked(common, na[:, None], nb[None, :], percent) & (ca[:, None] != cb[None, :])
        # One link between two components is enough: they are then one.
        seen, out = set(), []
        for i, j in zip(*np.nonzero(ok)):
            if (pair := (ca[i], cb[j])) not in seen:
                seen.add(pair)
                out.append((left["sid"].iloc[i], right["sid"].iloc[j]))
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row.

    component_id is the smallest id that the row reaches over links, its own
    included; kept is whether that is its own.  Rows with null or blank texts
    have no shingles and link with nothing.  A null id is linked as any other,
    never kept, and its component is the least id that isn't null, or null.
    Rows that repeat an id are rows of their own and may all be kept.
    `percent` below 75 needs other BANDS.
    """
    rows = written(sketches(df, id_col, text_col, width), "sketches")
    classes = rows.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("id").alias("id"), F.max("sketch").alias("sketch"))
    classes = written(classes, "classes")
    step = 2 * PER_BAND
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sketch", b * step + 1, F.lit(step))))
    entries = classes.select("sid", F.posexplode(keys).alias("band", "key"))
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = written(entries.join(sizes, "key"), "bands")
    degree = met.groupBy("sid").agg(F.sum("size").alias("degree"))
    hubs = met.join(degree, "sid").groupBy("key").agg(F.max(F.struct("degree", "sid")).alias("hub")).select("key", F.col("hub.sid").alias("hub"))
    bands, met = met, written(met.join(hubs, "key"), "hubs")
    removed(bands)
    wanted = met.select("sid").distinct().join(classes.select("sid", "id"), "sid")
    sets = written(shingle_sets_of(df, wanted, id_col, text_col, width), "sets")
    stars = met.filter("sid <> hub").select(F.col("sid").alias("a"), F.col("hub").alias("b")).distinct()
    links = written(verified(stars, sets, percent), "links")
    component = written(connected_components(links), "components")

    own = component.select(F.col("node").alias("sid"), F.col("component").alias("comp"))
    of_hub = own.select(F.col("sid").alias("hub"), F.col("comp").alias("hub_comp"))
    placed = met.filter("size > 2").join(own, "sid", "left").join(of_hub, "hub", "left")
    placed = placed.select("key", "band", "size", "sid", "hub", F.coalesce("comp", "sid").alias("comp"), F.coalesce("hub_comp", "hub").alias("hub_comp"))
    placed = written(placed.withColumn("is_left", F.expr("comp <> hub_comp")), "placed")
    mixed = placed.filter("is_left").groupBy("key").agg(F.count(F.lit(1)).alias("left"))
    blocks = _blocks(placed.filter("sid <> hub").join(mixed, "key"))
    full = blocks.join(placed.select("key", "band").distinct(), "key").join(classes.select("sid", "sketch"), "sid")
    dealt = full.repartition(*KEYS).sortWithinPartitions(*KEYS)
    near = written(dealt.mapInPandas(_promising, "key long, lb int, mb int, role boolean, sid binary, comp binary"), "promising")
    with_sets = near.join(sets, "sid").repartition(*KEYS).sortWithinPartitions(*KEYS)
    more = with_sets.mapInPandas(lambda it: _compare(it, percent), "a binary, b binary")
    more = written(more, "more-links")
    if not more.isEmpty():
        removed(component)
        component = written(connected_components(links.union(more)), "components")
    removed(met, sets, links, placed, near, more)

    # Components and ids meet by class; a class that is linked with none is its own.
    by_class = classes.select("sid", "id").join(component, F.col("sid") == F.col("node"), "left").select("sid", "id", F.coalesce("component", "sid").alias("comp"))
    least = by_class.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = by_class.join(least, "comp").select("sid", "component_id")
    # Most classes are one document: only the others have to be looked up.
    out = rows.select("id", "n_shingles", "sid").join(named, "sid", "left")
    out = out.select("id", "n_shingles", F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents; see the contract's columns."""
    return near_duplicates(spread(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")
