"""Byte-exact removal of repeated passages by bucket-pointer refinement.

A passage is a string of `LENGTH` bytes that starts at two places or more.
All windows of that length in all texts are sorted into equal ones as a
suffix array would, but only as deep as LENGTH and only where repeats can be:

1. Initial buckets.  Every window has one anchor, its least hashed q-gram
   (the first of equal ones), which depends on the window's bytes alone, so
   equal windows have equal anchors at equal offsets.  Runs of windows with
   the same anchor are kept together as slices.  An anchor that occurs at one
   place only has no repeats: nothing of it is looked at again.
2. Slices whose whole content occurs twice are repeats throughout.
3. The other slices of shared anchors meet, by anchor, in tasks, where
   bucket-pointer refinement sorts them: buckets of short q-grams are refined
   by the pair of a position's own bucket and the bucket that its later offset
   points to, and the refined buckets are used for the next, twice as deep
   round, until windows of LENGTH bytes are told apart.

The same is done on words for passages that documents share: each word is a
symbol of four bytes, and a passage has to be in two texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, removed, small_side, spread, table, written
from .shingles import mix64, words

LENGTH, GRAM = 400, 32
#: Words of a passage, and bytes of the symbol that stands for a word.
PASSAGE, SYMBOL = 50, 4
#: Bytes that one refinement holds: positions and buckets then fit three times into 63 bits.
BATCH = 1 << 21
_POSITION = (1 << 24) - 1


class Unit(NamedTuple):
    """What passages are made of: bytes, or words of SYMBOL bytes each.  Places and lengths are in units."""

    encode: Callable[[str], bytes]
    length: int
    width: int  # bytes of a unit
    across: bool  # whether a passage has to be in two texts
    least_bytes: int  # of a text that may hold a passage

    @property
    def most_slices(self) -> int:
        """Distinct slices of an anchor that fit one refinement, however long."""
        return BATCH // (2 * self.length * self.width) - 100


def utf8(text: str) -> bytes:
    """The bytes of a text."""
    return text.encode("utf-8", "surrogatepass")


def word_symbols(text: str) -> bytes:
    """A hash of SYMBOL bytes for each word of a text, lower-cased."""
    found = words(text)
    return np.fromiter((xxhash.xxh32_intdigest(w) for w in found), "<u4", len(found)).tobytes()


BYTES = Unit(utf8, LENGTH, 1, False, LENGTH)
WORDS = Unit(word_symbols, PASSAGE, SYMBOL, True, 2 * PASSAGE - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings of a byte array, in place order."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    w = np.lib.stride_tricks.as_strided(data[:-7].view(np.uint8), (len(data) - 7, 8), (1, 1)).copy().view(np.uint64).ravel()
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    for k, m in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (24, 0x27D4EB2F165667C5)):
        h = (h ^ (h >> np.uint64(29))) + w[k : k + n] * np.uint64(m)
    return mix64(h)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by prefix and suffix minima of blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def slices(texts: list[bytes], unit: Unit = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, text, start, windows) of the slices of a batch of texts, 16 MB in all at most."""
    lens = np.array([len(t) // unit.width for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.empty(0, np.int64)
    if len(data) < unit.length * unit.width:
        return none, none, none, none
    h = gram_hashes(data)[:: unit.width]
    placed = (h & ~np.uint64(_POSITION)) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_least(placed, unit.length - GRAM // unit.width + 1) & np.uint64(_POSITION)).astype(np.int64)
    ends = np.cumsum(lens)
    owner = np.repeat(np.arange(len(texts)), lens)[: len(at)]
    inside = np.arange(len(at)) + unit.length <= ends[owner]
    first = inside.copy()
    first[1:] &= (at[1:] != at[:-1]) | ~inside[:-1] | (owner[1:] != owner[:-1])
    start = np.flatnonzero(first)
    count = np.add.reduceat(inside.astype(np.int64), start) if len(start) else none
    return h[at[start]].view(np.int64), owner[start], start - (ends - lens)[owner[start]], count


def _segments(text: bytes, unit: Unit, most: int = 8 << 20) -> Iterator[tuple[int, bytes]]:
    """A very long text in parts that overlap so that every window is in one part exactly."""
    more = (unit.length - 1) * unit.width
    for a in range(0, max(1, len(text) - more), most):
        yield a // unit.width, text[a : a + most + more]


def _bytes_of(data: bytes, start: int, windows: int, unit: Unit) -> bytes:
    return data[start * unit.width : (start + windows + unit.length - 1) * unit.width]


def _emit_slices(batches: Iterator[pd.DataFrame], unit: Unit) -> Iterator[pd.DataFrame]:
    def flush(held):
        anchor, owner, start, count = slices([t for *_, t in held], unit)
        offset = np.array([a for *_, a, _ in held], np.int64)
        content = [xxhash.xxh3_128_digest(_bytes_of(held[o][3], s, n, unit)) for o, s, n in zip(owner.tolist(), start.tolist(), count.tolist())]
        keys = [np.array([x[k] for x in held], np.int64)[owner] for k in (0, 1)]
        return pd.DataFrame({"anchor": anchor, "t1": keys[0], "t2": keys[1], "start": start + offset[owner], "windows": count, "content": content})

    for batch in batches:
        held, size = [], 0
        for t1, t2, text in zip(batch["t1"], batch["t2"], batch["text"]):
            for a, part in _segments(unit.encode(text), unit):
                if len(part) >= unit.length * unit.width:
                    held.append((t1, t2, a, part))
                    size += len(part)
                if size > 1 << 20:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)


def refine(data: np.ndarray, windows: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket number of every window (a start position in `data`); equal numbers mean equal strings of `length` units.

    Buckets of two bytes, or of one word's symbol, are the start.  A round of depth m sorts
    positions by their bucket and the bucket at offset m, both of depth m,
    which are the updated buckets of the round before, and so doubles the
    depth.  A position alone in its bucket is apart from all others at any
    depth: it is sorted no more, and keeps a number of its own.  A position of
    each round needs fewer than 2 ** 21 units of data.
    """
    n = len(data)
    bits, low = np.uint64(21), np.uint64((1 << 21) - 1)
    if n > 1 << 21:
        raise ValueError("more than 2 ** 21 units in one refinement")
    bucket = np.zeros(n + length + 1, np.uint64)
    if data.dtype == np.uint8:
        bucket[:n] = data
        bucket[: n - 1] = bucket[: n - 1] * np.uint64(256) + bucket[1:n]
        depth = 2
    else:
        bucket[:n] = np.unique(data, return_inverse=True)[1]
        depth = 1
    active = np.arange(n, dtype=np.uint64)
    while depth < length and len(active):
        step = min(depth, length - depth)
        where = active.astype(np.int64)
        packed = (bucket[where] << (bits + bits)) | (bucket[where + step] << bits) | active
        packed.sort()
        pair, place = packed >> bits, (packed & low).astype(np.int64)
        new = np.empty(len(pair), bool)
        new[:1] = True
        np.not_equal(pair[1:], pair[:-1], out=new[1:])
        number = np.cumsum(new) - 1
        # Numbers of settled positions stay apart: each bucket is named by its first member's place.
        names = place[new][number].astype(np.uint64)
        bucket[place] = names
        depth += step
        if depth < length:
            counts = np.bincount(number)
            # A settled position may still be what a later offset of another points to: it keeps its own name.
            active = np.sort(place[counts[number] > 1]).astype(np.uint64)
    return bucket[windows]


def _runs(flags: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of flags, within the windows of one row each."""
    same = row[1:] == row[:-1]
    before, after = np.zeros(len(flags), bool), np.zeros(len(flags), bool)
    before[1:], after[:-1] = flags[:-1] & same, flags[1:] & same
    return np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after)


def _repeated(batches: Iterator[pd.DataFrame], unit: Unit) -> Iterator[pd.DataFrame]:
    """Runs of repeated windows among slices that come sorted by anchor; whole anchors go into one refinement."""

    def flush(rows: pd.DataFrame) -> pd.DataFrame:
        counts = rows["windows"].to_numpy()
        lens = rows["bytes"].map(len).to_numpy() // unit.width
        begin = np.cumsum(lens) - lens
        owner = np.repeat(np.arange(len(rows)), counts)
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        data = np.frombuffer(b"".join(rows["bytes"]), np.uint8 if unit.width == 1 else "<u4")
        number = refine(data, begin[owner] + inner, unit.length).astype(np.int64)
        single = rows["single"].to_numpy(bool)
        if unit.across:
            # Of a bucket's windows those of one text count once, those of slices that two texts have count as two.
            text = rows.groupby(["t1", "t2"]).ngroup().to_numpy()
            pairs = np.unique(np.stack([number, np.where(single, text, -1)[owner]]), axis=1)
            twice = np.bincount(pairs[0], np.where(pairs[1] < 0, 2, 1), len(number) and number.max() + 1)[number] > 1
        else:
            twice = np.bincount(number)[number] > 1
        first, last = _runs(twice & single[owner], owner)
        of, start = owner[first], rows["start"].to_numpy()
        return pd.DataFrame({"t1": rows["t1"].to_numpy()[of], "t2": rows["t2"].to_numpy()[of], "a": start[of] + inner[first], "b": start[of] + inner[last] + 1}).astype("int64")

    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        sizes = rows["bytes"].map(len).to_numpy()
        last = (rows["anchor"] != rows["anchor"].shift(-1)).to_numpy()
        last[-1:] = False
        total, begin, done = 0, 0, 0
        for end in np.flatnonzero(last) + 1:
            more = int(sizes[done:end].sum())
            if total + more > BATCH and done > begin:
                yield flush(rows.iloc[begin:done])
                begin, total = done, 0
            total, done = total + more, end
        if total > BATCH // 2:
            yield flush(rows.iloc[begin:done])
            begin = done
        held = rows.iloc[begin:]
    if held is not None and len(held):
        sizes, begin, total, done = held["bytes"].map(len).to_numpy(), 0, 0, 0
        for end in np.flatnonzero((held["anchor"] != held["anchor"].shift(-1)).to_numpy()) + 1:
            more = int(sizes[done:end].sum())
            if total + more > BATCH and done > begin:
                yield flush(held.iloc[begin:done])
                begin, total = done, 0
            total, done = total + more, end
        yield flush(held.iloc[begin:done])


def named_buckets(data: np.ndarray, unit: Unit) -> np.ndarray:
    """Two 64-bit identifiers of the bucket of every window of some bytes.

    The rounds are those of refine(): buckets of q-grams first, then the pair
    of a position's own bucket and the bucket at a later offset, both as the
    round before left them.  The new bucket's identifier is a hash of the pair,
    so that buckets in different tasks have the same one and Spark can group
    them; sorting in a task gives numbers that hold there alone.
    """
    first = gram_hashes(data)[:: unit.width]
    bucket = np.stack([first, mix64(first ^ np.uint64(0x27D4EB2F165667C5))])
    depth = GRAM // unit.width
    while depth < unit.length:
        step = min(depth, unit.length - depth)
        n = bucket.shape[1] - step
        for lane, m in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
            bucket[lane, :n] = mix64(bucket[lane, :n] * np.uint64(m) + bucket[lane, step:])
        bucket, depth = bucket[:, :n], depth + step
    return bucket.view(np.int64)


def _window_names(batches: Iterator[pd.DataFrame], unit: Unit) -> Iterator[pd.DataFrame]:
    """Bucket identifiers of the windows of slices whose anchors have more of them than fit one refinement."""
    for batch in batches:
        for at in range(0, len(batch), 200):
            rows = batch.iloc[at : at + 200]
            found = [named_buckets(np.frombuffer(p, np.uint8), unit)[:, :n] for p, n in zip(rows["bytes"], rows["windows"])]
            counts = rows["windows"].to_numpy()
            inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            out = {c: np.repeat(rows[c].to_numpy(), counts) for c in ("t1", "t2", "single")}
            both = np.concatenate(found, axis=1)
            yield pd.DataFrame({"b1": both[0], "b2": both[1], **out, "at": np.repeat(rows["start"].to_numpy(), counts) + inner})


def _cut(batches: Iterator[pd.DataFrame], unit: Unit) -> Iterator[pd.DataFrame]:
    """The bytes of each wanted slice of a text."""
    for batch in batches:
        rows, size = [], 0
        for text, wanted, t1, t2 in zip(batch["text"], batch["wanted"], batch["t1"], batch["t2"]):
            data = unit.encode(text)
            for x in wanted:
                rows.append((x["anchor"], t1, t2, x["start"], x["windows"], x["single"], x["crowded"], _bytes_of(data, x["start"], x["windows"], unit)))
                size += (x["windows"] + unit.length) * unit.width
            if size > 8 << 20:
                yield pd.DataFrame(rows, columns=_CUT)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=_CUT)


_CUT = ["anchor", "t1", "t2", "start", "windows", "single", "crowded", "bytes"]


def keyed(df: DataFrame, text_col: str) -> DataFrame:
    """The rows with a 128-bit key of their text, null as empty, in t1 and t2."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn("text", text).withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(1), "text"))


def equal_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(t1, t2, size) of the texts that several rows have, with their bytes."""
    copies = keyed(df.select(text_col), text_col).groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("size"))
    return written(copies.filter("n > 1").select("t1", "t2", F.col("size").cast("long").alias("size")), "copies")


def repeated_spans(df: DataFrame, text_col: str = "text", unit: Unit = BYTES, copies: DataFrame | None = None) -> DataFrame:
    """(t1, t2, spans) of every distinct text with a passage that repeats; spans are disjoint (start, end), in order.

    Starts and ends are in units.  `copies` are equal_texts(), whole
    spans of which are added; without, texts that are repeated only by equal
    ones have none.
    """
    texts = keyed(df.select(text_col), text_col).select("t1", "t2", "text")
    emit = lambda it: _emit_slices(it, unit)
    places = texts.filter(F.octet_length("text") >= unit.least_bytes).mapInPandas(emit, "anchor long, t1 long, t2 long, start int, windows int, content binary")
    place = F.xxhash64("t1", "t2") if unit.across else F.xxhash64("t1", "t2", "start")
    found = written(places.withColumn("place", place), "slices")
    # A copy's slices are at the same places of the same text: equal texts count once here.
    apart = lambda key: found.groupBy(key).agg(F.min("place").alias("x"), F.max("place").alias("y")).filter("x <> y").select(key)
    anchors = written(apart("anchor"), "anchors")
    shared = written(found.join(small_side(anchors), "anchor", "left_semi").distinct(), "shared")
    removed(found, anchors)
    ends = (F.min("place").alias("x"), F.max("place").alias("y"))
    if unit.across:  # a slice of one text only has all its places there looked at, one of several texts is found already
        in_text = shared.groupBy("anchor", "content", "t1", "t2", "place").agg(F.sort_array(F.collect_list(F.struct("start", "windows"))).alias("own"))
        kinds = in_text.groupBy("anchor", "content").agg(*ends, F.min(F.struct("t1", "t2", "own")).alias("r"))
        kinds = kinds.select("anchor", "content", "r.t1", "r.t2", F.expr("x = y").alias("single"), F.expr("inline(if(x = y, r.own, slice(r.own, 1, 1)))"))
    else:
        kinds = shared.groupBy("anchor", "content").agg(*ends, F.min(F.struct("t1", "t2", "start", "windows")).alias("r"))
        kinds = kinds.select("anchor", "content", "r.*", F.expr("x = y").alias("single"))
    kinds = written(kinds, "kinds")
    whole = shared.join(kinds.filter("NOT single").select("anchor", "content"), ["anchor", "content"], "left_semi").select("t1", "t2", F.col("start").cast("long").alias("a"), (F.col("start") + F.col("windows")).cast("long").alias("b"))

    open_ = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("single").alias("any")).filter("n > 1 AND any").select("anchor", F.expr(f"n > {unit.most_slices}").alias("crowded"))
    wanted = kinds.join(open_, "anchor").groupBy("t1", "t2").agg(F.collect_list(F.struct("anchor", "start", "windows", "single", "crowded")).alias("wanted"))
    wanted = written(wanted, "wanted")
    one = texts.join(small_side(wanted.select("t1").distinct()), "t1", "left_semi").dropDuplicates(["t1", "t2"])
    cut = one.join(wanted, ["t1", "t2"]).mapInPandas(lambda it: _cut(it, unit), "anchor long, t1 long, t2 long, start int, windows int, single boolean, crowded boolean, bytes binary")
    cut = written(cut, "cut")
    sorted_ = cut.filter("NOT crowded").repartition("anchor").sortWithinPartitions("anchor")
    part = sorted_.mapInPandas(lambda it: _repeated(it, unit), "t1 long, t2 long, a long, b long")
    spans = whole.union(part)
    crowd = cut.filter("crowded")
    if not crowd.isEmpty():
        names = written(crowd.mapInPandas(lambda it: _window_names(it, unit), "b1 long, b2 long, t1 long, t2 long, single boolean, at int"), "windows")
        text = F.xxhash64("t1", "t2")
        twice = (F.min(text) != F.max(text)) | ~F.min("single") if unit.across else F.count(F.lit(1)) > 1
        twice = names.groupBy("b1", "b2").agg(twice.alias("twice")).filter("twice")
        spans = spans.union(names.filter("single").join(twice, ["b1", "b2"], "left_semi").select("t1", "t2", F.col("at").cast("long"), (F.col("at") + 1).cast("long")))
    if copies is not None:
        spans = spans.union(copies.filter(F.col("size") >= unit.length).select("t1", "t2", F.lit(0).cast("long"), F.col("size") - (unit.length - 1)))
    by_text = spans.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("w"))
    # Window starts [a, b) cover units [a, b + length - 1); touching stretches are one.
    spans = written(by_text.mapInPandas(lambda it: _merge(it, unit.length), "t1 long, t2 long, spans array<struct<s:long,e:long>>"), "spans")
    removed(shared, kinds, wanted, cut)
    return spans


def _merge(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for windows in batch["w"]:
            spans: list[list[int]] = []
            for x in windows:
                a, b = x["a"], x["b"] + length - 1
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            out.append([{"s": a, "e": b} for a, b in spans])
        yield batch[["t1", "t2"]].assign(spans=pd.Series(out, index=batch.index, dtype=object))


def shared_words(df: DataFrame, copies: DataFrame, text_col: str = "text") -> DataFrame:
    """(t1, t2, n_shared, whole): how many words of a text are in passages of PASSAGE words that another text has too.

    One row for each distinct text that has such words or, as `whole` says, is
    itself another row's text.
    """
    spans = repeated_spans(df, text_col, WORDS)
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    both = spans.select("t1", "t2", covered.alias("n"), F.lit(False).alias("w")).union(copies.select("t1", "t2", F.lit(0).cast("long"), F.lit(True)))
    return written(both.groupBy("t1", "t2").agg(F.max("n").alias("n_shared"), F.max("w").alias("whole")), "shared-words")


def _limited(spans: DataFrame, weight) -> DataFrame:
    """Marked for broadcast if its weight, a Column that adds up, is at most 2,000,000; else left to be dealt by key."""
    return F.broadcast(spans) if (spans.agg(F.sum(weight)).first()[0] or 0) <= 2_000_000 else spans


def remove_repeats(df: DataFrame, keep: list[str] | None = None, text_col: str = "text", with_bytes: bool = False, with_words: bool = False) -> DataFrame:
    """Columns `keep` (default doc_id), n_bytes, n_removed, n_spans, kept_sha256 and, on request, kept (binary) and n_shared_words.

    One row per input row.  Null and empty texts have no bytes; texts shorter
    than LENGTH keep all of theirs.  Rows with equal texts are each other's
    repeats, so all of them lose all bytes, the first one too.
    n_shared_words counts the words in passages of PASSAGE words that another
    row has too, wherever they stand; it takes no part in what is removed.  A
    kept column with the name of a new one gives way.
    """
    new = {"n_bytes": ("long", pa.int64()), "n_removed": ("long", pa.int64()), "n_spans": ("long", pa.int64()), "kept_sha256": ("string", pa.string())} | ({"kept": ("binary", pa.binary())} if with_bytes else {})
    new |= {"n_shared_words": ("long", pa.int64())} if with_words else {}
    keep = [c for c in keep or ["doc_id"] if c not in new]
    copies = equal_texts(df, text_col)
    rows = keyed(df.select(F.struct(*keep).alias("own"), F.col(text_col).alias("text")), "text")
    rows = rows.join(_limited(repeated_spans(df, text_col, BYTES, copies), F.size("spans")), ["t1", "t2"], "left")
    if with_words:
        rows = rows.join(_limited(shared_words(df, copies, text_col), F.lit(1)), ["t1", "t2"], "left")
    else:
        rows = rows.withColumns({"n_shared": F.lit(0).cast("long"), "whole": F.lit(False)})
    rows = rows.select("own", F.struct("text", "spans", "n_shared", "whole").alias("both"))

    def cut(both: list[dict]) -> list[list]:
        out = []
        for row in both:
            data = utf8(row["text"])
            taken, at, parts, sha = 0, 0, [], hashlib.sha256()
            for x in row["spans"] or ():
                parts.append(data[at : x["s"]])
                taken, at = taken + x["e"] - x["s"], x["e"]
            parts.append(data[at:])
            for p in parts:
                sha.update(p)
            found = [len(data), taken, len(row["spans"] or ()), sha.hexdigest()]
            if with_bytes:
                found.append(b"".join(parts))
            if with_words:
                every = len(words(row["text"])) if row["whole"] else 0
                found.append(every if every >= PASSAGE else row["n_shared"] or 0)
            out.append(found)
        return [list(x) for x in zip(*out)] if out else [[] for _ in new]

    return map_texts(rows, "both", ["own"], new, lambda: cut).select("own.*", *new)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Remove passages of 400 bytes that occur twice in all documents; see the contract's columns.

    n_shared_words follows them: words in passages of 50 words that another
    document has too, of which short ones may have fewer than 400 bytes.
    """
    return remove_repeats(spread(table(spark, sf_dir, "documents")), with_words=True)
