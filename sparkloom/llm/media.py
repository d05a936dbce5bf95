"""Media columns: chroma fingerprints of audio, and alignment of recordings by them.

A recording (WAV bytes) becomes frames of energy per pitch class.  Sixteen
filters, each a difference of sums over rectangles of that image, taken from
its integral image, are quantised to two bits; a frame is the packed 32-bit
integer.  The recordings asked for are compared with all classes of equal
fingerprints, in blocks: correlations of the bits give the differing bits of
each pair at every offset, and the offset of the least share of them decides.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table, written

SIZE, HOP, SPAN = 1024, 256, 16  # samples of a frame, step between frames, frames that a fingerprint covers
LOW_HZ, HIGH_HZ = 100.0, 1900.0
MOST_ERRORS, LEAST_FRAMES = 0.2, 8
BLOCK_FRAMES = 20_000  # frames of a block of recordings, unless one alone has more
TILE = 1 << 20  # numbers of a block's correlations held at a time


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, height, width) of the sixteen filters, by rule: every kind at changing places and sizes."""
    return [(k % 4, (5 * k) % 12, 2 + 2 * (k % 3), SPAN >> (k % 3)) for k in range(16)]


def read_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples in -1 to 1 and the rate; no samples for null or what isn't PCM audio."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    except (wave.Error, EOFError):
        return np.empty(0), 0
    if width == 1:
        x = np.frombuffer(raw, np.uint8) / 128.0 - 1
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / float(1 << (8 * width - 1))
    return x[: len(x) // channels * channels].reshape(-1, channels).mean(1), rate


def chroma(x: np.ndarray, rate: int) -> np.ndarray:
    """Energy per pitch class of each frame, scaled to unit length; frames without sound are zero."""
    n = (len(x) - SIZE) // HOP + 1
    if n < 1:
        return np.empty((0, 12))
    hz = np.fft.rfftfreq(SIZE, 1 / rate)
    use = (hz >= LOW_HZ) & (hz <= HIGH_HZ)
    to = np.zeros((use.sum(), 12))
    to[np.arange(use.sum()), np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % 12] = 1
    shape = np.hanning(SIZE)
    out = np.empty((n, 12))
    for a in range(0, n, 4096):  # a long recording is cut into frames part by part
        part = np.lib.stride_tricks.sliding_window_view(x, SIZE)[a * HOP : min(n, a + 4096) * HOP : HOP][: min(n, a + 4096) - a]
        out[a : a + 4096] = (np.abs(np.fft.rfft(part * shape)[:, use]) ** 2) @ to
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(norm > 1e-6, out / np.maximum(norm, 1e-6), 0.0)


def fingerprint(data: bytes | None) -> np.ndarray:
    """Packed 32-bit integers of a recording, one per frame that has SPAN - 1 others after it."""
    image = chroma(*read_wav(data)) if data else np.empty((0, 12))
    n = len(image) - SPAN + 1
    if n < 1:
        return np.empty(0, np.int32)
    whole = np.zeros((len(image) + 1, 13))
    whole[1:, 1:] = image.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t, p, width, height):
        """Sum over a rectangle of the image."""
        return whole[at + t + width, p + height] - whole[at + t, p + height] - whole[at + t + width, p] + whole[at + t, p]

    packed = np.zeros(n, np.uint32)
    for kind, p, height, width in filters():
        p = min(p, 12 - height)
        half, mid = width // 2, height // 2
        all_ = area(0, p, width, height)
        if kind == 0:  # this band against the whole frame
            value = all_ / height - area(0, 0, width, 12) / 12
        elif kind == 1:  # high against low
            value = area(0, p + mid, width, height - mid) - area(0, p, width, mid)
        elif kind == 2:  # late against early
            value = area(half, p, width - half, height) - area(0, p, half, height)
        else:  # checked
            value = area(0, p, half, mid) + area(half, p + mid, width - half, height - mid) - area(half, p, width - half, mid) - area(0, p + mid, half, height - mid)
        limit = 0.02 * width * height
        level = (value > -limit).astype(np.uint32) + (value > 0) + (value > limit)
        packed = packed << np.uint32(2) | (level ^ (level >> np.uint32(1))).astype(np.uint32)  # Gray code
    return packed.view(np.int32)


def fingerprints(df: DataFrame, id_col: str, audio_col: str) -> DataFrame:
    """(id, frames array<int>) of every row; no frames for null, short or unreadable audio."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"].array, "frames": [fingerprint(b) for b in batch["audio"]]})

    return df.select(F.col(id_col).alias("id"), F.col(audio_col).alias("audio")).mapInPandas(run, f"id {kind}, frames array<int>")


def _spectra(rows: list[np.ndarray], size: int) -> np.ndarray:
    """(frequency, recording, bit): spectra of the bits as -1 and 1, with zeros after the end."""
    out = np.zeros((len(rows), size, 32), np.float32 if size <= 4096 else np.float64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = np.unpackbits(np.ascontiguousarray(r).view(np.uint8)).reshape(len(r), 32) * 2.0 - 1
    return np.fft.rfft(out, axis=1).transpose(1, 0, 2)


def best_offsets(queries: list[np.ndarray], classes: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, float]]:
    """(query, class, offset, votes, bit_errors) of every pair with an offset within MOST_ERRORS.

    All offsets with LEAST_FRAMES in common are compared.  The one of the least
    bit_errors is given, of equal ones that with most frames in common, then
    the nearest to 0.  votes counts equal neighbouring pairs of integers there.
    """
    # Longest first, so that the first of a tile bounds what the others take.
    order_q, order_r = (np.argsort([-len(x) for x in side], kind="stable") for side in (queries, classes))
    a = 0
    while a < len(order_r):
        longest = len(classes[order_r[a]])
        own = order_r[a : a + max(1, min(128, TILE // (64 * longest)))]
        a += len(own)
        b, held, at_size = 0, None, 0
        while b < len(order_q):
            full = longest + len(queries[order_q[b]]) - 1
            full += -full % 16
            mine = order_q[b : b + max(1, min(128, TILE // (full * max(32, len(own)))))]
            b += len(mine)
            n, m = np.array([len(queries[i]) for i in mine]), np.array([len(classes[i]) for i in own])
            if full != at_size:
                held, at_size = _spectra([classes[i] for i in own], full).conj().transpose(0, 2, 1), full
            agree = np.fft.irfft(_spectra([queries[i] for i in mine], full) @ held, full, axis=0)
            offset = np.arange(LEAST_FRAMES - m.max(), n.max() - LEAST_FRAMES + 1)
            offset = offset[np.argsort(np.abs(offset), kind="stable")]
            agree = agree[offset]  # negative ones count from the end
            # Of n and m the lengths that occur, mostly one, decide what two recordings have in common.
            ns, ms = (x[:1] if (x == x[0]).all() else x for x in (n, m))
            o = offset[:, None, None]
            common = np.minimum(ns[:, None] - np.maximum(o, 0), ms - np.maximum(-o, 0))
            need = np.where(common >= LEAST_FRAMES, (1 - 2 * MOST_ERRORS) * 32 * common - 0.5, np.inf).astype(agree.dtype)
            for i, j in zip(*np.nonzero((agree >= need).any(0))):
                c = np.minimum(n[i] - np.maximum(offset, 0), m[j] - np.maximum(-offset, 0))
                share = np.where(c >= LEAST_FRAMES, (32 * c - np.rint(agree[:, i, j])) / 2 / (32.0 * np.maximum(c, 1)), np.inf)
                if share.min() > MOST_ERRORS:
                    continue
                k = np.where(share == share.min(), c, -1).argmax()
                x, y = queries[mine[i]][max(offset[k], 0) :][: c[k]], classes[own[j]][max(-offset[k], 0) :][: c[k]]
                same = x == y
                yield int(mine[i]), int(own[j]), int(offset[k]), int((same[1:] & same[:-1]).sum()), float(share[k])


def _packed(classes: DataFrame, names: tuple[str, str], parts: int) -> DataFrame:
    """Blocks of recordings: their ids, lengths and frames as bytes."""
    kind = classes.schema["class_id"].dataType.simpleString()
    columns = [names[0], f"{names[1]}_sizes", f"{names[1]}_bytes"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch["frames"].map(len).to_numpy()
            block = np.cumsum(size) // BLOCK_FRAMES
            for k in np.unique(block):
                part = batch[block == k]
                yield pd.DataFrame([(part["class_id"].tolist(), size[block == k].tolist(), np.concatenate(part["frames"].tolist()).astype("<i4").tobytes())], columns=columns)

    return classes.select("class_id", "frames").repartition(parts, "class_id").mapInPandas(run, f"{columns[0]} array<{kind}>, {columns[1]} array<int>, {columns[2]} binary")


def _unpacked(sizes, data: bytes) -> list[np.ndarray]:
    return np.split(np.frombuffer(data, "<i4"), np.cumsum(sizes)[:-1])


def align(prints: DataFrame, is_query) -> DataFrame:
    """(id, class_id, n_frames, matches): one row per recording.

    Recordings with equal fingerprints are one class, named by its least id.
    `matches` is null unless is_query (a Column over `id`) holds; then it has
    each class within MOST_ERRORS at some offset with LEAST_FRAMES in common,
    the query's own class too: (class_id, offset, votes, bit_errors) at the
    offset of the least bit_errors, by class.  Recordings too short for
    LEAST_FRAMES match nothing.  Nothing is passed over: every query class is
    compared with every class at every offset, in blocks, so the time grows
    with the number of those pairs; what is emitted are the matches.
    """
    named = prints.withColumn("fp", F.md5(F.concat_ws(",", F.transform("frames", lambda x: x.cast("string")))))
    named = written(named, "prints")
    classes = named.groupBy("fp").agg(F.min("id").alias("class_id"), F.max(F.coalesce(is_query, F.lit(False))).alias("asked"))
    # Equal rows have equal frames, of which any will do; sizes stay those of one recording.
    frames = named.dropDuplicates(["fp"]).select("fp", "frames")
    classes = written(classes.join(frames, "fp"), "classes").filter("class_id IS NOT NULL")
    long_ = classes.filter(F.size("frames") >= LEAST_FRAMES)
    total = long_.agg(F.coalesce(F.sum(F.size("frames")), F.lit(0)), F.coalesce(F.sum(F.when(F.col("asked"), F.size("frames"))), F.lit(0))).first()
    parts = [1 + n // BLOCK_FRAMES for n in total]
    mine = _packed(long_.filter("asked"), ("q", "q"), parts[1])
    pairs = mine.crossJoin(_packed(long_, ("class_id", "r"), parts[0]))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                queries, others = _unpacked(row.q_sizes, row.q_bytes), _unpacked(row.r_sizes, row.r_bytes)
                found = [(row.q[i], row.class_id[j], *rest) for i, j, *rest in best_offsets(queries, others)]
                yield pd.DataFrame(found, columns=["q", "class_id", "offset", "votes", "bit_errors"])

    kind = long_.schema["class_id"].dataType.simpleString()
    hits = pairs.mapInPandas(compare, f"q {kind}, class_id {kind}, offset int, votes long, bit_errors double")
    found = hits.groupBy(F.col("q").alias("class_id")).agg(F.sort_array(F.collect_list(F.struct("class_id", "offset", "votes", F.round("bit_errors", 6).alias("bit_errors")))).alias("matches"))
    known = classes.select("fp", "class_id").join(found, "class_id", "left")
    none = F.array().cast("array<struct<class_id:bigint,offset:int,votes:bigint,bit_errors:double>>")
    rows = named.select("id", "fp", F.size("frames").alias("n_frames")).join(known, "fp", "left")
    return rows.select("id", "class_id", "n_frames", F.when(F.coalesce(is_query, F.lit(False)), F.coalesce("matches", none)).alias("matches"))


def render(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", rate: int = 4000) -> DataFrame:
    """(id, audio): each vector as a WAV melody, a note for each of its numbers.

    The test tables have no media; this gives a media column whose recordings
    sound alike where vectors are alike.  Null vectors give null audio.
    """
    kind = df.schema[id_col].dataType.simpleString()
    t = np.arange(int(0.06 * rate)) / rate

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                audio = []
                for v in batch["v"].iloc[at : at + 200]:
                    if v is None:
                        audio.append(None)
                        continue
                    note = np.clip(np.round(np.nan_to_num(np.asarray(v, float)) * 40), -12, 12) + 12
                    hz = 220.0 * 2 ** (note / 12)
                    x = np.sin(2 * np.pi * hz[:, None] * t[None, :]).ravel()
                    out = io.BytesIO()
                    with wave.open(out, "wb") as w:
                        w.setnchannels(1)
                        w.setsampwidth(2)
                        w.setframerate(rate)
                        w.writeframes((x * 20000).astype("<i2").tobytes())
                    audio.append(out.getvalue())
                yield pd.DataFrame({"id": batch["id"].iloc[at : at + 200].array, "audio": audio})

    return df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInPandas(run, f"id {kind}, audio binary")


def op6_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint all recordings made of `embeddings` and align every one whose id is divisible by 100 with all."""
    prints = fingerprints(render(spread(table(spark, sf_dir, "embeddings"))), "id", "audio")
    return align(prints, F.col("id") % 100 == 0).withColumnRenamed("id", "vec_id")
