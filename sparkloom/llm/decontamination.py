"""Benchmark decontamination by pigeonhole edit matching on words.

A test item of m words may differ in k words (inserted, left out or changed)
and still count as leaked.  Cut into k + 1 pieces, at least one piece is then
intact in the document: exact piece hits find the places to look at, and
Myers' bit-parallel algorithm gives the word edit distance of the best match
there.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField

from .common import map_texts, removed, spread, table, written
from .shingles import _MUL, mix64

_WORD = re.compile(r"[^\W_]+")
ERRORS = 0.1  # error budget as a share of the item's words
BLOCK_BYTES = 8 << 20  # text of the items that are broadcast at once


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits of a whole text; none for null."""
    return _WORD.findall((text or "").lower())


def budget(n: int, share: float = ERRORS) -> int:
    """Errors allowed for an item of n words."""
    return int(n * share)


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """k + 1 pieces of n words as (start, length), as equal as can be."""
    cuts = [i * n // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: list[str], text: list[str], anchored: bool = False) -> tuple[int, int]:
    """(distance, end) of the pattern's best match anywhere in the text, the first of the best; words are symbols.

    An anchored match starts with the text's first word.  The column of
    differences is two bit vectors as long as the pattern, so a text word costs
    a few whole-number operations.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    at: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        at[w] |= 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, w in enumerate(text):
        eq = at.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (~(xh | up) & full)
        mh = up & xh
        score += bool(ph & last) - bool(mh & last)
        ph = (ph << 1 | anchored) & full
        mh = (mh << 1) & full
        up = mh | (~(xv | ph) & full)
        down = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """Items of one block, found by hashes of their pieces."""

    def __init__(self, items: list[tuple[int, list[str]]], share: float = ERRORS):
        self.items, self.share = items, share
        self.by_length: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for i, (_, own) in enumerate(items):
            h = self._hash(own)
            for start, length in pieces(len(own), budget(len(own), share)):
                *_, (_, key) = self._growing(h[start : start + length], length)
                self.by_length[length][int(key[0])].append((i, start))
        self.sorted = {n: np.array(sorted(found), np.uint64) for n, found in self.by_length.items()}

    @staticmethod
    def _hash(own: list[str], known: dict[str, int] | None = None) -> np.ndarray:
        known = {} if known is None else known
        for w in own:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
        return np.fromiter(map(known.__getitem__, own), np.uint64, len(own))

    @staticmethod
    def _growing(h: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
        """(length, hash of every run of that many words) for 1 to `most`; each is the one before and a word more."""
        acc = np.zeros(len(h), np.uint64)
        for k in range(min(most, len(h))):
            acc = mix64(acc[: len(h) - k] * _MUL + h[k:])
            yield k + 1, acc

    def find(self, text: str | None, known: dict[str, int]) -> list[tuple[int, int, int, int]]:
        """(item, distance, first word, end) of every item within its budget somewhere in a whole text."""
        own = words(text)
        if len(known) > 40_000:
            known.clear()
        h = self._hash(own, known)
        looks: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for length, w in self._growing(h, max(self.sorted, default=0)):
            if (keys := self.sorted.get(length)) is None:
                continue
            spot = np.searchsorted(keys, w)
            spot[spot == len(keys)] = 0
            for p in np.flatnonzero(keys[spot] == w):
                for i, start in self.by_length[length][int(w[p])]:
                    n = len(self.items[i][1])
                    k = budget(n, self.share)
                    looks[i].append((max(0, int(p) - start - k), int(p) - start + n + k))
        out = []
        for i, spans in looks.items():
            item_id, item = self.items[i]
            best, high = None, -1
            joined: list[list[int]] = []
            for a, b in sorted(spans):
                if joined and a <= high:
                    joined[-1][1] = high = max(high, b)
                else:
                    joined.append([a, b])
                    high = b
            for a, b in joined:
                distance, end = myers(item, own[a:b])
                if distance <= budget(len(item), self.share) and (best is None or distance < best[1]):
                    # Read backwards from its end, the match shows where it starts: the latest start of equal distance.
                    back = own[max(0, a + end - len(item) - distance) : a + end][::-1]
                    best = (item_id, distance, a + end - myers(item[::-1], back, True)[1], a + end)
            if best:
                out.append(best)
        return out


def find_leaks(documents: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, share: float = ERRORS) -> DataFrame:
    """Columns `keep` (default doc_id) and `leaks`, the items found in each whole text, by item.

    Every document keeps its row; a null or empty text has no leaks.  A leak is
    (item_id, distance, start, end): the first of the places of least distance,
    in words of the text, end exclusive.  Items without words, and null items,
    match nothing; equal items are each reported.  A kept column called `leaks`
    gives way.  Items are broadcast in blocks of at most BLOCK_BYTES of text
    (one item more at most); with several, each block is a pass of its own whose
    rows are written, so a large benchmark needs more time and not more memory.
    """
    keep = [c for c in keep or ["doc_id"] if c.lower() != "leaks"]
    items = benchmark.select("item_id", "text").filter("text IS NOT NULL AND item_id IS NOT NULL")
    kind = benchmark.schema["item_id"]
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    used = [*dict.fromkeys([*keep, "text"])]
    frame, before = documents.select(*used), None
    for block in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).distinct().collect()
        own = sorted((r["item_id"], w) for r in some if (w := words(r["text"])))
        frame = _pass(frame, keep if block == blocks - 1 else used, kind, own, share)
        if blocks > 1:
            frame = written(frame, "leaks")
            if before is not None:
                removed(before)
            before = frame
    return frame


def _pass(frame: DataFrame, keep: list[str], kind: StructField, own: list[tuple], share: float) -> DataFrame:
    """The frame with the leaks of one block's items after those that it has."""
    items = frame.sparkSession.sparkContext.broadcast(own)
    hit = pa.struct([("item_id", to_arrow_type(kind.dataType)), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    new = {"__found": (f"array<struct<item_id:{kind.dataType.simpleString()},distance:int,start:int,end:int>>", pa.list_(hit))}

    def begin():
        matcher, known = Matcher(items.value, share), {}
        return lambda texts: [[[dict(zip(("item_id", "distance", "start", "end"), x)) for x in sorted(matcher.find(t, known))] for t in texts]]

    earlier = "leaks" in frame.columns
    found = map_texts(frame, "text", [*keep, "leaks"] if earlier else keep, new, begin)
    return found.select(*keep, (F.array_sort(F.concat("leaks", "__found")) if earlier else F.col("__found")).alias("leaks"))


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    """A row for each document that holds a benchmark item within its error budget, and each such item."""
    found = find_leaks(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    hit = found.select("doc_id", F.explode("leaks").alias("x"))
    return hit.select("doc_id", "x.item_id", "x.distance", F.col("x.start").alias("start_word"), F.col("x.end").alias("end_word"))
