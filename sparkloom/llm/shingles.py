"""Word shingles and fast similarity sketches, vectorised over a batch of texts."""

from __future__ import annotations

import numpy as np
import xxhash

# Fixed by the contract: words are runs of anything but the bytes 0x20 and 0x09 to 0x0D,
# which are the ones that bytes.split() takes for white space; only A-Z are lower-cased.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_MUL = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit integers into well-spread ones (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, kept for the words met so far; emptied when it grows too large."""

    LIMIT = 40_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a whole text; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of `width` words.

    A text of fewer words has its whole sequence as its one shingle; a text
    without words (or null) has none.
    """
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - width + 1)
    take = min(width, len(h))
    acc = np.full(n, take, np.uint64)
    for k in range(take):
        acc = mix64(acc * _MUL + h[k : k + n])
    return np.unique(acc)


def fast_similarity_sketch(sets: list[np.ndarray], t: int, seed: int = 0) -> np.ndarray:
    """Sketch every set into `t` coordinates; equal coordinates estimate Jaccard similarity.

    Rounds of hashed bin placement: in round i < t every element falls into a
    random bin with the value (i, hash); in round t + j all elements fall into
    bin j.  A bin keeps its least value, so a later round fills only bins that
    are still empty, and after 2t rounds none is.  A set leaves as soon as all
    its bins are filled.  Empty sets give all-ones rows.
    """
    n = len(sets)
    out = np.full((n, t), np.iinfo(np.uint64).max, np.uint64)
    filled = np.zeros((n, t), bool)
    lens = np.fromiter(map(len, sets), np.int64, n)
    live = np.flatnonzero(lens)
    if not len(live):
        return out
    owner = np.repeat(live, lens[live])
    items = np.concatenate([sets[i] for i in live])
    for i in range(2 * t):
        h = mix64(items + np.uint64((i + 1 + seed * 1_000_003) * int(_MUL) & 0xFFFFFFFFFFFFFFFF))
        bins = (h % np.uint64(t)).astype(np.int64) if i < t else np.full(len(h), i - t)
        slot = owner * t + bins
        open_ = ~filled.ravel()[slot]
        slot, value = slot[open_], mix64(h[open_] ^ np.uint64(i * 2 + 1))
        np.minimum.at(out.ravel(), slot, value)
        filled.ravel()[slot] = True
        done = filled.all(axis=1)
        keep = ~done[owner]
        if not keep.any():
            break
        owner, items = owner[keep], items[keep]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key per band: the band's number and its coordinates, hashed."""
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sketch), bands)).copy()
    for r in range(rows):
        acc = mix64(acc * _MUL + sketch[:, r : bands * rows : rows])
    return acc.view(np.int64)
