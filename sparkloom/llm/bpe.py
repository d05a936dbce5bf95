"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves hold, for every symbol of a word, the rank of its pair with the
next live symbol; the root yields the leftmost pair of lowest rank.  A merge
is three point updates of logarithmic cost, so a word of n symbols takes
O(n log n) however long it is.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, spread, table

_NONE = 1 << 62
_WIDE = 1 << 24

# What Unicode added after the version of the library's tables (16 for
# its split pattern, 17 for its lower case) and newer tables of `regex` know.
LATER_LETTERS = """0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF
    10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF
    18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81
    1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F
    2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""
FIRST_LATER = "\u0558"
# The split pattern whose pieces hold no white space.
WITHOUT_BLANKS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same for lower-cased ASCII texts, in the plainer and faster engine.
ASCII_WITHOUT_BLANKS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
LATER_CAPITALS = "A7DD A7E2 AB6C-AB6D 1DF1F-1DFFF"


def _char_class(ranges: str) -> str:
    """The inside of a regex class for code points and ranges in hexadecimal."""
    return "".join("-".join(rf"\U{int(x, 16):08x}" for x in r.split("-")) for r in ranges.split())



def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


@functools.cache
def _later_capitals() -> dict[int, str]:
    """Lower case of the capitals that Python's Unicode tables are too old to know, by the case pairs of `regex`."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    small, unknown = "".join(regex.findall(r"\p{Ll}", every)), regex.compile(f"[{_char_class(LATER_CAPITALS)}]")
    pairs = {ord(c): regex.findall(regex.escape(c), small, regex.IGNORECASE) for c in regex.findall(r"\p{Lu}", every) if unicodedata.category(c) == "Cn" and not unknown.match(c)}
    return {c: found[0] for c, found in pairs.items() if found}


class _Pieces(dict):
    """piece -> (ids, tokens), each joined by a space; when it grows too large, pieces that only one batch had go, unless it is the one at hand."""

    LIMIT = 120_000

    def __init__(self, bpe: SegmentTreeBPE):
        super().__init__()
        self.bpe = bpe
        self.again: set[str] = set()  # pieces that a batch after their first one had

    def __missing__(self, word: str) -> tuple[str, str]:
        return self.bpe.said(self.bpe.encode_word(word))

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the new pieces of a batch together."""
        met = set().union(*texts)
        known = met & self.keys()
        new = [w for w in met - known if len(w) <= 64]
        self.again |= known
        if len(self) + len(new) > self.LIMIT:
            if len(self.again) > self.LIMIT // 2:
                self.again = known
            stay = {w: self[w] for w in self.again}
            self.clear()
            self.update(stay)
        many = self.bpe.encode_words(new) if len(new) > 300 else map(self.bpe.encode_word, new)
        for word, ids in zip(new, many):
            self[word] = self.bpe.said(ids)


class SegmentTreeBPE:
    """Encoder and decoder for a tokenizers JSON file of a word-end byte-level BPE.

    Supports the parts such a file may name here: NFC, white-space
    replacement, lower-casing, one isolating split pattern and byte-level
    symbols; anything else is refused.  Special tokens are found in the raw
    text first, as the library does.
    """

    def __init__(self, spec: str):
        self.spec = spec
        data = json.loads(spec)
        model = data["model"]
        kinds = [x["type"] for x in data["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or data["decoder"] or data["post_processor"]:
            raise ValueError(f"unsupported tokenizer file: {kinds}, {model['type']}")
        replace = data["normalizer"]["normalizers"][1]
        split = data["pre_tokenizer"]["pretokenizers"][0]
        self.blank, self.blank_to = regex.compile(replace["pattern"]["Regex"]), replace["content"]
        if (replace["pattern"]["Regex"], replace["content"]) == (r"\s+", " ") and split["pattern"]["Regex"] == WITHOUT_BLANKS:
            self.blank = None  # no piece has white space in it, so it makes no difference which
        self.ascii_pieces = ASCII_WITHOUT_BLANKS if split["pattern"]["Regex"] == WITHOUT_BLANKS else None
        self.pieces = regex.compile(split["pattern"]["Regex"])
        # The same pattern for texts with letters that the library does not take for letters.
        later = _char_class(LATER_LETTERS)
        self.later_at = regex.compile(f"[{later}]")
        self.strict_pieces = regex.compile(split["pattern"]["Regex"].replace(r"\p{L}", rf"[\p{{L}}--[{later}]]").replace(r"\p{N}", rf"[\p{{N}}--[{later}]]"), regex.V1)
        self.later_capitals = _later_capitals()
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = {i: t for t, i in (self.vocab | self.special).items()}
        self.end = model["end_of_word_suffix"] or ""
        self.symbols = byte_symbols()
        ids = self.vocab
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.names = {i: str(i) for i in self.tokens}
        self.cache = _Pieces(self)
        # The same vocabulary and merges as arrays; pairs are sorted for the search.
        self.plain = np.array([ids.get(c, -1) for c in self.symbols], np.int64)
        self.last = np.array([ids.get(c + self.end, -1) for c in self.symbols], np.int64)
        self.complete = bool((self.plain >= 0).all() and (self.last >= 0).all())
        pairs = sorted((a * _WIDE + b, rank, to) for (a, b), (rank, to) in self.merges.items())
        self.pairs, self.ranks, self.merged = np.array([*pairs, (_NONE, _NONE >> 8, 0)], np.int64).T.copy()
        # Ranks of the pairs that words begin with: two bytes, the second one the last of its word or not.
        second = np.stack([self.plain, self.last])
        self.byte_ranks = self.ranks[self._find(np.where(second < 0, -1, self.plain[:, None, None] * _WIDE + second))]

    def __reduce__(self):
        return SegmentTreeBPE, (self.spec,)

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one piece; symbols that the vocabulary lacks are left out."""
        shown = [self.symbols[b] for b in word.encode("utf-8", "replace")]
        shown[-1] += self.end
        ids = [self.vocab[s] for s in shown if s in self.vocab]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        size = 1 << (n - 1).bit_length()
        tree = [_NONE] * (2 * size)
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                tree[size + i] = found[0] * n + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                low = a if a < b else b
                if tree[i] == low:
                    break
                tree[i] = low
                i >>= 1

        def rank(i: int) -> int:
            j = following[i]
            found = merges.get((ids[i], ids[j])) if j < n else None
            return found[0] * n + i if found else _NONE

        while tree[1] != _NONE:
            i = tree[1] % n
            j = following[i]
            ids[i] = merges[ids[i], ids[j]][1]
            after = following[i] = following[j]
            if after < n:
                previous[after] = i
            put(j, _NONE)
            following[j] = -1
            put(i, rank(i))
            if previous[i] >= 0:
                put(previous[i], rank(previous[i]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = following[i]
        return out

    def _find(self, found: np.ndarray) -> np.ndarray:
        """Place of each pair in the merges, or the last place for none."""
        at = np.searchsorted(self.pairs, found)
        return np.where(self.pairs[at] == found, at, len(self.pairs) - 1)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of many pieces at once, a tree for each in the rows of one array."""
        out: list[list[int]] = [[]] * len(words)
        data = [w.encode("utf-8", "replace") for w in words]
        sizes = np.array([len(d) for d in data], np.int64)
        for wide in (8, 16, 32, 64, 128, 256):
            some = np.flatnonzero((sizes <= wide) & (sizes > (0 if wide == 8 else wide // 2)))
            for at in range(0, len(some), 1 << 15):
                rows = some[at : at + (1 << 15)]
                for k, ids in zip(rows.tolist(), self._trees([data[k] for k in rows.tolist()], sizes[rows], wide)):
                    out[k] = ids
        return out

    def _trees(self, data: list[bytes], sizes: np.ndarray, wide: int) -> list[list[int]]:
        n = len(data)
        flat = np.frombuffer(b"".join(data), np.uint8)
        inside = np.arange(wide) < sizes[:, None]
        ids = np.full((n, wide), -1, np.int64)
        ids[inside] = self.plain[flat]
        row = np.arange(n)
        ids[row, sizes - 1] = self.last[flat[np.cumsum(sizes) - 1]]
        if (ids[inside] < 0).any():  # a vocabulary that lacks bytes
            return [self.encode_word(d.decode("utf-8")) for d in data]
        following = np.tile(np.arange(1, wide + 1, dtype=np.int64), (n, 1))
        previous = following - 2
        tree = np.full((n, 2 * wide), _NONE, np.int64)
        pair = inside[:, 1:]
        bytes_ = np.zeros((n, wide), np.uint8)
        bytes_[inside] = flat
        ends = np.arange(1, wide) == sizes[:, None] - 1
        ranks = self.byte_ranks[bytes_[:, :-1][pair], ends[pair].view(np.uint8), bytes_[:, 1:][pair]]
        leaves = tree[:, wide : 2 * wide - 1]
        leaves[pair] = np.where(ranks < _NONE >> 8, ranks * wide + np.nonzero(pair)[1], _NONE)
        level = wide
        while level > 1:
            half = level // 2
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, half:level])
            level = half

        def put(r: np.ndarray, leaf: np.ndarray, value) -> None:
            node = leaf + wide
            tree[r, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        def rank(r: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Value of the leaf i of each row, whose pair is (i, j); j may lie past the end."""
            ok = j < sizes[r]
            found = self._find(np.where(ok, ids[r, i] * _WIDE + ids[r, np.minimum(j, wide - 1)], -1))
            value = self.ranks[found]
            return np.where(value < _NONE >> 8, value * wide + i, _NONE)

        live = row[tree[:, 1] != _NONE]
        while len(live):
            i = tree[live, 1] % wide
            j = following[live, i]
            ids[live, i] = self.merged[self._find(ids[live, i] * _WIDE + ids[live, j])]
            after = following[live, j]
            following[live, i] = after
            there = after < sizes[live]
            previous[live[there], after[there]] = i[there]
            ids[live, j] = -1
            put(live, j, _NONE)
            put(live, i, rank(live, i, after))
            before = previous[live, i]
            has = before >= 0
            if has.any():
                r, b = live[has], before[has]
                put(r, b, rank(r, b, i[has]))
            live = live[tree[live, 1] != _NONE]
        return [[t for t in own if t >= 0] for own in ids.tolist()]

    def said(self, ids: list[int]) -> tuple[str, str]:
        """Ids and tokens, each joined by a space."""
        return " ".join([self.names[i] for i in ids]), " ".join([self.tokens[i] for i in ids])

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text without special tokens."""
        # Each character is lowered by itself, so a final sigma is like any other.
        plain = unicodedata.normalize("NFC", text)
        if self.blank:
            plain = self.blank.sub(self.blank_to, plain)
        plain = plain.replace("Σ", "σ").lower()
        if self.ascii_pieces and plain.isascii():
            return self.ascii_pieces.findall(plain)
        highest = "" if plain.isascii() else max(plain)
        if highest >= "\u1c89":  # below it Python knows every capital
            plain = plain.translate(self.later_capitals)
        strict = highest >= FIRST_LATER and self.later_at.search(plain)
        return (self.strict_pieces if strict else self.pieces).findall(plain)

    def joined_batch(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """For each whole text its decimal ids joined by a space, and the text that they decode to."""
        runs = [self.special_at.split(t or "") if self.special_at else [t or ""] for t in texts]
        pieces = [[self._pieces(r) for r in own[::2]] for own in runs]
        self.cache.learn([p for own in pieces for p in own])
        out = []
        for own, split in zip(runs, pieces):
            parts: list[tuple[str, str]] = []
            for k, found in enumerate(split):
                if k:
                    special = own[2 * k - 1]
                    parts.append((str(self.special[special]), special))
                parts += map(self.cache.__getitem__, found)
            if not self.complete:  # pieces may have no tokens
                parts = [p for p in parts if p[0]]
            ids, tokens = zip(*parts) if parts else ((), ())
            out.append((" ".join(ids), " ".join(tokens)))
        return out

    def joined(self, text: str | None) -> tuple[str, str]:
        """joined_batch() of one text."""
        return self.joined_batch([text])[0]

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a whole text; none for null or an empty text."""
        return [int(i) for i in self.joined(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as the library does without a decoder; unknown ids are left out."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def tokenizer_spec(path: str | None = None) -> str:
    """The tokenizer file's JSON, read on the driver (about 2 MB, refused above 64 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        spec = f.read((64 << 20) + 1)
    if len(spec) > 64 << 20:
        raise ValueError("tokenizer file larger than 64 MB")
    return spec


def encode_documents(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode it again; one row per input row.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, on request,
    ids array<int> and decoded string.  Null and empty texts have no tokens.
    Nothing is shuffled; other columns of the input don't take part.
    """
    shared = df.sparkSession.sparkContext.broadcast(SegmentTreeBPE(tokenizer_spec(path)))
    new = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    if with_ids:
        new |= {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())}

    def begin():
        bpe = shared.value  # a worker's tasks share it and its cache, which is bounded
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()

        def encode(texts: list[str | None]) -> list[list]:
            both = bpe.joined_batch(texts)
            made = [[ids.count(" ") + 1 if ids else 0 for ids, _ in both], [sha(ids) for ids, _ in both], [sha(said) for _, said in both]]
            return made + [[[int(i) for i in ids.split()] for ids, _ in both], [said for _, said in both]] * with_ids

        return encode

    named = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_texts(named, "text", ["doc_id"], new, begin)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the 49k word BPE."""
    return encode_documents(spread(table(spark, sf_dir, "documents")))
