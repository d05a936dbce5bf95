"""Personal data: fixed base patterns, and a character-level BiLSTM-CRF trained in numpy.

The base finds e-mail addresses, IPv4 addresses, payment cards and phone
numbers by pattern.  The network finds what is written in other forms: bracketed
or spelt-out separators, other groupings, other international prefixes.  Its
labelled spans are of two sorts, in windows of a bounded sample of documents:
those of the base, and planted ones in forms that the base misses.  It reads
overlapping windows over the whole of every text; where windows overlap, a
character's scores come from the window in which it lies deepest, and Viterbi
passes over the joined scores decide every run in which a span may lie.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, spread, table

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
WINDOW, STRIDE, MARGIN = 64, 32, 24
READ, AROUND = 512, 32  # longest window in which the network reads texts; what windows have in common
PIECE = 1 << 18  # longest piece, and about as many characters are read at once
MANY = 1024  # most windows read at once
LANES = 64  # windows whose steps are one product
LONG, SHARED = 2048, 256  # longest stretch decoded at once; what longer ones have in common with the next

# Fixed patterns of the contract, written so that no text makes them quadratic.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
# A digit, an @, or a separator of an address in brackets or spelt out.
_NEAR = re.compile(r"[0-9@]|[(\[{]\x20?(?:at|dot|\.)\x20?[)\]}]|\x20dot\x20", re.IGNORECASE)
_AT = re.compile(r"\s*[(\[{]\s*(?:at|@)\s*[)\]}]\s*|\s+at\s+|\s*@\s*", re.IGNORECASE)
_DOT = re.compile(r"\s*[(\[{]\s*(?:dot|\.)\s*[)\]}]\s*|\s+dot\s+|\s*\.\s*", re.IGNORECASE)
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_SEPARATED = re.compile(r"[+0-9][0-9\s().,/_\\|–:-]*[0-9]")
_DIGITS = re.compile(r"[0-9]+")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn check."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end()))
            end = found.end()
        else:
            end = max(end, at + 1) if start == at else at + 1
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of the fixed patterns by kind, in order."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not _TRIGGER.search(text):
        return out
    if "@" in text:
        out["email"] = _emails(text)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 or not p.strip("0") or int(p.lstrip("0")[:4] or 0) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")) and all(int(p[-3:]) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = "".join(_DIGITS.findall(m[0])) if m.end() - m.start() < 64 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                out["phone"].append(m.span())
    return out


def regions(text: str) -> list[Span]:
    """Stretches of text within MARGIN characters of what may be part of a span, joined where they touch."""
    out: list[list[int]] = []
    for m in _NEAR.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def stretches(a: int, b: int, most: int = LONG) -> list[Span]:
    """A region in parts of at most `most` characters; neighbours share SHARED of them."""
    return [(at, min(b, at + most)) for at in range(a, max(a + 1, b - SHARED), most - SHARED)]


def decided(part: Span, whole: Span) -> Span:
    """What one of stretches() decides: up to the middle of what it shares with its neighbours."""
    return part[0] + SHARED // 2 * (part[0] > whole[0]), part[1] - SHARED // 2 * (part[1] < whole[1])


_CODES = np.full(128, 1, np.uint8)
for _k, _c in enumerate("@.+-() %_/:,;=|\n[]{}"):
    _CODES[ord(_c)] = 5 + _k
_CODES[[ord(c) for c in "0123456789"]] = 2
_CODES[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 3
_CODES[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = np.arange(25, 51)
ALPHABET = 51  # 0 is padding, 4 any character outside ASCII


def codes(text: str) -> np.ndarray:
    """Class of every character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CODES[np.minimum(points, 127)], 4)


def tags(text: str, spans: dict[str, list[Span]]) -> np.ndarray:
    """Tag of every character for labelled spans."""
    out = np.zeros(len(text), np.int64)
    for k, kind in enumerate(KINDS):
        for a, b in spans[kind]:
            out[a:b] = 2 + 2 * k
            out[a] = 1 + 2 * k
    return out


def _soft(x: np.ndarray) -> np.ndarray:
    """Softsign; its slope, from its value, is (1 - |value|) ** 2."""
    return x / (1 + np.abs(x))


def _step(x: np.ndarray, power: np.ndarray) -> np.ndarray:
    """log(exp(x) @ power) by rows."""
    top = x.max(1, keepdims=True)
    return top + np.log(np.exp(x - top) @ power)


class BiLSTMCRF:
    """Embedding, one LSTM in each direction, linear tag scores and CRF transitions.

    Squashing is by softsign, x / (1 + |x|), and gates are (1 + softsign) / 2:
    three passes of simple arithmetic, where hyperbolic tangents took more time
    than all products.
    """

    def __init__(self, params: dict[str, np.ndarray]):
        self.params = params

    @staticmethod
    def fresh(seed: int = 5, embed: int = 16, hidden: int = 20) -> BiLSTMCRF:
        """Untrained weights."""
        draw = np.random.default_rng(seed)
        p = {"e": draw.normal(0, 0.5, (ALPHABET, embed)), "wo": draw.normal(0, 0.2, (2 * hidden, TAGS)), "bo": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)), "s": np.zeros(TAGS)}
        for d in "fb":
            p["w" + d] = draw.normal(0, (embed + hidden) ** -0.5, (embed + hidden, 4 * hidden))
            p["b" + d] = np.zeros(4 * hidden)
            p["b" + d][hidden : 2 * hidden] = 1.0
        return BiLSTMCRF(p)

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Tag scores (batch, steps, tags) of character classes, 0 being padding at the end.

        Single precision with a window to a column, so that a step is one product
        and few passes, each over neighbouring memory; the scores are a view of
        (steps, tags, batch).  Products are of LANES columns each, too small for a
        BLAS to spread over threads, which would only take cores from other tasks.
        The gates' missing halves are in the cell and in the weights that states
        go through; padding shuts the input gate, which leaves the backward state
        at zero.
        """
        p, (n, steps) = self.params, ids.shape
        embed, size, lanes = p["e"].shape[1], p["wo"].shape[0] // 2, -(-n // LANES) * LANES
        classes = np.zeros((embed + 2, ALPHABET), np.float32)
        classes[:embed], classes[embed], classes[embed + 1, 0] = p["e"].T, 1, 1
        turned = np.zeros((steps, lanes), np.intp)
        turned[:, :n] = ids.T
        seen = np.empty((steps, embed + 2, lanes), np.float32)
        for t in range(steps):
            np.take(classes, turned[t], axis=1, out=seen[t], mode="clip")
        out = np.empty((steps, TAGS, lanes), np.float32)
        both, z, y, c, more = (np.empty((k, lanes), np.float32) for k in (embed + 2 + size, 4 * size, 4 * size, size, TAGS))
        h, (i, f, o, g), gates, y1 = both[embed + 2 :], (z[k * size : (k + 1) * size] for k in range(4)), z[: 3 * size], y[:size]
        cut = lambda x: x.reshape(len(x), -1, LANES).transpose(1, 0, 2)
        both_cut, z_cut, h_cut, more_cut = map(cut, (both, z, h, more))
        for d in "fb":
            shut = np.where(np.arange(4 * size) < size, -1e9, 0.0)
            w = np.concatenate([p["w" + d][:embed], [p["b" + d]], [shut], p["w" + d][embed:] / 2]).T.astype(np.float32, order="C")
            score = ((p["wo"][:size] if d == "f" else p["wo"][size:]) / 2).T.astype(np.float32, order="C")
            c[:] = h[:] = 0
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                both[: embed + 2] = seen[t]
                np.matmul(w, both_cut, out=z_cut)
                np.abs(z, out=y)
                y += 1
                z /= y
                gates += 1
                i *= g
                c *= f
                c += i
                c *= 0.5
                np.abs(c, out=y1)
                y1 += 1
                np.divide(c, y1, out=h)
                h *= o
                np.matmul(score, h_cut, out=cut(out[t]) if d == "f" else more_cut)
                if d == "b":
                    out[t] += more
        out += p["bo"].astype(np.float32)[:, None]
        return out.transpose(2, 0, 1)[:n]

    def gradients(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood of tag sequences under the CRF, and its gradients (back-propagation through time).

        Both directions take their steps together, the backward one on turned
        windows; padding leaves a state as it is.
        """
        p = self.params
        n, steps = ids.shape
        embed, size = p["e"].shape[1], p["wo"].shape[0] // 2
        w, bias = np.stack([p["wf"], p["wb"]]), np.stack([p["bf"], p["bb"]])[:, None]
        seen = np.stack([ids, ids[:, ::-1]]).transpose(2, 0, 1)  # steps, direction, batch
        x, mask = p["e"][seen], (seen > 0).astype(float)[..., None]
        ahead = x @ w[:, :embed] + bias
        hs, cs = np.zeros((2, steps + 1, 2, n, size))
        acts, tcs, into = np.empty_like(ahead), np.empty_like(hs[1:]), w[:, embed:]
        for t in range(steps):
            a = acts[t] = _soft(ahead[t] + hs[t] @ into)
            gates, g, m = 0.5 + 0.5 * a[..., : 3 * size], a[..., 3 * size :], mask[t]
            c = cs[t] + m * (gates[..., size : 2 * size] * cs[t] + gates[..., :size] * g - cs[t])
            tcs[t] = _soft(c)
            cs[t + 1], hs[t + 1] = c, hs[t] + m * (gates[..., 2 * size :] * tcs[t] - hs[t])
        h = np.concatenate([hs[1:, 0], hs[:0:-1, 1]], axis=2).transpose(1, 0, 2)
        em, real = h @ p["wo"] + p["bo"], (ids > 0).astype(float)
        alpha, beta, power = np.zeros_like(em), np.zeros_like(em), np.exp(p["t"])
        alpha[:, 0] = p["s"] + em[:, 0]
        for t in range(1, steps):
            alpha[:, t] = np.where(real[:, t, None] > 0, _step(alpha[:, t - 1], power) + em[:, t], alpha[:, t - 1])
        for t in range(steps - 2, -1, -1):
            beta[:, t] = np.where(real[:, t + 1, None] > 0, _step(em[:, t + 1] + beta[:, t + 1], power.T), 0.0)
        logz = _step(alpha[:, -1], np.ones((TAGS, 1)))[:, 0]
        hot = np.eye(TAGS)[gold] * real[:, :, None]
        marg = np.exp(alpha + beta - logz[:, None, None]) * real[:, :, None]
        before, after, pair = alpha[:, :-1], em[:, 1:] + beta[:, 1:], real[:, 1:, None]
        top, most = before.max(2, keepdims=True), after.max(2, keepdims=True)
        left, right = np.exp(before - top), np.exp(after - most) * np.exp(top + most - logz[:, None, None]) * pair
        flat = lambda v: v.reshape(-1, v.shape[-1])
        seen_pairs = flat(hot[:, :-1]).T @ flat(hot[:, 1:])
        score = p["s"][gold[:, 0]] + (em * hot).sum((1, 2)) + (p["t"][gold[:, :-1], gold[:, 1:]] * real[:, 1:]).sum(1)
        gem = (marg - hot) / n
        grads = {"t": (power * (flat(left).T @ flat(right)) - seen_pairs) / n, "s": (marg[:, 0] - hot[:, 0]).mean(0), "wo": flat(h).T @ flat(gem), "bo": gem.sum((0, 1))}
        gh = (gem @ p["wo"].T).transpose(1, 0, 2)
        own = np.stack([gh[..., :size], gh[::-1, :, size:]], axis=1)
        slope, turn = (1 - np.abs(acts)) ** 2, (1 - np.abs(tcs)) ** 2
        slope[..., : 3 * size] *= 0.5
        dz, dh, dc, back = np.empty_like(acts), np.zeros((2, n, size)), np.zeros((2, n, size)), into.transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            gates, m = 0.5 + 0.5 * acts[t][..., : 3 * size], mask[t]
            dh = dh + own[t]
            live = dh * m
            dcc = dc * m + live * gates[..., 2 * size :] * turn[t]
            dz[t] = np.concatenate([dcc * acts[t][..., 3 * size :], dcc * cs[t], live * tcs[t], dcc * gates[..., :size]], axis=2) * slope[t]
            dh = dz[t] @ back + dh * (1 - m)
            dc = dcc * gates[..., size : 2 * size] + dc * (1 - m)
        by = lambda v: v.transpose(1, 0, 2, 3).reshape(2, steps * n, -1)
        gw = np.concatenate([by(x).transpose(0, 2, 1) @ by(dz), by(hs[:-1]).transpose(0, 2, 1) @ by(dz)], axis=1)
        gx = dz @ w[:, :embed].transpose(0, 2, 1) * mask
        which = np.eye(ALPHABET)[seen.ravel()]
        grads |= {"wf": gw[0], "wb": gw[1], "bf": dz[:, 0].sum((0, 1)), "bb": dz[:, 1].sum((0, 1)), "e": which.T @ flat(gx)}
        return float((logz - score).mean()), grads

    def certain(self, em: np.ndarray) -> bool:
        """Whether no path with a span can beat the one without: a bound on what entering, staying and leaving may gain."""
        t, s = self.params["t"], self.params["s"]
        best = (em[:, 1:].max(1) - em[:, 0]).max()
        enter = max((t[0, 1:] - t[0, 0]).max(), (s[1:] - s[0]).max())
        leave = max((t[1:, 0] - t[0, 0]).max(), 0.0)
        return best + enter + leave < 0 and best + (t[1:, 1:].max() - t[0, 0]) < 0

    def gains(self, em: np.ndarray) -> np.ndarray:
        """How much the best tag of every position beats none, for (batch, steps, tags); in the order of the scores' memory."""
        by_tag = em.transpose(1, 2, 0)
        return (by_tag[:, 1:].max(1) - by_tag[:, 0]).T

    def open_runs(self, em: np.ndarray) -> list[Span]:
        """Runs of positions outside which the best path has no span, each with a position more on either side.

        A span gains at most what its characters do, each with the best step
        within spans, and what entering and leaving do.  Where every stretch that
        holds a position gains less than nothing, the best path is outside there;
        so runs decoded by themselves give the path of the whole.
        """
        return self.runs(self.gains(em[None])[0])

    def runs(self, gains: np.ndarray) -> list[Span]:
        """open_runs() from gains()."""
        t, s = self.params["t"], self.params["s"]
        stay = t[1:, 1:].max() - t[0, 0]
        enter = max((t[0, 1:] - t[0, 0]).max(), (s[1:] - s[0]).max())
        leave = max((t[1:, 0] - t[0, 0]).max(), 0.0)
        least = stay - enter - leave - 1e-3
        if gains.max() + stay < min(0.0, least):  # all lose, so no stretch gains more than its best position
            return []
        gain = gains.astype(float) + stay
        total = np.concatenate([[0.0], np.cumsum(gain)])
        ending = total[1:] - np.minimum.accumulate(total[:-1])
        starting = np.maximum.accumulate(total[:0:-1])[::-1] - total[:-1]
        may = ending + starting - gain >= least
        edges = np.flatnonzero(np.diff(np.concatenate([[False], may, [False]]).astype(np.int8)))
        return [(max(0, a - 1), min(len(gains), b + 1)) for a, b in edges.reshape(-1, 2).tolist()]

    def viterbi(self, many: list[np.ndarray]) -> list[np.ndarray]:
        """Best tag sequence of the joined scores of each of many stretches."""
        n, steps = len(many), max(map(len, many))
        sizes = np.array([len(em) for em in many])
        em = np.zeros((n, steps, TAGS))
        for k, own in enumerate(many):
            em[k, : len(own)] = own
        best, back = self.params["s"] + em[:, 0], np.zeros((n, steps, TAGS), np.int8)
        last = np.zeros((n, TAGS))
        last[sizes == 1] = best[sizes == 1]
        for k in range(1, steps):
            total = best[:, :, None] + self.params["t"]
            back[:, k] = total.argmax(1)
            best = total.max(1) + em[:, k]
            last[sizes == k + 1] = best[sizes == k + 1]
        path = np.zeros((n, steps), np.int8)
        tag, row = last.argmax(1), np.arange(n)
        path[row, sizes - 1] = tag
        for k in range(steps - 1, 0, -1):
            tag = np.where(k < sizes, back[row, k, tag], tag)
            path[:, k - 1] = np.where(k < sizes, tag, path[:, k - 1])
        return [p[:m] for p, m in zip(path, sizes)]


def train(windows: list[tuple[str, np.ndarray]], steps: int = 900, batch: int = 64, seed: int = 5) -> BiLSTMCRF:
    """Fit by Adam on labelled windows (text, tags); without any, the network stays untrained and adds nothing."""
    model, draw = BiLSTMCRF.fresh(seed), np.random.default_rng(seed)
    if not windows:
        model.params["bo"][0] = 50.0
        return model
    ids, gold = np.zeros((len(windows), WINDOW), np.int64), np.zeros((len(windows), WINDOW), np.int64)
    for k, (text, own) in enumerate(windows):
        ids[k, : len(text)], gold[k, : len(text)] = codes(text), own
    m1, m2, step = {}, {}, 0
    while step < steps:
        order = draw.permutation(len(ids))
        for at in range(0, len(order), batch):
            _, grads = model.gradients(ids[order[at : at + batch]], gold[order[at : at + batch]])
            step += 1
            rate = 0.02 * max(0.0, 1 - step / steps) + 0.001
            norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m1[k] = 0.9 * m1.get(k, 0.0) + 0.1 * g
                m2[k] = 0.999 * m2.get(k, 0.0) + 0.001 * g * g
                model.params[k] = model.params[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def plausible(kind: str, piece: str) -> bool:
    """Whether a decoded piece, its separators made plain, has the shape of its kind; the network alone may stray."""
    if kind == "email":
        return bool(_EMAIL.fullmatch(_DOT.sub(".", _AT.sub("@", piece))))
    if kind == "ip":
        return bool(_IP.fullmatch(plain := _DOT.sub(".", piece))) and all(len(p) <= 3 and int(p) <= 255 for p in plain.split("."))
    digits = "".join(_DIGITS.findall(piece))
    if not _SEPARATED.fullmatch(piece.lstrip("(")):
        return False
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def _open(pieces: list[str], model: BiLSTMCRF) -> Iterator[tuple[int, Span, np.ndarray]]:
    """Every run of a piece in which spans may lie: number of the piece, the run, tag scores of its characters.

    The network reads every character of the pieces, in windows of at most READ
    characters, as long as each other within a piece.  Windows share AROUND
    characters with the next, so each character has AROUND / 2 on either side in
    the window whose score it takes, unless the piece ends there.
    """
    sizes, half = np.array([len(x) for x in pieces]), AROUND // 2
    many = np.maximum(1, -(-(sizes - AROUND) // (READ - AROUND)))
    step, ends, windows = np.maximum(1, -(-(sizes - AROUND) // many)), np.cumsum(sizes), np.cumsum(many)
    piece = np.repeat(np.arange(len(pieces)), many)
    at = (np.arange(len(piece)) - (windows - many)[piece]) * step[piece]
    length = np.minimum(step[piece] + AROUND, sizes[piece] - at)
    low, high = np.where(at == 0, 0, half), np.where(at + length == sizes[piece], length, length - half)
    flat = np.lib.stride_tricks.sliding_window_view(np.concatenate([codes("".join(pieces)), np.zeros(READ, np.uint8)]), READ)
    start, scores, gains = (ends - sizes)[piece] + at, [], []
    for k in range(0, len(piece), MANY):
        some = slice(k, k + MANY)
        column = np.arange(length[some].max())
        ids = flat[start[some], : len(column)]
        ids[column >= length[some, None]] = 0
        scores.append(model.emissions(ids))
        gains.append(model.gains(scores[-1])[(column >= low[some, None]) & (column < high[some, None])])
    for i, own in enumerate(np.split(np.concatenate(gains), ends[:-1])):
        for x, y in model.runs(own):
            place = np.arange(x, y)
            window = np.clip((place - half) // step[i], 0, many[i] - 1)
            column, window = place - window * step[i], window + windows[i] - many[i]
            parts = [window // MANY == k for k in range(window[0] // MANY, window[-1] // MANY + 1)]
            yield i, (x, y), np.concatenate([scores[window[p][0] // MANY][window[p] % MANY, column[p]] for p in parts])


def _decoded(path: np.ndarray) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the spans of a tag sequence."""
    out, at = [], 0
    for at in np.flatnonzero(path % 2 == 1).tolist():
        end = at + 1
        while end < len(path) and path[end] == path[at] + 1:
            end += 1
        out.append((KINDS[(int(path[at]) - 1) // 2], at, end))
    return out


def added_spans(texts: list[str], base: list[dict[str, list[Span]]], model: BiLSTMCRF) -> list[list[tuple[str, int, int]]]:
    """Spans that the network finds beyond the base, for a batch of texts; none touches a base span.

    The network reads every character of every text.  A text longer than PIECE
    is read in overlapping pieces, and a run longer than LONG in which spans
    may lie is decoded in overlapping parts; each decides up to the middle of
    what it shares with the next.  So memory is bounded for texts of any length.
    """
    todo = [(k, a, b) for k, text in enumerate(texts) if text for a, b in stretches(0, len(text), PIECE)]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    paths: dict[int, list[tuple[int, np.ndarray]]] = {}  # text -> (start, tags), in order
    total = sum(b - a for _, a, b in todo)
    share = total / max(1, -(-total // PIECE))  # even, as few windows take nearly the time of many
    at, runs, waiting = 0, [], 0  # scores, text, the part's place in it, what it decides
    while at < len(todo):
        some, held = [], 0
        while at < len(todo) and held < share:
            held += todo[at][2] - todo[at][1]
            some.append(todo[at])
            at += 1
        for i, run, em in _open([texts[k][a:b] for k, a, b in some], model):
            k, a, b = some[i]
            keep, stop = decided((a, b), (0, len(texts[k])))
            for x, y in stretches(*run):
                low, high = decided((x, y), run)
                low, high = max(low + a, keep), min(high + a, stop)
                if low < high:
                    runs.append((em[x - run[0] : y - run[0]], k, x + a, low, high))
                    waiting += y - x
        if waiting > PIECE // 4 or at == len(todo):  # few steps of many runs cost less than many of few
            for path, (k, x, low, high) in zip(_viterbi_sorted([r[0] for r in runs], model), [r[1:] for r in runs]):
                paths.setdefault(k, []).append((low, path[low - x : high - x]))
            runs, waiting = [], 0
    for k, own in paths.items():
        for start, path in _joined(own):
            for kind, s, e in _decoded(path):
                s, e = s + start, e + start
                free = all(e <= a or s >= b for spans in base[k].values() for a, b in spans)
                if free and plausible(kind, texts[k][s:e]):
                    out[k].append((kind, s, e))
    return [sorted(x) for x in out]


def _viterbi_sorted(many: list[np.ndarray], model: BiLSTMCRF) -> list[np.ndarray]:
    """viterbi() of many stretches, those of like length together and a bounded number of characters at once."""
    out: list[np.ndarray] = [None] * len(many)
    order, at = sorted(range(len(many)), key=lambda k: len(many[k])), 0
    while at < len(order):
        end = at + 1
        most = 2 * len(many[order[at]]) + 16  # shorter ones would take the steps of the longest
        while end < len(order) and len(many[order[end]]) <= min(most, (1 << 16) // (end + 1 - at)):
            end += 1
        for k, path in zip(order[at:end], model.viterbi([many[k] for k in order[at:end]])):
            out[k] = path
        at = end
    return out


def _joined(parts: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """(start, tags) of neighbouring parts put together where one begins at the other's end."""
    held: list[np.ndarray] = []
    first = end = 0
    for start, path in parts:
        if held and start != end:
            yield first, np.concatenate(held)
            held = []
        if not held:
            first = start
        held.append(path)
        end = start + len(path)
    if held:
        yield first, np.concatenate(held)


# Forms that the base misses: separators of addresses, of numbers, and prefixes.
FORMS = {
    "at": ("(at)", " (at) ", "[at]", " [at] ", " @ ", "{at}", " {at} "),
    "dot": (".", " (dot) ", "[dot]", "(dot)", " dot ", "[.]", " [dot] ", " . "),
    "ip": ("[.]", "(.)", " . ", "[dot]", ". ", "(dot)", " [.] "),
    "card": (".", "/", "_", "  ", " - ", " / ", "|", ":", "\\"),
    "phone": ("00{c} {a} {b}{d}", "00{c}-{a}-{b}{d}", "00{c}.{a}.{b}.{d}", "({a}) {b}-{d}", "({a}) {b} {d}", "{a}.{b}.{d}", "+{c}/{a}/{b}{d}", "+{c} / {a} / {b}{d}", "0{a}/{b}{d}", "(0{a}) {b} {d}", "{a}-{b}-{d}", "{a} {b} {d}", "{a}/{b}-{d}"),
}
# Numbers that are no personal data, whatever they look like.
OTHERS = ("{y}-0{n}-{t}", "{t}.0{n}.{y}", "{t}/0{n}/{y}", "{n}:{t}", "{y}-{y}", "{n}.{t}.{n}", "{n},{b},{a}.{t}", "#{a}{b}{d}", "{a}{b}{d}", "{d}/{d}", "v{n}.{n}.{n}-{t}", "{n} (at {t})", "ISBN 978-{n}-{t}-{a}{b}-{n}", "{a} x {b}", "{t}%", "(at {n} dot)", "{n} / {t} / {a}", "id {d}_{d}", "{y} . {t} . {n}", "({a}) {t}", "{b} - {d}", "{t} [{n}]")


def _digits(draw: random.Random, n: int) -> str:
    return str(draw.randrange(1, 10)) + "".join(str(draw.randrange(10)) for _ in range(n - 1))


def variant(kind: str, draw: random.Random, forms: dict[str, tuple[str, ...]] = FORMS) -> str:
    """A made-up span of a kind in a form that the base misses."""
    letters = lambda a, b: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(a, b)))
    if kind == "email":
        local = draw.choice((letters(3, 9), f"{letters(2, 7)}.{letters(3, 8)}", f"{letters(3, 8)}{draw.randrange(100)}", f"{letters(2, 5)}_{letters(3, 6)}"))
        at = draw.choice(forms["at"])
        dot = draw.choice([d for d in forms["dot"] if d.startswith(" ") == at.startswith(" ")] or forms["dot"])
        host = [letters(3, 9), draw.choice(("com", "org", "net", "de", "example", "info", letters(2, 3)))]
        return local + at + dot.join(host[:1] * (draw.random() < 0.2) + host)
    if kind == "ip":
        return draw.choice(forms["ip"]).join(str(draw.randrange(256)) for _ in range(4))
    if kind == "card":
        digits = _digits(draw, 15)
        digits += next(c for c in "0123456789" if luhn(digits + c))
        return draw.choice(forms["card"]).join(digits[i : i + 4] for i in range(0, 16, 4))
    return draw.choice(forms["phone"]).format(c=draw.choice(("1", "33", "34", "44", "49", "420")), a=_digits(draw, 3), b=_digits(draw, 3), d=_digits(draw, 4))


def other(draw: random.Random) -> str:
    """A made-up number that is no personal data."""
    return draw.choice(OTHERS).format(y=draw.randrange(1900, 2035), n=draw.randrange(1, 10), t=draw.randrange(10, 32), a=_digits(draw, 3), b=_digits(draw, 3), d=_digits(draw, 4))


def planted(carriers: list[str], many: int, seed: int = 11, forms: dict[str, tuple[str, ...]] = FORMS) -> list[tuple[str, np.ndarray]]:
    """Windows of plain text with a variant (or, one time in three, another number) put in at a random word, and their tags."""
    draw, out = random.Random(seed), []
    carriers = [c for c in carriers if c.count(" ") > 1] or ["some words before and after what is put in here"]
    for _ in range(many):
        words = draw.choice(carriers).split(" ")
        at = draw.randrange(len(words) + 1)
        kind = draw.choice((*KINDS, "", ""))
        piece = variant(kind, draw, forms) if kind else other(draw)
        lead = draw.choice(("", "", "(", "<", ": ")) if kind else ""
        before = " ".join(words[:at]) + " " * bool(at) + lead
        after = draw.choice((" ", " ", ", ", ". ", ") ", "\n")) + " ".join(words[at:])
        skip = max(0, len(before) - draw.randrange(4, 24))
        text = (before[skip:] + piece + after)[:WINDOW]
        own = np.zeros(len(text), np.int64)
        if kind and len(before) - skip + len(piece) <= WINDOW:
            k, s = KINDS.index(kind), len(before) - skip
            own[s : s + len(piece)] = 2 + 2 * k
            own[s] = 1 + 2 * k
        elif kind:
            continue
        out.append((text, own))
    return out


# What may be a span in a form that the base misses: a window with one is no sure example of what is outside.
_DOUBTFUL = re.compile(r"(?:[0-9][\s().,/_:-]{0,3}){8}|[0-9]\s?[(\[{]\s?(?:\.|dot)|[(\[{]\s?(?:at|@)\s?[)\]}]|\s@\s", re.IGNORECASE)


def labelled_windows(documents: DataFrame, most_documents: int = 2000, most_windows: int = 3000, most_planted: int = 6000) -> list[tuple[str, np.ndarray]]:
    """Windows with the base's spans and planted ones as labels, from a bounded sample of documents.

    About `most_documents` documents, chosen by a hash of their text, give at
    most `most_windows` windows; which are kept is decided by hash too.
    `most_planted` more are windows without a span into which one was put.
    """
    total = documents.count()
    share = min(1.0, most_documents / max(1, total))
    some = documents.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                if not text:
                    continue
                own = tags(text, base_spans(text))
                near = regions(text) or [(0, min(len(text), WINDOW))]
                for a, b in near:
                    for at in range(a, max(a + 1, b - STRIDE), STRIDE):
                        end = min(b, at + WINDOW)
                        inside = own[at:end].any()
                        if inside or not _DOUBTFUL.search(text[at:end]):
                            rows.append((text[at:end], own[at:end].astype("int8").tobytes()))
            yield pd.DataFrame(rows, columns=["piece", "tags"])

    cuts = some.mapInPandas(cut, "piece string, tags binary")
    found = cuts.dropDuplicates(["piece"]).orderBy(F.xxhash64("piece"), "piece").limit(most_windows).collect()
    windows = [(r["piece"], np.frombuffer(r["tags"], np.int8).astype(np.int64)) for r in found]
    plain = [text for text, own in windows if not own.any()]
    return windows + planted(plain, most_planted) if windows else []


def find_pii(documents: DataFrame, model: BiLSTMCRF, keep: list[str] | None = None) -> DataFrame:
    """Base and added spans of every whole text; returns `keep` (default doc_id) and `found`.

    `found` is an array of (kind, start, end, added): code points, end
    exclusive, by kind as listed and start.  Null and empty texts have none.
    Rows map one to one; nothing is shuffled.  A kept column called `found`
    gives way.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())])
    new = {"found": ("array<struct<kind:string,start:int,end:int,added:boolean>>", pa.list_(span))}
    order = {k: i for i, k in enumerate(KINDS)}

    def find(texts: list[str | None]) -> list[list]:
        texts = [t or "" for t in texts]
        base, found = [base_spans(t) for t in texts], []
        for own, extra in zip(base, added_spans(texts, base, shared.value)):
            rows = [(k, a, b, False) for k in KINDS for a, b in own[k]] + [(*x, True) for x in extra]
            rows.sort(key=lambda x: (order[x[0]], x[1]))
            found.append([dict(zip(("kind", "start", "end", "added"), x)) for x in rows])
        return [found]

    return map_texts(documents, "text", keep or ["doc_id"], new, lambda: find)


def masked(text, found):
    """Column of a text whose spans are replaced by their kind in brackets; null texts stay null.

    Spans of other kinds that overlap an earlier one are covered by it.
    """
    ordered = F.array_sort(found, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, x):
        gap = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        said = F.concat(acc["out"], gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))
        covered = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))
        return F.when(x["start"] < acc["at"], covered).otherwise(F.struct(said.alias("out"), x["end"].alias("at")))

    tail = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(found) > 0, F.aggregate(ordered, start, step, tail)).otherwise(text)


def fitted(documents: DataFrame) -> BiLSTMCRF:
    """The network trained on windows of these documents."""
    return train(labelled_windows(documents))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of all documents; counts and base_sha256 are of base spans, `spans` has the added ones too."""
    documents = spread(table(spark, sf_dir, "documents"))
    found = find_pii(documents, fitted(documents))
    base = F.filter("found", lambda x: ~x["added"])
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))
