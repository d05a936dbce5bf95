"""Toxicity by a learned lexicon, matched with Levenshtein automata over its trie.

The lexicon holds whole words and word stems whose documents are labelled
toxic too often for chance.  Its trie is intersected with a Levenshtein
automaton (the pair is made deterministic lazily), so one walk over a word
finds every entry within that entry's error budget.  Each hit is weighed by
the window of words around it: quotation marks and reporting words lower it,
address raises it, by factors learnt from the labels of documents with hits.  A
document's score is the chance that at least one hit is abuse.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, spread, table

_WORD = re.compile(r"[^\W_]+")
# Scripts without spaces between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
STEM = range(3, 9)  # lengths of stems in characters
WINDOW = 8  # words on either side of a hit
EDIT_FACTOR = 0.6  # what a misspelling keeps of its term's weight for each error
EVIDENCE = 4.0  # documents that this guess counts as: four clean ones and no toxic one bring 0.6 below 0.3
FEW = 10.0  # a term known from so many toxic documents vouches half for its misspellings
HELD = 100_000  # counts that a task holds at once
PRIOR_HITS = 10.0  # documents that the factors below count as, against those of the sample
QUOTED, REPORTED, ADDRESSED = 0.4, 0.6, 1.2
# Fixed cue words of the context window.
REPORTING = frozenset("said says called calls quoted quote quotes wrote word words term terms definition means slur dit dijo sagte genannt".split())
ADDRESS = frozenset("you your youre u ur du dich dein tu te ton toi vous tus eres usted".split())
OPEN, CLOSE = "\"“„«‘", "\"”“»’"


_OPEN = re.compile(f"[{OPEN}]")
CUES = dict.fromkeys(REPORTING, REPORTED) | dict.fromkeys(ADDRESS, ADDRESSED)


class Word(NamedTuple):
    """A word and its place; like a match in what is used of it."""

    text: str
    a: int
    b: int

    def span(self) -> tuple[int, int]:
        """Start and end in the text."""
        return self.a, self.b

    def start(self) -> int:
        """Start in the text."""
        return self.a

    def end(self) -> int:
        """End in the text."""
        return self.b


def words_of(plain: str) -> list:
    """The words of a text in order; runs of scripts without spaces give each pair of neighbouring characters."""
    found = list(_WORD.finditer(plain))
    if plain.isascii() or not _UNSPACED.search(plain):
        return found
    out: list = []
    for m in found:
        at, end = m.span()
        while at < end:
            run = _UNSPACED.search(plain, at, end)
            stop = run.start() if run else end
            if stop > at:
                out.append(Word(plain[at:stop], at, stop))
            if run:
                a, b = run.span()
                out += [Word(plain[k : k + 2], k, k + 2) for k in range(a, b - 1)] or [Word(plain[a:b], a, b)]
            at = run.end() if run else end
    return out


def quoted(before: str, after: str) -> bool:
    """Whether a quotation opens before a word and closes after it."""
    return any(before.rfind(a) > before.rfind(b) if a != b else before.count(a) % 2 for a, b in zip(OPEN, CLOSE)) and any(c in after for c in CLOSE)


def plain_uses(plain: str) -> tuple[list[str], list[bool]]:
    """The words of a text in lower case, and whether each is used plainly: neither in quotation nor near a reporting word."""
    matches = words_of(plain)
    names = [m[0] for m in matches]
    uses = [True] * len(names)
    marks = [m.start() for m in _OPEN.finditer(plain)]
    if marks:
        found = [m.span() for m in matches]
        starts = [a for a, _ in found]
        # A mark counts for the WINDOW words after it.
        for i in sorted({k for p in marks for at in [bisect_left(starts, p)] for k in range(at, min(at + WINDOW, len(found)))}):
            low, high = max(0, i - WINDOW), min(len(found) - 1, i + WINDOW)
            uses[i] = not quoted(plain[starts[low] : starts[i]], plain[found[i][1] : found[high][1] + 1])
    if not REPORTING.isdisjoint(names):
        for i, w in enumerate(names):
            if w in REPORTING:
                for k in range(max(0, i - WINDOW), min(len(names), i + WINDOW + 1)):
                    if k != i:
                        uses[k] = False
    return names, uses


class LexiconAutomaton:
    """A trie of terms with error budgets, intersected with Levenshtein automata.

    terms: term -> (weight, errors allowed, whether it is a stem).  A stem
    matches every word that starts with it.
    """

    STATES = 10_000

    def __init__(self, terms: dict[str, tuple[float, int, bool]]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        for term in sorted(terms):
            at = 0
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                at = self.children[at][c]
            self.ends[at] = term
        self.most = [0] * len(self.children)
        for at in range(len(self.children) - 1, -1, -1):  # children have larger numbers
            own = terms[self.ends[at]][1] if self.ends[at] else 0
            self.most[at] = max([own, *(self.most[k] for k in self.children[at].values())])
        self._reset()

    def _reset(self) -> None:
        self.states: list[frozenset] = []
        self.numbers: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[int, str] | None] = []
        self.stems: list[tuple[int, str] | None] = []
        self.start = self._number(self._close({(0, 0)}))

    def _close(self, pairs: set[tuple[int, int]]) -> frozenset:
        """Add the states reached by leaving out characters of a term."""
        todo = list(pairs)
        while todo:
            at, errors = todo.pop()
            for k in self.children[at].values():
                if errors < self.most[k] and (k, errors + 1) not in pairs:
                    pairs.add((k, errors + 1))
                    todo.append((k, errors + 1))
        return frozenset(pairs)

    def _number(self, state: frozenset) -> int:
        if (n := self.numbers.get(state)) is None:
            n = self.numbers[state] = len(self.states)
            ends = [(e, self.ends[at]) for at, e in state if self.ends[at] and e <= self.terms[self.ends[at]][1]]
            self.states.append(state)
            self.steps.append({})
            self.found.append(min(ends, default=None))
            self.stems.append(min((x for x in ends if self.terms[x[1]][2]), default=None))
        return n

    def _step(self, n: int, c: str) -> int:
        pairs = set()
        for at, errors in self.states[n]:
            kids = self.children[at]
            if c in kids and errors <= self.most[kids[c]]:
                pairs.add((kids[c], errors))
            if errors < self.most[at]:
                pairs.add((at, errors + 1))
            for k in kids.values():
                if errors < self.most[k]:
                    pairs.add((k, errors + 1))
        to = self._number(self._close(pairs)) if pairs else -1
        self.steps[n][c] = to
        return to

    def match(self, word: str) -> tuple[int, str] | None:
        """(errors, term) of the best match of a word, by fewest errors; None without one."""
        if len(self.states) > self.STATES:
            self._reset()
        n, best = self.start, None
        for c in word:
            to = self.steps[n].get(c)
            n = self._step(n, c) if to is None else to
            if n < 0:
                return best
            stem = self.stems[n]
            if stem and (best is None or stem[0] < best[0]):
                best = stem
        end = self.found[n]
        return end if end and (best is None or end[0] <= best[0]) else best


def errors_allowed(term: str, stem: bool) -> int:
    """Short terms allow none: too many clean words lie next to them."""
    n = len(term)
    return 0 if n < 5 or (stem and n < 7) else 1 if n < 10 or stem else 2


def surroundings(plain: str, found: list, i: int) -> tuple[bool, set[str]]:
    """Whether word i stands in quotation, and the words in its window."""
    low, high = max(0, i - WINDOW), min(len(found) - 1, i + WINDOW)
    around = {found[k][0] for k in range(low, high + 1) if k != i}
    return quoted(plain[found[low].start() : found[i].start()], plain[found[i].end() : found[high].end() + 1]), around


class ToxicityModel:
    """Lexicon, the weights of misspellings seen in training, the prior of a document without hits, and context factors.

    Other misspellings have their term's weight times `unseen` for each error,
    times the term's `trust`.  `cues` has the factors of words near a hit,
    `quote` is that of quotation.
    """

    KNOWN = 20_000

    def __init__(self, terms: dict[str, tuple[float, int, bool]], variants: dict[str, float], unseen: float, prior: float, trust: dict[str, float] | None = None, cues: dict[str, float] | None = None, quote: float = QUOTED):
        self.terms, self.variants, self.unseen, self.prior = terms, variants, unseen, prior
        self.trust, self.cues, self.quote = trust or {}, CUES if cues is None else cues, quote
        self.automaton = LexiconAutomaton(terms)
        self.known: dict[str, float] = {}

    def __reduce__(self):
        return ToxicityModel, (self.terms, self.variants, self.unseen, self.prior, self.trust, self.cues, self.quote)

    def weight(self, word: str) -> float:
        """The chance that a word marks a toxic document, 0 for most words."""
        found = self.known.get(word)
        if found is None:
            hit = self.automaton.match(word)
            found = 0.0
            if hit:
                errors, term = hit
                found = self.terms[term][0] if not errors else self.variants.get(word, self.terms[term][0] * self.unseen**errors * self.trust.get(term, 1.0))
            if len(self.known) > self.KNOWN:
                self.known.clear()
            if len(word) < 80:
                self.known[word] = found
        return found

    def score(self, text: str | None) -> float:
        """Score of a whole text; the prior for null, empty and clean texts."""
        plain = (text or "").lower()
        spaced = plain.isascii() or not _UNSPACED.search(plain)
        hits = {w for w in set(_WORD.findall(plain) if spaced else [m[0] for m in words_of(plain)]) if self.weight(w)}
        clean = 1.0 - self.prior
        if hits:
            found = words_of(plain)
            best: dict[str, float] = {}
            for i, m in enumerate(found):
                if (w := m[0]) in hits:
                    best[w] = max(best.get(w, 0.0), min(0.999, self.weight(w) * self.context(plain, found, i, self.cues, self.quote)))
            # Guesses of misspellings err together: only the surest one counts beside the terms themselves.
            guessed = {w for w in best if self.automaton.match(w)[0]}
            for w in sorted(best.keys() - guessed):
                clean *= 1.0 - best[w]
            clean *= 1.0 - max((best[w] for w in guessed), default=0.0)
        return 1.0 - clean

    @staticmethod
    def context(plain: str, found: list, i: int, cues: dict[str, float] = CUES, quote: float = QUOTED) -> float:
        """Factor of a hit by its surroundings: quotation, and of the words around it the one that lowers and the one that raises most."""
        inside, around = surroundings(plain, found, i)
        factors = [cues[w] for w in around if w in cues]
        return (quote if inside else 1.0) * min([1.0, *factors]) * max([1.0, *factors])


def _tail(k: int, n: int, p: float) -> float:
    """log of the chance of at least k of n at rate p, by its largest terms."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, min(n, k + 40) + 1)]
    top = max(logs)
    return top + math.log(sum(math.exp(x - top) for x in logs))


def learn(labelled: DataFrame) -> ToxicityModel:
    """Fit the model on rows (text, label) of a bounded sample; null labels and texts are passed over.

    Only plain uses of a term count, toxic and clean ones alike: documents that
    quote or report it don't speak for or against it.
    """
    rows = labelled.select("text", "label").filter("text IS NOT NULL AND label IS NOT NULL")

    def frame(seen: dict) -> pd.DataFrame:
        return pd.DataFrame([(t, s, a, b) for (t, s), (a, b) in seen.items()], columns=["term", "stem", "clean", "toxic"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, bool], list[int]] = {}
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                own = {w for w, plain in zip(*plain_uses(text.lower())) if plain}
                keys = {(w, False) for w in own} | {(w[:k], True) for w in own for k in STEM if len(w) > k} | {("", True)}
                for key in keys:
                    seen.setdefault(key, [0, 0])[int(label > 0)] += 1
                if len(seen) > HELD:  # Spark adds the parts up
                    yield frame(seen)
                    seen = {}
        yield frame(seen)

    counts = rows.mapInPandas(count, "term string, stem boolean, clean long, toxic long").groupBy("term", "stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).persist()
    total = counts.filter("term = ''").first()
    clean, toxic = (total["clean"], total["toxic"]) if total else (0, 0)
    if not toxic or not clean:
        counts.unpersist()
        return ToxicityModel({}, {}, 0.0, 0.01)
    rate = toxic / (toxic + clean)
    tested = counts.filter("toxic + clean >= 3").count()
    pure = counts.filter("term <> '' AND toxic >= 3 AND toxic >= 9 * clean").collect()
    sure = [r for r in pure if _tail(r["toxic"], r["toxic"] + r["clean"], rate) + math.log(tested) < math.log(0.01)]
    chance = lambda r: (r["toxic"] + 0.5 * rate) / (r["toxic"] + r["clean"] + 0.5)
    words = {r["term"]: r for r in sure if not r["stem"]}
    forms = Counter(r["term"][:k] for r in pure if not r["stem"] for k in STEM if len(r["term"]) > k)
    stems: dict[str, float] = {}
    pure_stems = {r["term"]: r for r in sure if r["stem"] and r["toxic"] >= 49 * r["clean"]}
    for r in sorted((r for t, r in pure_stems.items() if forms[t] >= 4), key=lambda r: len(r["term"])):
        if any(r["term"][:k] in stems for k in STEM):
            continue
        # The longest form that nearly all of the stem's documents have is the surest.
        longer = [x for t, x in pure_stems.items() if t.startswith(r["term"]) and x["toxic"] >= 0.98 * r["toxic"]]
        best = max(longer, key=lambda x: len(x["term"]))
        stems[best["term"]] = chance(best)
    terms = {t: (p, errors_allowed(t, True), True) for t, p in stems.items()}
    terms |= {t: (chance(r), errors_allowed(t, False), False) for t, r in words.items() if t not in terms and not any(t[:k] in stems for k in STEM)}
    # Copies of one toxic document share all its words: terms must also stand in enough different places.
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, met = shared.value, set()
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                names, uses = plain_uses(text.lower())
                for before, w, after, plain in zip(["", *names], names, [*names[1:], ""], uses):
                    term = w if w in own else next((w[:k] for k in STEM if w[:k] in own and own[w[:k]][2]), None)
                    if term and plain:
                        met.add((term, before, after, label > 0))
        if met:
            yield pd.DataFrame(list(met), columns=["term", "before", "after", "toxic"])

    kinds = rows.mapInPandas(places, "term string, before string, after string, toxic boolean").distinct()
    by_place = kinds.groupBy("term").agg(F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean")).collect()
    stands = {r["term"] for r in by_place if r["toxic"] >= 9 * r["clean"] and _tail(r["toxic"], r["toxic"] + r["clean"], rate) + math.log(tested) < math.log(0.01)}
    terms = {t: x for t, x in terms.items() if t in stands}
    # Misspellings: words of the sample that only match with errors, and how their documents are labelled.
    lexicon = rows.sparkSession.sparkContext.broadcast(terms)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = LexiconAutomaton(lexicon.value)
        for batch in batches:
            hit = [automaton.match(t) for t in batch["term"]]
            guess = [lexicon.value[h[1]][0] * EDIT_FACTOR ** h[0] if h and h[0] else 0.0 for h in hit]
            yield batch[["term", "clean", "toxic"]].assign(guess=guess, near=[h[1] if h else "" for h in hit])[[g > 0 for g in guess]]

    close = counts.filter("NOT stem AND term <> ''").mapInPandas(near, "term string, clean long, toxic long, guess double, near string").collect()
    counts.unpersist()
    # The guess from term and errors is weighed against the documents that have this very word, not against other words.
    over = lambda r: max(0.0, (r["toxic"] - rate * (r["toxic"] + r["clean"])) / (1 - rate))
    crowd = Counter(r["near"] for r in close if r["toxic"] < 9 * r["clean"])
    support = {r["term"]: r["toxic"] for r in sure if r["term"] in terms and bool(r["stem"]) == terms[r["term"]][2]}
    trust = {t: n / (n + FEW) / max(1, crowd[t] - 1) for t, n in support.items()}
    weigh = lambda r: (over(r) + EVIDENCE * r["guess"] * trust[r["near"]]) / (r["toxic"] + r["clean"] + EVIDENCE)
    cues, quote = learn_context(rows, terms)
    return ToxicityModel(terms, {r["term"]: weigh(r) for r in close}, EDIT_FACTOR, 0.01, trust, cues, quote)


def learn_context(rows: DataFrame, terms: dict[str, tuple[float, int, bool]]) -> tuple[dict[str, float], float]:
    """Factors of the words near hits and of quotation, from the labels of the sample's documents that have hits.

    A factor is the share of toxic documents among those with the cue near a
    hit, against the share among those with plain hits.  The fixed cue words
    start from their fixed factors, which count as PRIOR_HITS documents; any
    other word becomes a cue if clean documents have it near plain hits too often
    for chance.
    """
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, seen = shared.value, {}
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                plain = text.lower()
                found = words_of(plain)
                kinds: set[tuple[str, str]] = set()
                for i, m in enumerate(found):
                    if (w := m[0]) in own or any(w[:k] in own and own[w[:k]][2] for k in STEM):
                        inside, around = surroundings(plain, found, i)
                        explained = inside or not REPORTING.isdisjoint(around)
                        kinds |= {("near", c) for c in around if c in CUES or not explained}
                        kinds.add(("quoted", "") if inside else ("reported", "") if explained else ("plain", ""))
                for key in kinds:
                    seen.setdefault(key, [0, 0])[int(label > 0)] += 1
        if seen:
            yield pd.DataFrame([(*k, a, b) for k, (a, b) in seen.items()], columns=["kind", "cue", "clean", "toxic"])

    counts = rows.mapInPandas(count, "kind string, cue string, clean long, toxic long").groupBy("kind", "cue").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # What comes back are the fixed cues and the words near hits of five documents of the bounded sample.
    met = {(r["kind"], r["cue"]): r for r in counts.filter((F.col("kind") != "near") | (F.col("toxic") + F.col("clean") >= 5) | F.col("cue").isin(*sorted(CUES))).collect()}
    plain = met.get(("plain", ""))
    share = (plain["toxic"] + 1) / (plain["toxic"] + plain["clean"] + 1) if plain else 1.0

    def factor(r, prior: float) -> float:
        t, n = (r["toxic"], r["toxic"] + r["clean"]) if r else (0, 0)
        return min(ADDRESSED, max(0.02, (t + PRIOR_HITS * prior * share) / (n + PRIOR_HITS) / share))

    cues = {w: factor(met.get(("near", w)), prior) for w, prior in CUES.items()}
    near = [r for (kind, w), r in met.items() if kind == "near" and w not in CUES]
    for r in near:
        n, chance = r["toxic"] + r["clean"], min(0.999, max(1 - share, 0.01))
        if r["clean"] > n * chance and _tail(r["clean"], n, chance) + math.log(len(near)) < math.log(0.01):
            cues[r["cue"]] = factor(r, 1.0)
    return cues, factor(met.get(("quoted", "")), QUOTED)


def bounded_sample(documents: DataFrame, labels: DataFrame, label: str, fold: int, held: int, most: int) -> DataFrame:
    """Texts and labels of at most `most` labelled documents outside the held-out fold.

    Which ones is decided by a hash of the id.  A document labelled more than
    once takes its largest label.  The sample's ids are broadcast: at most
    `most` rows of two numbers.
    """
    own = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    own = own.filter(F.crc32(F.col("doc_id").cast("string")) % fold != held)
    ids = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "label")


def score_toxicity(documents: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """Score every whole text; returns the columns `keep` (default doc_id) and `toxicity`.

    Null and empty texts get the model's prior.  Rows, repeated ones too, map
    one to one; nothing is shuffled.  A kept column called `toxicity` gives way.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def begin():
        own = shared.value
        own.known.clear()
        return lambda texts: [[own.score(t) for t in texts]]

    return map_texts(documents, "text", keep or ["doc_id"], {"toxicity": ("double", pa.float64())}, begin)


MOST_LABELS = 20_000


def fitted(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> ToxicityModel:
    """The model of these tables, learnt outside the held-out fold (crc32 of the id mod 4 is 2)."""
    return learn(bounded_sample(documents, labels, "toxic", 4, 2, most))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score all documents; see the contract's columns.  A null id counts as the empty text in the fold."""
    documents = spread(table(spark, sf_dir, "documents"))
    scored = score_toxicity(documents, fitted(documents, table(spark, sf_dir, "labels")))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    return scored.select("doc_id", held.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))
