"""The corpus operators against brute force on small tables, with the odd rows of each contract."""

import base64
import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bpe, decontamination, media, minhash, pii, quality, repeats, sharding, shingles, toxicity, warc
from sparkloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place long, bucket int, key long, size long"


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those that operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", None, None, 1, 2, 3, 4) for i, t in zip(ids, texts)], SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))


ODD = [None, "", " ", "a", "Ünï cödé", "same", "same", "x" * 5000]


# ---- op1
def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    at = collections.defaultdict(list)
    for d, b in enumerate(data):
        for i in range(len(b) - length + 1):
            at[b[i : i + length]].append((d, i))
    cover = [np.zeros(len(b), bool) for b in data]
    for where in at.values():
        if len(where) > 1:
            for d, i in where:
                cover[d][i : i + length] = True
    out = []
    for b, c in zip(data, cover):
        runs = int((np.diff(np.r_[0, c.astype(int)]) == 1).sum())
        out.append((len(b), int(c.sum()), runs, hashlib.sha256(bytes(x for x, y in zip(b, c) if not y)).hexdigest()))
    return out


def repeat_texts():
    rng = random.Random(4)
    shared = [words(rng, 120) for _ in range(4)]
    texts = [words(rng, rng.randrange(5, 90)) + rng.choice(shared)[rng.randrange(200) :] + words(rng, rng.randrange(60)) for _ in range(40)]
    texts += [shared[0] + "Z" + shared[0], texts[3], texts[3], shared[1][:399], "ab" * 700, "é" * 300, "é" * 300 + "!"]
    return [*texts, *ODD]


@pytest.mark.parametrize("crowded", [False, True])
def test_repeats_match_brute_force(spark, monkeypatch, crowded):
    if crowded:
        monkeypatch.setattr(repeats.Unit, "most_slices", 2)
    texts = repeat_texts()
    got = {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, repeats.LENGTH)


def brute_shared_words(texts):
    """Words of each text in windows of 50 words that another row has too."""
    own = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split() for t in texts]
    seen = collections.defaultdict(set)
    for k, w in enumerate(own):
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])].add(k)
    return [len({j for i in range(len(w) - 49) if len(seen[tuple(w[i : i + 50])]) > 1 for j in range(i, i + 50)}) for w in own]


@pytest.mark.parametrize("crowded", [False, True])
def test_shared_words_match_brute_force(spark, monkeypatch, crowded):
    if crowded:
        monkeypatch.setattr(repeats.Unit, "most_slices", 2)
    rng = random.Random(21)
    passage = words(rng, 55)
    texts = [f"{words(rng, rng.randrange(90))} {passage} {words(rng, rng.randrange(90))}" for _ in range(8)]
    texts += [" ".join([words(rng, 60)] * 3), " ".join(["the same"] * 60), " ".join(["The Same"] * 40), passage.upper() + " x", words(rng, 200)] + [words(rng, 70)] * 3
    own = passage + " " + words(rng, 30)  # twice in one text, and its start in others
    texts += [own + " y " + own, words(rng, 49), *repeat_texts()[:6], *ODD[:4]]
    got = {r.doc_id: r.n_shared_words for r in repeats.remove_repeats(frame(spark, texts), with_words=True).collect()}
    assert [got[i] for i in range(len(texts))] == brute_shared_words(texts)


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(frame(spark, [])).count() == 0
    kept = repeats.remove_repeats(frame(spark, [None, "abc"], [None, 5]), with_bytes=True).collect()
    assert sorted((str(r.doc_id), bytes(r.kept)) for r in kept) == [("5", b"abc"), ("None", b"")]


@pytest.mark.parametrize("length", [3, 8, 21])
def test_refinement_sorts_windows(length):
    rng = np.random.default_rng(length)
    data = rng.integers(0, 2, 300).astype(np.uint8)
    number = repeats.refine(data, np.arange(300 - length + 1), length)
    named = collections.defaultdict(set)
    for i, n in enumerate(number):
        named[data[i : i + length].tobytes()].add(n)
    assert all(len(v) == 1 for v in named.values()) and len(set(number)) == len(named)


# ---- op2
def edit(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        new = [i + 1]
        for j, b in enumerate(t):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (a != b)))
        row = new
    return min(row)


def whole_edit(p, t):
    row = list(range(len(t) + 1))
    for i, a in enumerate(p):
        new = [i + 1]
        for j, b in enumerate(t):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (a != b)))
        row = new
    return row[-1]


def test_leaks_start_where_they_start(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = frame(spark, ["zz yy " + item.replace("five ", "") + " xx", "a " + item, item.removeprefix("one ")]).withColumn("leaks", F.lit("mine"))
    found = {r.doc_id: [tuple(x) for x in r.leaks] for r in decontamination.find_leaks(docs, bench, keep=["doc_id", "leaks"]).collect()}
    assert found == {0: [(1, 1, 2, 13)], 1: [(1, 0, 1, 13)], 2: [(1, 1, 0, 11)]}


def test_myers_is_edit_distance():
    rng = random.Random(1)
    for _ in range(500):
        p, t = [rng.choice("abc") for _ in range(rng.randrange(1, 80))], [rng.choice("abc") for _ in range(rng.randrange(60))]
        assert decontamination.myers(p, t)[0] == edit(p, t)


@pytest.mark.parametrize("block", [8 << 20, 200])
def test_leaks_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    rng = random.Random(2)
    items = [words(rng, rng.randrange(1, 45)) for _ in range(12)]
    texts = []
    for k in range(60):
        own = rng.choice(items).split()
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(own) + 1)
            own[at : at + rng.randrange(2)] = [words(rng, 1)] * rng.randrange(2)
        texts.append(words(rng, rng.randrange(30)) + " " + ", ".join(own).title() + " " + words(rng, rng.randrange(30)))
    texts += ODD
    bench = spark.createDataFrame([*enumerate([*items, items[0], "", None]), (None, "x")], "item_id long, text string")
    found = decontamination.find_leaks(frame(spark, texts), bench).collect()
    got = {(r.doc_id, x.item_id): x.distance for r in found for x in r.leaks}
    everything = [*items, items[0]]
    for r in found:
        own = decontamination.words(texts[r.doc_id])
        for x in r.leaks:  # the stretch has the distance, and no shorter one that ends there has
            item = decontamination.words(everything[x.item_id])
            assert whole_edit(item, own[x.start : x.end]) == x.distance
            assert x.start == x.end or whole_edit(item, own[x.start + 1 : x.end]) > x.distance
    want = {}
    for i, t in enumerate(texts):
        for j, item in enumerate([*items, items[0]]):
            own, k = decontamination.words(item), decontamination.budget(len(decontamination.words(item)))
            if (d := edit(own, decontamination.words(t))) <= k:
                want[i, j] = d
    assert got == want
    assert decontamination.find_leaks(frame(spark, []), bench).count() == 0
    assert all(r.leaks == [] for r in decontamination.find_leaks(frame(spark, texts), bench.limit(0)).collect())


# ---- op3
def test_automaton_finds_every_word_within_budget():
    rng = random.Random(3)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))): (0.9, rng.randrange(3), False) for _ in range(12)}
    auto = toxicity.LexiconAutomaton(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    for _ in range(1500):
        w = "".join(rng.choice("abcd") for _ in range(rng.randrange(9)))
        within = [d for t, (_, k, _) in terms.items() if (d := distance(w, t)) <= k]
        found = auto.match(w)
        assert (found[0] if found else None) == (min(within) if within else None), w


def test_stems_and_context():
    model = toxicity.ToxicityModel({"grobl": (0.99, 0, True), "scoundrel": (0.99, 1, False)}, {"scoundral": 0.8, "scoundrels": 0.0}, 0.05, 0.01)
    assert model.score("a groblfest here") > 0.9 and model.score("a grob here") == pytest.approx(0.01)
    assert model.score("you scoundral") > 0.7 > 0.3 > model.score("scoundrels")
    assert model.score('he said "scoundrel" once') < model.score("such a scoundrel once")
    assert model.score(None) == model.score("") == pytest.approx(0.01)


def planted_labels(rng, toxic, clean):
    """(text, label): each phrase amid random words."""
    return [(f"{words(rng, 12)} {t} {words(rng, 12)}", label) for label, own in ((1, toxic), (0, clean)) for t in own]


def test_misspellings_weigh_by_their_term(spark):
    rng = random.Random(12)
    toxic = ["scoundrel"] * 60 + ["scoundrol"]  # one misspelling met once
    rows = planted_labels(rng, toxic, [""] * 300 + ["scoundral"] + ["scoundren"] * 25)
    model = toxicity.learn(spark.createDataFrame(rows, "text string, label int"))
    score = lambda w: model.score(f"some text with {w} in it")
    assert score("scoundrel") > 0.9
    assert all(score(w) >= 0.3 for w in ["scoundre1", "skoundrel", "scoundel", "scoundrol", "scoundral"])
    assert score("scoundrol") > score("scoundre1") > score("scoundral")
    assert score("scoundren") < 0.1 and score("scorn") == pytest.approx(0.01)


def test_quoting_documents_leave_a_term_in_the_lexicon(spark):
    rng = random.Random(13)
    toxic = ["scoundrel"] * 50
    clean = [""] * 280 + ['he called him a "scoundrel" there'] * 10 + ["“the old scoundrel”"] * 5 + ["the word scoundrel"] * 5 + ["weather"] * 20
    model = toxicity.learn(spark.createDataFrame(planted_labels(rng, toxic, clean), "text string, label int"))
    assert set(model.terms) == {"scoundrel"}
    assert model.score("such a scoundrel as this") > 0.9
    assert model.score('he called him a "scoundrel" there') < 0.3


def test_plain_uses_agree_with_the_context_of_hits():
    rng = random.Random(14)
    for _ in range(300):
        text = "".join(rng.choice(["ab ", "cd ", "said ", "x", '"', "“", "”", "«", "»", ", "]) for _ in range(rng.randrange(60)))
        found = list(toxicity._WORD.finditer(text))
        names, uses = toxicity.plain_uses(text)
        assert names == [m[0] for m in found]
        for i in range(len(found)):
            around = {found[k][0] for k in range(max(0, i - 8), min(len(found), i + 9)) if k != i}
            assert uses[i] == (toxicity.ToxicityModel.context(text, found, i) >= 1.0), (text, i, around)


def test_context_is_learnt_from_labels(spark):
    rng = random.Random(15)
    toxic = ["scoundrel"] * 80
    clean = [""] * 200 + ['"scoundrel" there'] * 30 + ["nautical scoundrel"] * 8
    rows = planted_labels(rng, toxic, clean)
    model = toxicity.learn(spark.createDataFrame(rows, "text string, label int"))
    assert model.quote < 0.2 and model.cues["nautical"] < 0.7 and model.cues["said"] == pytest.approx(0.6)
    assert model.score("nautical scoundrel") < model.score("such a scoundrel")


def test_unspaced_scripts_and_long_words(spark):
    rng = random.Random(16)
    han = "".join(map(chr, range(0x4E00, 0x4E40)))
    line = lambda: "".join(rng.choice(han) for _ in range(20))
    long_ = "b" * 100
    rows = [(line() + "傻瓜" + line(), 1) for _ in range(30)] + [(f"here {long_} {i} end", 1) for i in range(30)] + [(line(), 0) for _ in range(100)] + [(f"here {i} end", 0) for i in range(100)]
    model = toxicity.learn(spark.createDataFrame(rows, "text string, label int"))
    assert model.score(line()[1:] + "傻瓜" + line()) > 0.3 > model.score(line())
    assert model.score(f"x {long_}") > 0.3
    assert [m[0] for m in toxicity.words_of("ab好的吗cd 好")] == ["ab", "好的", "的吗", "cd", "好"]


def test_toxicity_on_held_out_documents(spark):
    """Of sf0.1's held-out documents, toxic ones are found and clean ones left alone."""
    docs, labels = labelled(spark, "/root/testdata/sf0.1")
    held = labels.filter("crc32(cast(doc_id AS string)) % 4 = 2")
    got = toxicity.score_toxicity(docs, toxicity.fitted(docs, labels)).join(held, "doc_id").groupBy("toxic").agg(F.avg((F.col("toxicity") >= 0.3).cast("int")).alias("flagged")).collect()
    flagged = {r.toxic: r.flagged for r in got}
    assert flagged[1] >= 0.85 and flagged[0] <= 0.03


def labelled(spark, sf_dir):
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    return read("documents"), read("labels")


def test_toxicity_learns_and_keeps_every_row(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = labelled(spark, sf_dir)
    got = toxicity.op3_toxicity(spark, sf_dir).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) >= 0.93 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert not any(r.predicted and not r.toxic for r in got)
    model = toxicity.learn(docs.limit(0).withColumn("label", F.lit(1)))
    odd = toxicity.score_toxicity(frame(spark, ODD, [None, 1, 2, 3, 4, 5, 5, 7]), model)
    assert odd.count() == len(ODD) and odd.filter("toxicity > 0.1").count() == 0


# ---- op4
def test_quality_learns_and_keeps_every_row(spark):
    sf_dir = "/root/testdata/sf0.01"
    _, labels = labelled(spark, sf_dir)
    got = quality.op4_quality(spark, sf_dir).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_frequent_words_have_vectors_of_their_own(spark):
    rng = random.Random(31)
    texts = [f"{rng.choice(['red', 'blue'])} bird sings, {rng.choice(['old', 'young'])} fish swims" for _ in range(200)] + [None, "", "rare1 rare2", "x" * 200_000 + " bird"]
    docs = frame(spark, texts)
    own = quality.vocabulary(docs, 9)
    assert len(own) == 9 and {"bird", "sings", ",", "fish", "swims"} <= own.keys() and not own.keys() & {"rare1", "rare2"}
    vectors = quality.word_vectors(docs, own)
    place, sign = quality.index_vectors()
    index = np.zeros((quality.ALL, quality.DIM))
    np.put_along_axis(index, place, sign, 1)
    want, rows = np.zeros((quality.ALL, quality.DIM)), quality._Rows(own)
    for t in texts:
        at = [rows[w] for w in quality.tokens(t)]
        for i, w in enumerate(at):
            for j in range(max(0, i - 2), min(len(at), i + 3)):
                want[w] += index[at[j]] * (i != j)
    want /= np.maximum(1e-6, np.linalg.norm(want, axis=1, keepdims=True))
    assert np.allclose(vectors, want, atol=1e-6)
    assert abs(vectors[own["red"]] @ vectors[own["blue"]]) > 0.5 > abs(vectors[own["red"]] @ vectors[own["swims"]])


def test_quality_of_odd_rows(spark):
    docs, labels = frame(spark, ODD, [None, 1, 2, 3, 4, 5, 5, 7]), spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    out = quality.score_quality(docs, quality.fitted(docs, labels)).collect()
    assert len(out) == len(ODD) and all(0 <= r.quality <= 1 for r in out)
    assert quality.score_quality(docs.limit(0), quality.fitted(docs.limit(0), labels)).count() == 0


# ---- op5
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def kept(kind, piece):
    d = re.sub("[^0-9]", "", piece)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in piece.split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def test_base_spans_match_the_patterns():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab@.+-0129 (_%4\n٣") for _ in range(rng.randrange(60))) for _ in range(4000)] + ["4111 1111 1111 1111 x", "+1 (269) 555-3296", "0255.0.0.01", "1" * 30000, "a" * 30000 + "@", "1.1.1.1.1"]
    for t in texts:
        assert pii.base_spans(t) == {k: [m.span() for m in re.finditer(p, t) if kept(k, m[0])] for k, p in PATTERNS.items()}, t


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    model = pii.BiLSTMCRF.fresh()
    ids, gold = rng.integers(1, pii.ALPHABET, (3, 12)), rng.integers(0, pii.TAGS, (3, 12))
    ids[1, 7:] = gold[1, 7:] = 0
    _, grads = model.gradients(ids, gold)
    for k, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, vals = model.params[k][at], []
        for e in (1e-5, -1e-5):
            model.params[k][at] = old + e
            vals.append(model.gradients(ids, gold)[0])
        model.params[k][at] = old
        assert (vals[0] - vals[1]) / 2e-5 == pytest.approx(g[at], rel=1e-4, abs=1e-7)


def test_pii_rows_and_masks(spark):
    texts = ["mail me a.b@mail7.example.com or +1 (269) 555-3296", "ip 65.38.191.115 card 4524132264652876", *ODD]
    docs = frame(spark, texts, [0, 1, None, 3, 4, 5, 6, 7, 7, 9])
    model = pii.train([])
    out = {r.doc_id: r for r in pii.find_pii(docs, model, ["doc_id", "text"]).withColumn("m", pii.masked(F.col("text"), F.col("found"))).collect()}
    assert out[0].m == "mail me [EMAIL] or [PHONE]" and out[1].m == "ip [IP] card [CARD]" and out[None].m is None and out[3].m == ""
    assert not any(x.added for r in out.values() for x in r.found)
    assert pii.find_pii(docs.limit(0), model).count() == 0


def test_network_finds_what_it_was_taught():
    rng = random.Random(6)
    texts = []
    for _ in range(150):
        n = lambda a, b: str(rng.randrange(a, b))
        piece = rng.choice([f"{words(rng, 1)}.{n(10, 99)}@mail{n(1, 9)}.example.com", ".".join(n(1, 255) for _ in range(4)), f"+1 ({n(200, 999)}) 555-{n(1000, 9999)}"])
        texts.append(f"{words(rng, 6)} {piece} {words(rng, 6)}")
    base = [pii.base_spans(t) for t in texts]
    cut = [(t[a : a + 64], pii.tags(t, b)[a : a + 64]) for t, b in zip(texts, base) for a, _ in pii.regions(t)]
    model = pii.train(cut, steps=150)
    found = pii.added_spans(texts, [{k: [] for k in pii.KINDS}] * len(texts), model)
    right = sum((a, b) in own[k] for own, f in zip(base, found) for k, a, b in f)
    assert right >= 0.8 * len(texts)
    assert all(f == [] for f in pii.added_spans(texts, base, model))


def test_scores_match_the_plain_recurrence():
    rng = np.random.default_rng(3)
    model = pii.BiLSTMCRF.fresh()
    p, ids = model.params, rng.integers(1, pii.ALPHABET, (70, 40))
    lengths = rng.integers(1, 41, 70)
    ids[np.arange(40) >= lengths[:, None]] = 0
    soft = lambda x: x / (1 + np.abs(x))
    got, size = model.emissions(ids), len(p["wo"]) // 2
    for row, n, scores in zip(ids, lengths, got):
        want = np.tile(p["bo"], (n, 1))
        for d, order, out in (("f", range(n), p["wo"][:size]), ("b", range(n - 1, -1, -1), p["wo"][size:])):
            h = c = np.zeros(size)
            for t in order:
                i, f, o, g = np.split(soft(np.concatenate([p["e"][row[t]], h]) @ p["w" + d] + p["b" + d]), 4)
                c = (1 + f) / 2 * c + (1 + i) / 2 * g
                h = (1 + o) / 2 * soft(c)
                want[t] += h @ out
        assert np.abs(scores[:n] - want).max() < 1e-4


def test_network_takes_less_time_than_its_tangents_would():
    """A network of tangents takes 200 of them a character, and in all over twice their time."""
    model, ids = pii.BiLSTMCRF.fresh(), np.random.default_rng(2).integers(1, pii.ALPHABET, (576, 128))
    x = np.random.default_rng(1).normal(0, 1, (200, ids.shape[0])).astype(np.float32)
    y, own, other = np.empty_like(x), [], []
    for _ in range(5):
        start = time.thread_time()
        model.emissions(ids)
        own.append(time.thread_time() - start)
        start = time.thread_time()
        for _ in range(ids.shape[1]):
            np.tanh(x, out=y)
        other.append(time.thread_time() - start)
    assert min(own) < 1.5 * min(other)


@pytest.fixture(scope="module")
def taught():
    """A network of the operator's own training, without documents of a table."""
    rng = random.Random(7)
    plain = [words(rng, 9)[: pii.WINDOW] for _ in range(300)]
    return pii.train([(t, np.zeros(len(t), np.int64)) for t in plain] + pii.planted(plain, 4000), steps=450), plain


#: Forms that training has none of.
UNTAUGHT = {"at": (" (AT) ",), "dot": (" . ", "[dot]"), "ip": (" (.) ",), "card": (" : ", " | "), "phone": ("({a})-{b}-{d}", "0{a}-{b}{d}")}


@pytest.mark.parametrize(("forms", "share"), [(pii.FORMS, 0.9), (UNTAUGHT, 0.5)])
def test_network_adds_what_the_base_misses(taught, forms, share):
    model, plain = taught
    windows = pii.planted(plain, 400, seed=99, forms=forms)
    texts = [t for t, _ in windows]
    base = [pii.base_spans(t) for t in texts]
    want = [[x for x in pii._decoded(own.astype(np.int8)) if all(x[2] <= a or x[1] >= b for s in found.values() for a, b in s)] for (_, own), found in zip(windows, base)]
    got = pii.added_spans(texts, base, model)
    right = sum(len(set(w) & set(g)) for w, g in zip(want, got))
    assert right >= share * sum(map(len, want)) > 100
    assert right >= 0.95 * sum(map(len, got))


def test_viterbi_and_its_bound_match_brute_force():
    rng = np.random.default_rng(4)
    model = pii.BiLSTMCRF.fresh()
    model.params["t"], model.params["s"] = rng.normal(0, 2, (pii.TAGS, pii.TAGS)), rng.normal(0, 2, pii.TAGS)
    many = [rng.normal(0, 2, (n, pii.TAGS)) - 9 * (n % 2) * (np.arange(pii.TAGS) > 0) for n in (1, 2, 3, 4, 3, 1)]
    for em, path in zip(many, model.viterbi(many)):
        score = lambda p: model.params["s"][p[0]] + sum(em[i, k] for i, k in enumerate(p)) + sum(model.params["t"][a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert tuple(path) == max(itertools.product(range(pii.TAGS), repeat=len(em)), key=score)
        assert not model.certain(em) or not path.any()


def test_runs_decode_to_the_path_of_the_whole():
    rng = np.random.default_rng(8)
    model = pii.BiLSTMCRF.fresh()
    model.params["t"], model.params["s"] = rng.normal(0, 1, (pii.TAGS, pii.TAGS)), rng.normal(0, 1, pii.TAGS)
    spans = read = 0
    for n in (1, 2, 7, 60, 300, 300):
        em = rng.normal(0, 2, (n, pii.TAGS)) - 14 * (np.arange(pii.TAGS) > 0) * (rng.random((n, 1)) < 0.97)
        path = np.zeros(n, np.int8)
        for a, b in model.open_runs(em):
            path[a:b] = model.viterbi([em[a:b]])[0]
            read += b - a
        assert path.tolist() == model.viterbi([em])[0].tolist()
        spans += (path > 0).sum()
    assert 0 < spans and read < 600


class Marks(pii.BiLSTMCRF):
    """An address begins at a capital and ends with its line, whatever is in it."""

    def emissions(self, ids):
        out = np.zeros((*ids.shape, pii.TAGS))
        out[..., 1] = np.where(ids == 3, 30.0, -60.0)
        out[..., 2] = np.where(ids == pii._CODES[10], -60.0, 3.0)
        out[..., 3:] = -60.0
        return out


def test_open_runs_have_the_scores_of_their_windows():
    rng = np.random.default_rng(9)
    model = Marks(pii.BiLSTMCRF.fresh().params)
    texts = ["".join(rng.choice(list("abc Q\n"), n, p=[0.3, 0.3, 0.2, 0.17, 0.01, 0.02])) for n in (1, 33, 511, 512, 513, 4000, 700)]
    runs = list(pii._open(texts, model))
    assert {i for i, _, _ in runs} >= {2, 3, 4, 5, 6}
    for i, (x, y), scores in runs:
        assert np.array_equal(scores, model.emissions(pii.codes(texts[i])[None])[0, x:y])


@pytest.mark.parametrize("piece", ["Qanna at example.com", "Q" + "a" * 60 + " (at) example.com", "Qanna(at)" + "b" * 300 + ".com", "Qanna\tat\texample\tdot\tcom"])
def test_every_character_is_read(monkeypatch, piece):
    model = Marks.fresh()
    model = Marks(model.params | {"t": np.zeros((pii.TAGS, pii.TAGS)), "s": np.zeros(pii.TAGS)})
    model.params["t"][:, 2], model.params["t"][1:3, 2] = -90.0, 0.0
    texts = ["", *["some plain words\n" * n + piece + "\n" + "other words\n" * m for n, m in ((0, 0), (1, 1), (40, 3), (2, 700))]]
    want = [[("email", t.index("Q"), t.index("Q") + len(piece))] if t else [] for t in texts]
    none = [{k: [] for k in pii.KINDS}] * len(texts)
    assert pii.added_spans(texts, none, model) == want
    monkeypatch.setattr(pii, "PIECE", 1500, raising=False)
    assert pii.added_spans(texts, none, model) == want


def test_long_stretches_of_digits_are_decoded_in_parts(taught):
    model, _ = taught
    card = "4111|1111|1111|1111"
    text = "see leaf 7 of bag ad " * 150 + f"bead {card} cab bag " + "see leaf 8 of bag ad " * 300
    assert max(b - a for a, b in pii.stretches(*pii.regions(text)[0])) == pii.LONG and len(pii.regions(text)) == 1
    [found] = pii.added_spans([text], [pii.base_spans(text)], model)
    assert ("card", text.index(card), text.index(card) + len(card)) in found


# ---- op6
def test_fingerprints_align_shifted_recordings(spark):
    rng = np.random.default_rng(8)
    notes = rng.normal(0, 0.2, (6, 64))
    shifted = np.concatenate([notes[1][16:], rng.normal(0, 0.2, 16)])
    rows = [(i * 100, v.tolist()) for i, v in enumerate([*notes, notes[0], shifted])] + [(901, None), (None, notes[2].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {r.id: r for r in media.align(media.fingerprints(media.render(df), "id", "audio"), F.col("id") % 100 == 0).collect()}
    assert out[600].class_id == 0 and {m.class_id for m in out[600].matches} == {0}
    assert {m.class_id for m in out[100].matches} == {100, 700} and out[901].matches is None and out[901].n_frames == 0
    assert all(m.offset != 0 for m in out[100].matches if m.class_id == 700)
    assert media.read_wav(b"nonsense")[1] == 0 and len(media.fingerprint(None)) == 0


def brute_matches(queries, classes):
    """All pairs and offsets, bit by bit."""
    out = {}
    for i, q in queries.items():
        for j, r in classes.items():
            for o in range(media.LEAST_FRAMES - len(r), len(q) - media.LEAST_FRAMES + 1):
                x, y = q[max(o, 0) :], r[max(-o, 0) :]
                n = min(len(x), len(y))
                e = int(np.bitwise_count((x[:n] ^ y[:n]).view(np.uint32)).sum()) / (32.0 * n)
                if n >= media.LEAST_FRAMES and e <= media.MOST_ERRORS:
                    out[i, j] = min(out.get((i, j), 1), e)
    return out


def print_rows(spark, prints):
    return spark.createDataFrame([(i, f.tolist()) for i, f in prints.items()], "id long, frames array<int>")


def test_noisy_copies_are_found_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(media, "BLOCK_FRAMES", 300)
    rng = np.random.default_rng(11)
    prints = {}
    for k in range(25):
        own = rng.integers(-(2**31), 2**31, int(rng.integers(8, 60))).astype(np.int32)
        prints[100 * k] = own
        for step, share in enumerate([0.1, 0.15, 0.2, 0.25]):  # errors spread evenly over the bits
            flips = np.packbits(rng.random((len(own), 32)) < share, axis=1).view(np.int32).ravel()
            noisy = own ^ flips
            prints[100 * k + 1 + step] = np.r_[rng.integers(-(2**31), 2**31, 5 * step).astype(np.int32), noisy[step:]]
    want = brute_matches({i: f for i, f in prints.items() if i % 100 == 0}, {i: f for i, f in prints.items() if len(f) >= media.LEAST_FRAMES})
    out = media.align(print_rows(spark, prints), F.col("id") % 100 == 0).filter("matches IS NOT NULL").collect()
    got = {(r.id, m.class_id): m.bit_errors for r in out for m in r.matches}
    assert got == pytest.approx(want, abs=1e-6) and len(want) > 75


def test_excerpts_of_a_second_occurrence_are_found(spark):
    rng = np.random.default_rng(12)
    part = lambda n: rng.integers(-(2**31), 2**31, n).astype(np.int32)
    loop, end = part(30), part(12)
    prints = {100: np.r_[loop, part(10), loop, end], 101: np.r_[loop, end], 201: np.r_[[7] * 20, part(9)].astype(np.int32)}
    prints[200] = prints[201][12:]
    out = media.align(print_rows(spark, prints), F.col("id") % 100 == 0).filter("matches IS NOT NULL").collect()
    got = {(r.id, m.class_id): (m.offset, m.votes, m.bit_errors) for r in out for m in r.matches}
    assert got == {(100, 100): (0, 81, 0.0), (100, 101): (40, 41, 0.0), (200, 200): (0, 16, 0.0), (200, 201): (-12, 16, 0.0)}


# ---- op7
def test_bpe_of_ascii_and_of_a_small_cache(monkeypatch):
    own = bpe.SegmentTreeBPE(bpe.tokenizer_spec())
    rng = random.Random(12)
    texts = ["".join(rng.choice("abstrevmld \t\n\x0b\x0c\x1c\x1f\x00\x7f019.,!-'ST") for _ in range(rng.randrange(80))) for _ in range(3000)]
    assert own.ascii_pieces
    for t in texts:
        assert own.ascii_pieces.findall(t.lower()) == own.pieces.findall(t.lower())
    first = own.joined_batch(["the cat sat", "zqx"])
    monkeypatch.setattr(bpe._Pieces, "LIMIT", 40)
    for k in range(0, 300, 10):
        batch = ["the cat sat", *texts[k : k + 10]]
        learnt, encode = [], own.encode_word
        monkeypatch.setattr(own, "encode_word", lambda w: learnt.append(w) or encode(w))  # noqa: B023
        assert own.joined_batch(batch)[0] == first[0]
        monkeypatch.setattr(own, "encode_word", encode)
        assert k == 0 or not {"the", "cat", "sat"} & set(learnt)
    fresh = bpe.SegmentTreeBPE(own.spec)
    assert own.joined_batch(texts[:50]) == [fresh.joined(t) for t in texts[:50]]


def test_bpe_matches_the_library(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    ref.no_truncation()
    ref.no_padding()
    rng = random.Random(7)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xC0, 0x500), 0x3A3, rng.randrange(0x4E00, 0x5000), 10])) for _ in range(rng.randrange(60))) for _ in range(600)]
    texts += ["it's <|endoftext|> we'll", "ΣΑΣ İstanbul", "antidisestablishmentarianism " * 20, *[t for t in ODD if t is not None]]
    own = bpe.SegmentTreeBPE(bpe.tokenizer_spec())
    joined = own.joined_batch(texts)
    for t, (ids, decoded) in zip(texts, joined):
        want = ref.encode(t, add_special_tokens=False).ids
        assert [int(i) for i in ids.split()] == want == own.encode(t) and decoded == ref.decode(want, skip_special_tokens=False)
    some = ["antidis", "x", "hello", "zzzzzzzzzzzzzzzzz"] * 100
    assert own.encode_words(some) == [own.encode_word(w) for w in some]
    out = {r.doc_id: r for r in bpe.encode_documents(frame(spark, [*texts, None], [*range(len(texts)), None]), with_ids=True).collect()}
    assert out[None].n_tokens == 0 and out[None].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert all(out[i].ids == own.encode(t) for i, t in enumerate(texts[:50]))


# ---- op8
def shingle_strings(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(shingles._LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(ids, texts):
    sets = [shingle_strings(t) for t in texts]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    least = collections.defaultdict(list)
    for i in range(len(ids)):
        least[find(i)].append(ids[i])
    return [(len(s), min(least[find(i)])) for i, s in enumerate(sets)]


@pytest.mark.parametrize("block", [2000, 7])
def test_components_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(9)
    base = [words(rng, 80).split() for _ in range(5)]
    texts = []
    for _ in range(150):
        own = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 3, 4, 6])):
            own[rng.randrange(len(own))] = words(rng, 1)
        texts.append(" ".join(own))
    texts += [texts[0].upper(), *[t for t in ODD], "one two", "one  two\n", "one two three four five six"]
    ids = rng.sample(range(10000), len(texts))
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, texts, ids)).collect()}
    want = brute_components(ids, texts)
    assert got == {i: (n, c, i == c) for i, (n, c) in zip(ids, want)}


def test_near_duplicates_of_odd_rows(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    out = minhash.near_duplicates(frame(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None], [None, 5, 5, None])).collect()
    assert sorted((str(r.id), str(r.component_id), r.kept) for r in out) == [("5", "5", True), ("5", "5", True), ("None", "5", False), ("None", "None", False)]


def test_near_copies_with_null_ids_link(spark):
    base = [f"w{i}" for i in range(80)]
    middle = [*base[:72], *(f"x{i}" for i in range(8))]  # near both others, which are less than 0.75 alike
    far = [*(f"y{i}" for i in range(8)), *middle[8:]]
    texts = [" ".join(x) for x in (base, middle, far)] + ["wholly other words without any copy at all", "single"]
    sets = [shingle_strings(t) for t in texts[:3]]
    like = lambda a, b: len(a & b) / len(a | b)
    assert like(sets[0], sets[1]) >= 0.75 <= like(sets[1], sets[2]) and like(sets[0], sets[2]) < 0.75
    out = minhash.near_duplicates(frame(spark, texts, [3, None, 8, None, 9])).collect()
    got = sorted((str(r.id), str(r.component_id), r.kept) for r in out)
    assert got == [("3", "3", True), ("8", "3", False), ("9", "9", True), ("None", "3", False), ("None", "None", False)]
    out = minhash.near_duplicates(frame(spark, texts[:2], [None, None])).collect()
    assert [(r.component_id, r.kept) for r in out] == [(None, False)] * 2


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    sets = [np.unique(a), np.unique(np.r_[a[:240], rng.integers(0, 1 << 62, 60).astype(np.uint64)]), a[:1], a[:0]]
    s = shingles.fast_similarity_sketch(sets, 400)
    assert (s[:3] != np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.1


def test_connected_components(spark):
    rng = random.Random(10)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert {n: c for n, c in got.items()} == {n: find(n) for n in root if n in got}
    assert all(find(n) == n for n in root if n not in got)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- op9
@pytest.mark.parametrize("n", [0, 1, 23, 500])
def test_shards_hold_every_row_once(spark, n):
    rng = random.Random(n)
    texts = [words(rng, rng.randrange(60)) for _ in range(n)]
    texts[:6] = [None, "", "é", "x", "x", "x"][:n]
    ids = [None, *range(1, n)] if n else []
    out = sharding.assign_shards(sharding.shuffled_buckets(frame(spark, texts, ids), bucket_bytes=4000), 24).collect()
    assert collections.Counter((r.id, r.text, r.size) for r in out) == collections.Counter((i, t, len((t or "").encode()) + 8) for i, t in zip(ids, texts))
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(k, [])) for k in range(24)]
    assert not n or max(sizes) - min(sizes) <= 1
    assert n < 500 or [r.id for r in sorted(out, key=lambda r: (r.shard, r.slot))] != sorted(i or 0 for i in ids)


def test_shards_repeat(spark):
    docs = frame(spark, [str(i) * 50 for i in range(200)])
    runs = [sorted((r.id, r.shard, r.slot) for r in sharding.assign_shards(sharding.shuffled_buckets(docs, bucket_bytes=3000), 5).collect()) for _ in range(2)]
    assert runs[0] == runs[1]


def test_repeated_ids_and_rows_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = [(None, "x" * 50)] * 200 + [(1, "y" * 50)] * 100 + [(2, str(i).zfill(50)) for i in range(200)] + [(i, "z" * 50) for i in range(10, 110)]
    out = sharding.shuffled_buckets(frame(spark, [t for _, t in rows], [i for i, _ in rows]), bucket_bytes=3000).collect()
    assert collections.Counter((r.id, r.text) for r in out) == collections.Counter(rows)
    sizes = collections.Counter()
    for r in out:
        sizes[r.bucket] += r.size
    assert max(sizes.values()) < 2 * 3000


# ---- op10
@pytest.mark.parametrize("chunk", [1 << 18, 7])
def test_warc_round_trip(spark, monkeypatch, tmp_path, chunk):
    pages = ["<p>a</p>", "WARC/1.1\r\n\r\n", "", None, "é" * 40, "é" * 40, "<p>a</p>", "x" * 3000, "<p>a</p>"]
    rows = [(i, None if i == 2 else f"http://h/{i}\n", h, 1) for i, h in enumerate(pages)] + [(None, "u", "<p>a</p>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    path = f"file://{tmp_path}/w"
    chunks = warc.chunk_rows(warc.plan_records(df, "page_id", "url", "html"), chunk)
    files = warc.written(warc.write_warc(chunks, path), "m")
    back = warc.read_warc(files, path, chunk).collect()
    assert all(len(r.data) <= chunk for r in back)
    bodies, last = collections.defaultdict(bytes), {}
    for r in sorted(back, key=lambda r: r.chunk_no):
        bodies[r.file, r.record_no] += bytes(r.data)
        if r.last:
            last[r.file, r.record_no] = r
    assert len(last) == len(rows)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    for key, r in last.items():
        if r.row_id == "null":
            assert r.record_type == "response"
            continue
        i = int(r.row_id)
        same = [j for j, h in enumerate(pages) if (h or "") == (pages[i] or "")]
        assert r.record_type == ("response" if i == max(same) else "revisit") and r.refers_to == (None if i == max(same) else str(max(same)))
        assert r.stated_digest == sha(pages[i]) and r.stated_length == len((pages[i] or "").encode())
        if r.record_type == "response":
            assert bodies[key] == (pages[i] or "").encode() and r.digest_so_far == sha(pages[i])
    assert warc.archive(df.limit(0), f"{path}2").count() == 0


def test_warc_matches_sql(spark, sf_dir):
    import duckdb

    from sparkloom.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf_dir}/pages.parquet')")
    got = warc.op10_warc(spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.WARC})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
