"""The registered corpus queries, by their own columns, against SQL, the library or plain computations."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest

from sparkloom.llm import bpe, decontamination, media, pii, queries
from sparkloom.llm.common import spread, table

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}


@pytest.fixture(scope="module")
def small_dir(spark, tmp_path_factory):
    """Documents with odd rows: nulls, empty and repeated texts, extra columns."""
    where = tmp_path_factory.mktemp("small")
    rng = random.Random(8)
    line = lambda n: " ".join(rng.choice("ab cd ef gh ij kl mn op".split()) for _ in range(n))
    same = line(90)
    rows = [line(rng.randrange(1, 120)) for _ in range(20)] + [None, "", " ", same, same, same + " end", "mail a.b@c.de or (at) +49 30 123456 at 10.0.0.1", "İΣς 漢字 <eos> x" * 3]
    docs = spark.createDataFrame([(i, t, "en", "s", None, "extra", 1) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, label string, leaks int")
    docs.coalesce(2).write.parquet(f"{where}/documents.parquet")
    return str(where)


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op8_minhash"])
@pytest.mark.parametrize("where", ["sf", "small"])
def test_match_sql(spark, sf_dir, small_dir, name, where):
    at = sf_dir if where == "sf" else small_dir
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{at}/documents.parquet{'' if where == 'sf' else '/*.parquet'}')")
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, QUERIES[name](spark, at).select(*names).collect())) == sorted(want.fetchall())


def test_op2_columns(spark, sf_dir, texts):
    bench = {r.item_id: decontamination.words(r.text) for r in table(spark, sf_dir, "benchmark").collect()}
    rows = QUERIES["op2_decontamination"](spark, sf_dir).collect()
    assert rows and rows[0].asDict().keys() == {"doc_id", "item_id", "distance", "start_word", "end_word"}
    for r in rows:
        own = decontamination.words(texts[r.doc_id])[r.start_word : r.end_word]
        assert decontamination.myers(bench[r.item_id], own)[0] <= r.distance <= decontamination.budget(len(bench[r.item_id]))
        assert abs(len(own) - len(bench[r.item_id])) <= r.distance


def test_op5_columns(spark, small_dir, monkeypatch):
    train = pii.train
    monkeypatch.setattr(pii, "train", lambda windows: train([]))
    rows = QUERIES["op5_pii"](spark, small_dir).collect()
    docs = {r.doc_id: r.text for r in table(spark, small_dir, "documents").collect()}
    for r in rows:
        base = pii.base_spans(docs[r.doc_id] or "")
        said = ",".join(f"{k}:{a}:{b}" for k in pii.KINDS for a, b in base[k])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(base[k]) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.spans == said
    assert len(rows) == len(docs) and sum(r.n_email + r.n_ip + r.n_phone for r in rows) == 3


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    return lib


def test_op7_columns(spark, small_dir):
    lib, docs = library(), {r.doc_id: r.text for r in table(spark, small_dir, "documents").collect()}
    rows = QUERIES["op7_bpe"](spark, small_dir).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = lib.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))
    assert len(rows) == len(docs)


def test_op7_on_every_code_point():
    lib, own = library(), bpe.SegmentTreeBPE(bpe.tokenizer_spec())
    points, wrong = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000], []
    for at in range(0, len(points), 8192):
        some = [f"a{chr(c)}b {chr(c)}7" for c in points[at : at + 8192]]
        theirs = lib.encode_batch(some, add_special_tokens=False)
        wrong += [hex(ord(t[1])) for t, ours, got in zip(some, own.joined_batch(some), theirs) if ours[0] != " ".join(map(str, got.ids))]
    assert not wrong


def test_op7_on_long_words_and_an_empty_table(spark):
    lib, own = library(), bpe.SegmentTreeBPE(bpe.tokenizer_spec())
    for text in ("ab" * 20_000, "7" * 3000, "-" * 3000, "é" * 3000):
        assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids
    assert bpe.encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("parts", [3, 7, 211])
def test_op9_columns(spark, small_dir, parts):
    docs = {r.doc_id: r.text for r in table(spark, small_dir, "documents").collect()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = []
    try:
        for n in (4, parts):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows.append(sorted(map(tuple, QUERIES["op9_external_shuffle"](spark, small_dir).repartition(n).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows[0] == rows[1]  # the seed alone decides
    slots = collections.defaultdict(list)
    for doc_id, size, crc, law, shard, slot, grown in rows[0]:
        data = (docs[doc_id] or "").encode()
        assert (size, crc, law, grown) == (len(data) + 8, zlib.crc32(data), "rows", None) and 0 <= shard < 24
        slots[shard].append(slot)
    assert len(rows[0]) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op6_rows(spark, tmp_path):
    """Queries find their own class and noisy relatives; null, short, repeated and unnamed vectors have their rows."""
    rng = random.Random(5)
    vectors = [[rng.gauss(0, 0.2) for _ in range(64)] for _ in range(6)]
    near = [x + rng.gauss(0, 0.001) for x in vectors[0]]
    rows = [(0, vectors[0]), (1, vectors[1]), (100, vectors[2]), (7, near), (8, vectors[0]), (8, vectors[0]), (200, None), (300, [0.1]), (None, vectors[3])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op6_chroma"](spark, str(tmp_path)).collect()
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r.vec_id].append(r)
    assert len(got) == len(rows) and len(by_id[8]) == 2 and all(r.class_id == by_id[0][0].class_id for r in by_id[8])
    assert by_id[0][0].matches[0].bit_errors == 0 and by_id[0][0].matches[0].offset == 0
    assert by_id[7][0].class_id in {m.class_id for m in by_id[0][0].matches}
    assert by_id[200][0].matches == [] and by_id[300][0].matches == [] and by_id[1][0].matches is None
    spark.createDataFrame([], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert QUERIES["op6_chroma"](spark, f"{tmp_path}/none").count() == 0


def test_ties_between_offsets_take_the_most_frames_then_the_nearest():
    import numpy as np

    held = np.full(40, 12345, np.int32)  # a held note agrees at every offset
    [(q, c, offset, votes, errors)] = media.best_offsets([held], [held])
    assert (q, c, offset, votes, errors) == (0, 0, 0, 39, 0.0)


def test_spans_text_is_parsed_back(spark, small_dir):
    """What op5 says of spans points into the texts."""
    docs = {r.doc_id: r.text for r in table(spark, small_dir, "documents").collect()}
    found = [s for r in pii.find_pii(table(spark, small_dir, "documents"), pii.train([])).collect() for s in r.found if re.search("[0-9@]", docs[r.doc_id][s.start : s.end])]
    assert len(found) == 3


def test_small_scans_are_dealt_over_the_cores(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spread(spark.read.parquet(f"{tmp_path}/one"))
    assert one.rdd.getNumPartitions() == cores and sorted(r.id for r in one.collect()) == [*range(100)]
    many = spark.range(0, 100, 1, cores + 1)
    assert spread(many) is many
