"""The pipeline's stages: what each keeps and changes, on a small table."""

from pyspark.sql import functions as F

import corpus_pipeline as pipeline


def test_stages_keep_the_columns_and_clean_documents(spark, tmp_path):
    base = "the quick brown fox jumps over the lazy dog while seven wizards watch from a tall tower near the silver sea".split()
    item = "which planet of the solar system has the largest number of known moons today answer saturn by count".split()
    texts = {0: " ".join(base), 1: " ".join([*base[:-1], "see"]), 2: "entirely other words that have nothing in common with any of the texts before them", 3: " ".join([*"some words then".split(), *item, *"and more".split()]), 4: "write to a.b@mail.example.com now", 5: None, 6: "", 7: None}
    for i in range(8, 60):
        texts[i] = f"document {i} " + " ".join(f"w{i}x{k}" for k in range(12)) + (" grobnik" if i % 3 == 0 else "")
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(8, 60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for name, stage in pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == pipeline.COLUMNS, name
        ids.append({r.doc_id for r in left.select("doc_id").collect()})
    clean = {i for i in range(8, 60) if i % 3}
    assert ids[0] == {*range(8)} | clean
    assert ids[1] == ids[0] - {1} and ids[2] == ids[1] - {3} and ids[3] == ids[2]
    text = {r.doc_id: (r.text, r.n_chars) for r in left.collect()}
    assert text[4] == ("write to [EMAIL] now", 20) and text[5] == (None, None) and text[2][0] == texts[2]
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() == len(ids[3]) and out.filter(F.col("doc_id") == 6).first().n_tokens == 0


def test_near_duplicates_go_by_row_with_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(40))
    near = lambda k: text(k)[:-1] + "x"
    rows = [(None, text("a")), (None, text("b")), (None, near("b")), (None, None), (None, ""), (None, text("f")), (8, near("f"))]  # null ids
    rows += [(5, text("c")), (3, near("c")), (5, text("d")), (6, text("e")), (6, text("e")), (7, None), (7, None)]  # repeated ids
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = [(r.doc_id, r.text) for r in pipeline.drop_near_duplicates(spark, docs, "").collect()]
    of_b = [x for x in left if x[1] in (text("b"), near("b"))]
    assert len(of_b) == 1
    want = [(None, text("a")), (None, None), (None, ""), (8, near("f")), (3, near("c")), (5, text("d")), (6, text("e")), (7, None), (7, None)]
    assert sorted(map(str, left)) == sorted(map(str, want + of_b))
