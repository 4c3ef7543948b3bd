"""The pipeline's stages on a table with planted cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import orderminhash, seedextend


def planted(spark, path):
    r = random.Random(9)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("ran", "sel", "tor", "ing", "ment", "ous")]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n)) + "."
    passage = prose(70)
    rows = [(i, prose(r.randint(80, 200)), "en", f"s{i % 4}") for i in range(60)]
    rows += [(100, rows[3][1], "en", "s0"), (101, rows[4][1].replace("karan", "kasel", 3), "en", "s1"), (102, prose(30) + " " + passage, "en", "s2"), (103, passage + " " + prose(40), None, "s3"), (104, "12 34 !!", "en", "s0"), (105, None, "en", None), (106, "", None, None), (100, rows[3][1], "en", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return {d: t for d, t, _, _ in rows}


def test_stages(spark, tmp_path):
    texts = planted(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns
        seen.append({r["doc_id"]: r for r in docs.collect()})
        if name == "near_duplicates":
            assert docs.count() == len(seen[-1])
    spoken, unique, cleaned, _ = seen
    assert set(texts) - set(spoken) == {104, 105, 106}
    assert set(spoken) - set(unique) == {100, 101}
    assert len(cleaned[103]["text"].split()) == len(texts[103].split()) - 70 and cleaned[103]["n_chars"] == len(cleaned[103]["text"])
    assert all(cleaned[d]["text"] == texts[d] for d in cleaned if d != 103)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert tokens.count() == docs.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_empty_table(spark, tmp_path):
    planted(spark, str(tmp_path / "a"))
    docs = spark.read.parquet(f"{tmp_path}/a/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path / "a"))
        assert docs.count() == 0
    assert orderminhash.THRESHOLD == 0.8 and orderminhash.WORDS == 5 and seedextend.WINDOW == 50


CLASHING = ["row", "id", "content", "nth", "copies", "spans", "hash", "void", "rep_key", "rep_hash", "rep_spans", "mix_key", "mix_nth", "mix_copy", "plan_key", "plan_copies", "kept_key", "kept_content", "kept_nth", "key", "size", "lang_pred", "c0", "word"]


@pytest.mark.parametrize("stage", range(4))
def test_clashing_names_are_carried_along(spark, tmp_path, stage):
    planted(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id < 110")
    wide = docs.withColumns({x: F.concat(F.lit(x), F.col("doc_id")) for x in CLASHING})
    (_, run), columns = corpus_pipeline.STAGES[stage], docs.columns
    got = run(spark, wide, str(tmp_path))
    assert got.columns == wide.columns
    rows = got.collect()
    assert all(r[x] == f"{x}{r['doc_id']}" for r in rows for x in CLASHING)
    assert sorted(tuple(r[c] for c in columns) for r in rows) == sorted(map(tuple, run(spark, docs, str(tmp_path)).collect()))


def test_a_corpus_without_labels_passes(spark, tmp_path):
    planted(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()} == {104, 105, 106}
