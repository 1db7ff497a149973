"""Stages of the pipeline against brute force on a small fixture."""

import random

from conftest import frame, sentence

import corpus_pipeline as pipeline


def corpus(spark, folder):
    rng = random.Random(12)
    footer = "this same footer line ends a great many pages"
    item = sentence(rng, 30, 2000)
    texts = [sentence(rng, rng.randint(60, 120), 2000) for _ in range(120)]
    for i in range(0, 20, 2):
        texts[i] += "\n" + footer + ("" if i % 4 else ".")
    texts[31] = texts[30]
    texts[33] = texts[32] + " tail"
    texts[40] = texts[40] + " " + item
    texts += [None, "", texts[50]]
    toxic = [sentence(rng, 60, 2000) + " vile rotten scum" for _ in range(60)]
    docs = frame(spark, texts + toxic).select("doc_id", "text", "lang", "source", "n_chars")
    n = len(texts)
    labels = [(i, 1, int(i >= n)) for i in range(n + 60)]
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, toxic, footer


def test_stages(spark, tmp_path):
    texts, toxic, footer = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{k}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    n = len(texts)
    assert kept["toxicity"].keys() == set(range(n))
    # of ten footers the first stays
    lines = kept["line_dedup"]
    assert [i for i in lines if footer in (lines[i] or "")] == [0]
    assert lines.keys() == set(range(n)) and lines[2] == texts[2].split("\n")[0]
    assert kept["near_duplicates"].keys() == set(range(n)) - {31, 33, n - 1}
    assert kept["decontamination"].keys() == kept["near_duplicates"].keys() - {40}
    assert kept["mixing"].keys() <= kept["decontamination"].keys()
    whole = pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in whole.collect()} == kept["mixing"].keys()


def test_stages_on_empty_tables(spark, tmp_path):
    corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0, name


def test_lines_that_occur_twice_go(spark):
    rng = random.Random(13)
    own = [sentence(rng, 70, 2000) for _ in range(6)]
    passage = sentence(rng, 50, 2000)
    texts = [own[0] + "\n" + passage, own[1] + "\n" + passage, own[2], own[3] + "\n" + passage + "s"]
    texts += [texts[1], texts[2]]
    docs = frame(spark, texts)
    got = {r["doc_id"]: r["text"] for r in pipeline.drop_repeated_lines(spark, docs, "").collect()}
    # whole copies (4 of 1, 5 of 2) are left to the next stage, as their first is
    assert got == {0: texts[0], 1: own[1], 2: own[2], 3: own[3], 4: own[1], 5: own[2]}
    left = pipeline.drop_near_duplicates(spark, spark.createDataFrame(list(got.items()), "doc_id long, text string"), "")
    assert {r["doc_id"] for r in left.collect()} == {0, 1, 2, 3}


def test_nothing_is_toxic_without_labels_or_terms(spark, tmp_path):
    rng = random.Random(14)
    texts = [None, "", " \n", "... !", *(sentence(rng, 20) for _ in range(40))]
    docs = frame(spark, texts)
    kinds = {"none": [], "null": [(i, 1, None) for i in range(44)], "one": [(i, 1, 1) for i in range(44)]}
    # most labelled texts are toxic, so the bias alone says toxic
    kinds["most"] = [(i, 1, int(i % 10 > 0)) for i in range(4, 44)]
    for name, rows in kinds.items():
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        kept = {r["doc_id"] for r in pipeline.drop_toxic(spark, docs, f"{tmp_path}/{name}").collect()}
        assert kept >= {0, 1, 2, 3}, name
        assert name == "most" and len(kept) < 44 or len(kept) == 44, name
