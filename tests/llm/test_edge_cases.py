"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from gleaner.llm.cascade import cascade
from gleaner.llm.decontaminate import contaminated, without_leaks
from gleaner.llm.exactdedup import remove_repeats
from gleaner.llm.linededup import near_lines, without_lines
from gleaner.llm.lm import lm_scores
from gleaner.llm.minhash import near_duplicates
from gleaner.llm.queries import mixed
from gleaner.llm.quality import quality
from gleaner.llm.toxicity import toxicity
from gleaner.llm.urllists import filter_captures

PER_ROW = {
    "lm": lambda d, labels: lm_scores(d),
    "mixing": lambda d, labels: mixed(d),
    "exact": lambda d, labels: remove_repeats(d),
    "minhash": lambda d, labels: near_duplicates(d, shingle=2),
    "toxicity": toxicity,
    "quality": lambda d, labels: quality(d, labels, epochs=1),
    "cascade": lambda d, labels: cascade(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_every_row(odd_docs, labels, name):
    out = PER_ROW[name](odd_docs, labels)
    ids = lambda d: sorted((r[0] for r in d.select("doc_id").collect()), key=repr)
    assert ids(out) == ids(odd_docs)


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(no_docs, labels, name):
    assert PER_ROW[name](no_docs, labels).count() == 0


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_lm_of_empty_texts_is_the_end_alone(odd_docs):
    got = rows(lm_scores(odd_docs))
    assert [got[i]["n_tokens"] for i in (0, 1, 2, None)] == [1, 1, 1, 1]
    assert got[3]["score"] == got[4]["score"] < 0


def test_exact_dedup_of_repeats(odd_docs):
    got = rows(remove_repeats(odd_docs))
    assert got[0]["n_bytes"] == got[1]["n_bytes"] == 0
    assert got[3]["n_removed"] == 0  # its repeated row is the same document
    assert got[4]["n_removed"] == got[4]["n_bytes"] and got[4]["n_spans"] == 1
    assert got[9]["n_removed"] > 0  # it repeats itself


def test_minhash_of_repeats(odd_docs):
    got = rows(near_duplicates(odd_docs, shingle=2))
    assert [got[i]["n_shingles"] for i in (0, 1, 2, 7, 8)] == [0, 0, 0, 1, 1]
    assert [got[i]["component_id"] for i in (0, 1, 2, 3, 4, 10)] == [0, 1, 2, 3, 3, 3]
    assert got[None]["component_id"] is None and got[None]["kept"]


def test_scores_without_labels_are_neutral(odd_docs, labels):
    none = labels.limit(0)
    assert {r["score"] for r in toxicity(odd_docs, none).collect()} == {0.5}
    assert all(abs(r["score"] - 0.5) < 1e-6 for r in quality(odd_docs, none).collect())


def test_lines_of_odd_documents(odd_docs, no_docs):
    lines = near_lines(odd_docs)
    got = {(r["doc_id"], r["line_no"]): r for r in lines.collect()}
    assert got[(0, 0)]["kept"] and got[(1, 0)]["n_chars"] == 0
    assert got[(3, 0)]["kept"] and not got[(4, 0)]["kept"]
    left = without_lines(odd_docs, lines)
    assert left.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in left.where("doc_id is not null").collect()) == [0, 1, 2, 3, 3, 5, 6, 7, 8, 9, 10]
    assert near_lines(no_docs).count() == 0


def test_contamination_of_odd_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one"), (2, None), (None, "a b"), (3, ""), (1, "one")], "item_id long, text string")
    hits = contaminated(odd_docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in hits} == {(7, 1)}
    assert contaminated(odd_docs, items.limit(0)).count() == 0
    assert contaminated(no_docs, items).count() == 0
    named = odd_docs.withColumn("hits", F.lit("mine")).withColumn("item_id", F.lit(5))
    left = without_leaks(named, items)
    assert left.columns == named.columns and {r["hits"] for r in left.collect()} == {"mine"}
    gone = named.exceptAll(left).collect()
    assert [r["doc_id"] for r in gone] == [7] and left.where("doc_id is null").count() == 1
    assert without_leaks(named, items.limit(0)).count() == named.count() and without_leaks(no_docs, items).count() == 0


def test_url_lists_of_odd_tables(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.b.com/x/y", "2020-05-05", "l"), (1, "http://a.b.com/x/y", "2020-05-05", "l"), (2, None, "2020-05-05", "l"),
         (3, "nonsense", "2020-05-05", "l"), (4, "http://b.com", None, "l"), (5, "", "2020-01-01", "l")],
        "page_id long, url string, fetched_on string, lists string",
    ).withColumn("fetched_on", F.to_date("fetched_on"))
    entries = spark.createDataFrame(
        [("ads", "domain", "B.com", "add", "2020-01-01"), ("ads", "domain", "b.com", "add", "2020-02-01"),
         ("adult", "prefix", "http://a.b.com/x/", "add", "2020-05-05"), ("off", "host", "a.b.com", "add", "2020-05-05"),
         ("off", "host", "a.b.com", "remove", "2020-05-05"), (None, "host", "a.b.com", "add", "2019-01-01"),
         ("late", "host", "a.b.com", "add", "2020-05-06"), ("odd", "port", "80", "add", "2020-01-01")],
        "list_name string, kind string, pattern string, action string, entry_date string",
    )
    pages = pages.withColumn("key", F.lit("k")).withColumn("year", F.lit(1)).withColumn("list_name", F.lit("x"))
    # intervals met where the keys are made, and intervals too many for that
    for options in ({}, {"broadcast_bytes": 0}):
        got = [(r["page_id"], r["lists"], r["blocked"]) for r in filter_captures(pages, entries, **options).collect()]
        assert sorted(got) == sorted([(1, ["ads", "adult"], True)] * 2 + [(i, [], False) for i in (2, 3, 4, 5)])
    assert "key" in filter_captures(pages, entries).columns
    assert filter_captures(pages.limit(0), entries).count() == 0
    assert not any(r["blocked"] for r in filter_captures(pages, entries.limit(0)).collect())
