from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomstead.operators import corpus, impacts

WORDS = [f"{a}{b}{c}" for a in "bdk" for b in "aeiou" for c in ("n", "na", "nar", "st", "ste")]


def texts(spark, n: int, seed: int):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choices(WORDS, [1 / (j + 1) for j in range(len(WORDS))], k=r.choice([1, 3, 12, 60])))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "a b ?"), (n + 3, "ban " * 5000), (n + 4, "ban den best"), (n + 5, "ban den best")]
    return spark.createDataFrame(rows, "doc_id long, text string")


ASKED = [(0, "ban"), (1, "ban best dist"), (2, "kunar bonar"), (3, "xyz"), (4, "a ?"), (5, None), (6, "bustes kan kan"), (7, "dan den din don dun bes")]


@pytest.mark.parametrize(("n", "k"), [(0, 10), (8, 10), (900, 1), (900, 10)])
def test_best_equals_the_full_sum(spark, n, k):
    docs, asked = texts(spark, n, n + k), spark.createDataFrame(ASKED, "qid long, query string")
    want = corpus.bm25(corpus.inverted_index(docs, "doc_id", "text"), asked, "doc_id", k)
    got = impacts.best(impacts.index_of(docs, "doc_id", "text"), asked, k)
    assert got.columns == ["qid", "doc_id", "score", "rank"]
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.select("qid", "doc_id", "score", "rank").collect()))
    assert {q for q, *_ in rows} <= {0, 1, 2, 6, 7}


def test_more_words_than_a_broadcast_takes(spark):
    docs, asked = texts(spark, 60, 2), spark.createDataFrame(ASKED, "qid long, query string")
    index = impacts.index_of(docs, "doc_id", "text")
    few, many = (sorted(map(tuple, impacts.ask(index, asked, limit).hits.select("prefix", "doc_id", "impact").collect())) for limit in (100, 0))
    assert few == many and few


def test_nothing_to_search_and_nothing_asked(spark):
    docs, asked = texts(spark, 20, 1), spark.createDataFrame(ASKED, "qid long, query string")
    assert impacts.best(impacts.index_of(docs.limit(0), "doc_id", "text"), asked).count() == 0
    assert impacts.best(impacts.index_of(docs, "doc_id", "text"), asked.limit(0)).count() == 0


def test_bands_that_can_not_matter_stay_unread(spark):
    """A rare word and one that all documents have: of the latter's postings few are wanted, and none that matters is left out."""
    r = random.Random(4)
    rows = [(i, " ".join(["common"] * r.randint(1, 9) + ["filler"] * r.randint(1, 60) + ["rare"] * (i % 100 == 7))) for i in range(3000)]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, "rare common")], "qid long, query string")
    index = impacts.index_of(docs, "doc_id", "text")
    found = impacts.ask(index, asked)
    assert (index.documents, found.heads.agg(F.sum("n")).first()[0]) == (3000, found.hits.count())
    floor = impacts.floors(impacts.sums(found, impacts.first_bands(found, 10), "doc_id"), 10, found.terms)
    leveled = impacts.levels(found.terms, floor)
    read = {x.prefix: x.n for x in impacts.wanted_bands(leveled, found.heads).groupBy("prefix").agg(F.sum("n").alias("n")).collect()}
    assert 10 <= read["rare"] <= 30 and read.get("common", 0) < 300
    # what is left out adds up to no more than the floor
    assert all(x.cut <= x.most + 1e-12 for x in leveled.collect())
    assert abs(leveled.first().bound - floor.first().floor) < 1e-9


def rows_of(df):
    return sorted(map(tuple, df.select("qid", "doc_id", "score", "rank").collect()))


def test_blocks_and_bands_agree_and_pairs_are_not_shuffled(spark, monkeypatch):
    """Many queries of common words: what goes from the blocks into the ranking is k rows of a query and task, not its hits."""
    from loomstead.operators import blocks

    for name, small in (("DOCUMENTS", 150), ("COUNTS", 2000), ("ROWS", 40), ("QUERIES", 30), ("BROADCAST_PARTS", 1)):
        monkeypatch.setattr(blocks, name, small)
    r = random.Random(8)
    docs = texts(spark, 500, 8).repartition(3)
    asked = spark.createDataFrame([(i, " ".join(r.choices(WORDS[:20], k=4))) for i in range(100)], "qid long, query string")
    index, seen = impacts.index_of(docs, "doc_id", "text"), []
    met = blocks._met

    def counted(k, mean):
        run, total = met(k, mean), spark.sparkContext.accumulator(0)
        seen.append(total)

        def go(batches):
            for b in run(batches):
                total.add(b.num_rows)
                yield b

        return go

    monkeypatch.setattr(blocks, "_met", counted)
    got = rows_of(impacts.best(index, asked, 5))
    want = rows_of(corpus.bm25(corpus.inverted_index(docs, "doc_id", "text"), asked, "doc_id", 5))
    assert got == want == rows_of(impacts.best(index, asked, 5, limit=0))
    hits = impacts.sums(found := impacts.ask(index, asked), found.terms.join(found.heads, "prefix"), "doc_id").count()
    assert len(got) == 500 and seen[0].value < hits / 2


def test_a_score_that_rounds_to_nothing_and_ties_by_key(spark):
    docs = spark.createDataFrame([(i, "same word") for i in range(40, 0, -1)] + [(50, "other")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "same"), (2, "other same")], "qid long, query string")
    assert [x[1] for x in rows_of(impacts.best(impacts.index_of(docs, "doc_id", "text"), asked, 3))] == [1, 2, 3, 1, 2, 50]
