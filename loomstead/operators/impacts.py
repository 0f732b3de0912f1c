"""The best k by BM25 without adding up all hits of all queries: hits in bands of impact, and thresholds that each query sets itself.

The impact of a hit is its part of a BM25 score without the idf. A query word is a prefix and counts as one term, whose documents are
those of all its tokens; so the tokens' postings are brought together first, once for a prefix whatever the number of queries that ask
for it, and dealt into bands of impact. Of each prefix and band the number of hits and the largest impact are kept (heads). Then
three passes, the uniform-threshold scheme for distributed top-k (Cao and Wang, 2004), with the threshold filled up like water in a
vessel of several depths:
1. The first bands of each of its words give a query k documents, and so a score that its k-th is not below.
2. Only bands that may hold a larger part than the query's level are taken: a document whose parts are all smaller can't reach that
   score, as the parts, each at most the level and the word's largest, add up to it. What is found has a least and a largest score.
3. Documents whose largest score reaches the k-th least one are scored in full.
Scores and ranks are those of `corpus.bm25`: all documents are judged, none is left out by the bands.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions.text import fold, tokens
from loomstead.operators import blocks
from loomstead.operators.corpus import K1, B, inverted_index
from loomstead.storage import kept, sized_join

BANDS = 128
#: Scores are compared at six digits, so bounds are loosened by more than that.
SLACK = 1e-5


@dataclass
class Index:
    """docs: the key and the text. Where they are needed: postings (token, the key, tf, length), written once; the number of documents that
    have tokens, and their mean length. Postings are written where their documents are read, without a shuffle, so a token that all
    documents have is in no task's way; in each file they are sorted by token."""

    docs: DataFrame
    key: str
    text: str

    @cached_property
    def postings(self) -> DataFrame:
        return kept(inverted_index(self.docs, self.key, self.text).sortWithinPartitions("token"), "impact-postings")

    @cached_property
    def _totals(self) -> tuple[int, int]:
        share = F.sum(F.col("tf") / F.col("length"))  # a document's tf add up to its length, so this is the number of documents
        n, total = self.postings.agg(F.round(share).cast("long"), F.sum("tf")).first()
        return n or 0, total or 0

    @property
    def documents(self) -> int:
        return self._totals[0]

    @property
    def mean(self) -> float:
        n, total = self._totals
        return total / n if n else 1.0

    def impact(self) -> Column:
        """Of a row with tf and length."""
        return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / self.mean))


@dataclass
class Asked:
    """terms: qid, prefix, idf, and the most that the prefix adds to a score; hits: prefix, the key, impact, band;
    heads: prefix, band, n, top. Band 0 has the largest impacts."""

    terms: DataFrame
    hits: DataFrame
    heads: DataFrame


def index_of(docs: DataFrame, key: str, text: str) -> Index:
    """The index of a table of documents with distinct keys."""
    return Index(docs, key, text)


def ask(index: Index, queries: DataFrame, limit: int = 500_000) -> Asked:
    """What a table of queries (qid, query) asks for. Up to `limit` counted words meet each posting's own prefixes of their few lengths by a
    broadcast, so postings aren't shuffled; more words meet the vocabulary first. Hits are counted up to (prefix, document) with
    partial sums."""
    asked = queries.select("qid", F.explode(F.array_distinct(tokens(F.lower(fold(F.col("query")))))).alias("prefix"))
    asked = kept(asked, "impact-asked")
    prefixes = kept(asked.select("prefix").distinct(), "impact-prefixes")
    lengths = sorted(r[0] for r in prefixes.select(F.length("prefix")).distinct().collect())  # some ten numbers

    def begun(rows: DataFrame) -> DataFrame:
        rows = rows.select("*", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("x_")).filter(F.length("token") >= F.col("x_"))
        return rows.withColumn("prefix", F.substring("token", F.lit(1), F.col("x_"))).drop("x_")

    if prefixes.count() <= limit:
        met = begun(index.postings).join(prefixes.hint("broadcast"), "prefix", "left_semi")
    else:
        words = begun(index.postings.select("token").distinct()).join(prefixes.hint("merge"), "prefix", "left_semi")
        met = index.postings.join(words.hint("merge"), "token")
    hits = met.groupBy("prefix", index.key).agg(F.sum("tf").alias("tf"), F.first("length").alias("length"))
    hits = hits.select("prefix", index.key, index.impact().alias("impact")).withColumn("band", F.floor((1 - F.col("impact") / (K1 + 1)) * BANDS).cast("int"))
    hits = kept(hits, "impact-hits")
    heads = kept(hits.groupBy("prefix", "band").agg(F.count("*").alias("n"), F.max("impact").alias("top")), "impact-heads")
    idf = F.log(1 + (index.documents - F.col("df") + 0.5) / (F.col("df") + 0.5))
    valued = heads.groupBy("prefix").agg(F.sum("n").alias("df"), F.max("top").alias("top")).select("prefix", idf.alias("idf"), (idf * F.col("top")).alias("most"))
    return Asked(kept(asked.join(valued.hint("merge"), "prefix").select("qid", "prefix", "idf", "most"), "impact-terms"), hits, heads)


def first_bands(asked: Asked, k: int) -> DataFrame:
    """(qid, prefix, idf, band): the bands of each word, from the largest impacts on, until they hold k hits."""
    before = F.sum("n").over(Window.partitionBy("prefix").orderBy("band").rowsBetween(Window.unboundedPreceding, -1))
    heads = asked.heads.withColumn("before_", F.coalesce(before, F.lit(0))).filter(F.col("before_") < k).select("prefix", "band")
    return asked.terms.join(heads.hint("merge"), "prefix").select("qid", "prefix", "idf", "band")


def floors(scores: DataFrame, k: int, terms: DataFrame) -> DataFrame:
    """(qid, floor): a score that the k-th best of a query is not below; 0 where fewer than k documents are known."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"))
    kth = scores.select("qid", "score").withColumn("n_", F.row_number().over(w)).filter(F.col("n_") <= k).groupBy("qid").agg(F.max("n_").alias("n_"), F.min("score").alias("score"))
    floor = F.when(F.col("n_") >= k, F.greatest(F.col("score") - SLACK, F.lit(0.0)))
    return terms.select("qid").distinct().join(kth.hint("merge"), "qid", "left").select("qid", F.coalesce(floor, F.lit(0.0)).alias("floor"))


def levels(terms: DataFrame, floor: DataFrame) -> DataFrame:
    """terms with `level`, `cut` and `bound`. The level is the largest x for which the parts min(most, x) add up to the query's floor: of
    the words in ascending order of most, the largest of (floor - sum of the i smallest) / (number of the others). A word's cut is
    the largest part that it may add to a document which pass 2 leaves out, the bound what these are together."""
    up, every = Window.partitionBy("qid").orderBy("most", "prefix"), Window.partitionBy("qid")
    below = F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = terms.join(floor.hint("merge"), "qid")
    rows = rows.withColumn("x_", (F.col("floor") - below) / (F.count("*").over(every) - F.row_number().over(up) + 1))
    rows = rows.withColumn("level", F.greatest(F.max("x_").over(every), F.lit(0.0))).withColumn("cut", F.least("most", "level"))
    return rows.withColumn("bound", F.sum("cut").over(every)).drop("x_", "floor")


def wanted_bands(leveled: DataFrame, heads: DataFrame) -> DataFrame:
    """(qid, prefix, idf, cut, band, n): the bands that may hold a part of at least the query's level."""
    rows = leveled.join(heads.hint("merge"), "prefix")
    return rows.filter(F.col("idf") * F.col("top") >= F.col("level")).select("qid", "prefix", "idf", "cut", "band", "n")


def sums(asked: Asked, wanted: DataFrame, key: str, *more: Column) -> DataFrame:
    """(qid, key, score, and more): what the hits of wanted bands add up to. Hits are not shuffled if what is wanted was counted to be
    small."""
    found = sized_join(asked.hits, kept(wanted, "impact-wanted"), ["prefix", "band"], "inner")
    return found.groupBy("qid", key).agg(F.sum(F.col("idf") * F.col("impact")).alias("score"), *more)


def best(index: Index, queries: DataFrame, k: int = 10, limit: int = 500_000) -> DataFrame:
    """(qid, key, score, rank): the k best documents of each query (qid, query), as `corpus.bm25` ranks them: by score to six digits,
    then by key. Queries without words and words without documents give no rows, as do null queries; an empty table gives none.

    Up to `limit` counted words are known to every task, and documents meet the queries in blocks (`blocks.best`); more words meet
    the postings in joins, by bands."""
    prefixes = queries.select(F.explode(tokens(F.lower(fold(F.col("query"))))).alias("prefix")).distinct()
    prefixes = kept(prefixes, "impact-prefixes")
    if prefixes.count() > limit:
        return best_by_bands(index, queries, k)
    return blocks.best(index.docs, queries, sorted(prefixes.toArrow().column("prefix").to_pylist()), index.key, index.text, k)


def best_by_bands(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """What `best` gives, for any number of words: by the three passes above."""
    key, asked = index.key, ask(index, queries)
    floor = floors(sums(asked, first_bands(asked, k), key), k, asked.terms)
    leveled = kept(levels(asked.terms, floor), "impact-levels")
    over = F.sum(F.col("idf") * F.col("impact") - F.col("cut")).alias("over_")
    seen = kept(sums(asked, wanted_bands(leveled, asked.heads), key, over), "impact-seen")
    floor = floors(seen, k, asked.terms).join(leveled.select("qid", "bound").distinct().hint("merge"), "qid")
    may = seen.join(floor.hint("merge"), "qid").filter(F.col("over_") + F.col("bound") + SLACK >= F.col("floor")).select("qid", key)
    whole = kept(may.join(asked.terms.select("qid", "prefix", "idf").hint("merge"), "qid"), "impact-may")
    found = sized_join(asked.hits, whole, ["prefix", key], "inner")
    scored = found.groupBy("qid", key).agg(F.round(F.sum(F.col("idf") * F.col("impact")), 6).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
