"""Quality rules by distribution divergence, in DataFrame functions only.

Each document's histograms of character classes and of its language's commonest words are held
against the same histograms of all documents of that language, by Jensen-Shannon distance (base 2,
so 0 to 1). Short documents and languages with little text are not judged by distance.

Defined results: null text counts as empty; empty text has no words and fails the base rule; a null
language counts as the empty one, which is a language of its own; null ids and repeated rows are judged row by row, ties in the
commonest words go by code point; an empty table gives an empty result; other columns, whatever
their names, are kept inside one struct and cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.llm.common import SPACE_CLASS, settled, sized_join, written

#: Characters counted as symbols, and the window of the repetition rule in words.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Character classes in the order of the histogram; what is left of a text is the last class.
CHAR_CLASSES = (r"\p{Lu}", r"\p{L}", r"\p{Nd}", r"[\x20\x09-\x0D]", r"[#*$%&|<>]")


@dataclass(frozen=True)
class Rules:
    """min_words, repeat_pct: the base rule. common: words in a language's histogram.
    char_words, word_words: fewest words for either distance. ref_words: fewest words of a language's reference."""

    min_words: int = 10
    repeat_pct: int = 20
    common: int = 24
    char_words: int = 20
    word_words: int = 60
    ref_words: int = 500
    char_limit: float = 0.30
    word_limit: float = 0.45


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def _char_counts(text: Column) -> Column:
    """Counts of each class: what its removal, after that of the classes before it, takes away."""
    counts, rest = [], text
    for pattern in CHAR_CLASSES:
        less = F.regexp_replace(rest, f"{pattern}+", "")
        counts.append((F.length(rest) - F.length(less)).cast("double"))
        rest = less
    return F.array(*counts, F.length(rest).cast("double"))


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda c: c / F.greatest(total, F.lit(1.0)))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of equal length."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda a, b: (term(a, b) + term(b, a)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)))


def references(docs: DataFrame, text: str, lang: str, rules: Rules) -> DataFrame:
    """Per language: its commonest words, their shares with the rest last, shares of the character classes, its words in all."""
    d = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n_classes = len(CHAR_CLASSES) + 1
    chars = (
        d.select("lang", _char_counts(F.col("text")).alias("c"))
        .groupBy("lang")
        .agg(*[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(n_classes)])
        .select("lang", F.array(*[f"c{i}" for i in range(n_classes)]).alias("c"))
    )
    counts = d.select("lang", F.explode(_words(F.lower("text"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    counts = written(counts, "quality-words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).filter(F.col("rank") <= rules.common)
    listed = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "w", "n"))).alias("top"))
    words = listed.join(totals, "lang").select(
        "lang",
        F.col("total").cast("double").alias("total"),
        F.col("top.w").alias("common"),
        F.transform("top.n", lambda n: n.cast("double")).alias("n"),
    )
    return chars.join(words, "lang").select(
        F.col("lang").alias("ref_lang"),
        "common",
        "total",
        _shares(F.col("c"), F.aggregate("c", F.lit(0.0), lambda s, x: s + x)).alias("ref_chars"),
        _shares(F.concat("n", F.array(F.col("total") - F.aggregate("n", F.lit(0.0), lambda s, x: s + x))), F.col("total")).alias("ref_words"),
    )


def _repeat_words(docs: DataFrame) -> DataFrame:
    """n_repeat_words from `words`: positions inside 5-word windows that occur twice or more in the text.

    A window is known by a 64-bit hash. Sorting happens only for texts that repeat a window at all."""
    n, no = F.size("words"), F.array().cast("array<bigint>")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(no)
    d = docs.withColumn("windows", windows)
    pairs = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    d = d.withColumn("sorted", F.when(some, F.sort_array(pairs)))
    near = lambda j: F.get("sorted", j)["h"]
    hits = F.transform("sorted", lambda e, j: F.when((e["h"] == near(j - 1)) | (e["h"] == near(j + 1)), e["i"]))
    d = d.withColumn("hits", F.sort_array(F.filter(hits, lambda i: i.isNotNull())))
    gaps = F.transform("hits", lambda p, j: F.coalesce(F.least(F.lit(WINDOW), F.get("hits", j + 1) - p), F.lit(WINDOW)))
    return d.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long"))).drop("windows", "sorted", "hits")


def judge(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """`row` (a struct of all columns of docs) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, char_distance, word_distance (null where not judged) and kept."""
    refs = written(references(docs, text, lang, rules), "quality-references")
    d = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(lang), F.lit("")).alias("lang"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "row",
        "lang",
        _words(F.col("text")).alias("words"),
        lines.alias("lines"),
        _char_counts(F.col("text")).alias("c"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    d = d.withColumns({"n_words": F.size("words").cast("long"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")})
    d = _repeat_words(d).drop("lines")
    d = sized_join(d, refs, F.col("lang") == F.col("ref_lang"), "left")
    d = d.withColumn("ids", F.filter(F.transform("words", lambda w: F.array_position("common", F.lower(w))), lambda i: i > 0))
    listed = F.transform(F.sequence(F.lit(1), F.size("common")), lambda k: F.size(F.filter("ids", lambda i: i == k)).cast("double"))
    d = d.withColumn("hist", F.concat(listed, F.array((F.size("words") - F.size("ids")).cast("double"))))
    known = F.col("total") >= rules.ref_words
    d = d.withColumns(
        {
            "base_failed": (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_pct * F.col("n_words")),
            "char_distance": F.when(known & (F.col("n_words") >= rules.char_words), _distance(_shares(F.col("c"), F.aggregate("c", F.lit(0.0), lambda s, x: s + x)), F.col("ref_chars"))),
            "word_distance": F.when(known & (F.col("n_words") >= rules.word_words), _distance(_shares(F.col("hist"), F.col("n_words").cast("double")), F.col("ref_words"))),
        }
    )
    near = (F.coalesce("char_distance", F.lit(0.0)) <= rules.char_limit) & (F.coalesce("word_distance", F.lit(0.0)) <= rules.word_limit)
    verdict = settled(~F.col("base_failed") & near)
    return d.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", verdict.alias("kept")
    )


SQL_PARTS = """
d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, lang, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
chars AS (SELECT k, lang, unnest([0, 1, 2, 3, 4, 5]) AS b, unnest([length(text) - length(r1), length(r1) - length(r2), length(r2) - length(r3), length(r3) - length(r4), length(r4) - length(r5), length(r5)])::DOUBLE AS n
  FROM (SELECT *, regexp_replace(r4, '[#*$%&|<>]+', '', 'g') AS r5 FROM (SELECT *, regexp_replace(r3, '[\\x20\\x09-\\x0D]+', '', 'g') AS r4
  FROM (SELECT *, regexp_replace(r2, '\\p{{Nd}}+', '', 'g') AS r3 FROM (SELECT *, regexp_replace(r1, '\\p{{L}}+', '', 'g') AS r2
  FROM (SELECT *, regexp_replace(text, '\\p{{Lu}}+', '', 'g') AS r1 FROM d)))))),
flat AS (SELECT k, lang, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM w),
counts AS (SELECT lang, lower(w) AS w, count(*) AS n FROM flat GROUP BY ALL),
totals AS (SELECT lang, sum(n)::DOUBLE AS total FROM counts GROUP BY lang),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS rank FROM counts) WHERE rank <= {common}),
ref_words AS (SELECT lang, rank, w, n / total AS q FROM top JOIN totals USING (lang)
  UNION ALL SELECT lang, 0, NULL, 1 - sum(n) / max(total) FROM top JOIN totals USING (lang) GROUP BY lang),
ref_chars AS (SELECT lang, b, sum(n) / greatest(sum(sum(n)) OVER (PARTITION BY lang), 1) AS q FROM chars GROUP BY lang, b),
seen AS (SELECT k, f.lang, coalesce(rank, 0) AS rank, count(*)::DOUBLE AS n FROM flat f LEFT JOIN top t ON f.lang = t.lang AND lower(f.w) = t.w GROUP BY ALL),
word_js AS (SELECT w.k, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2) AS js
  FROM (SELECT w.k, r.q, coalesce(s.n, 0) / greatest(len(w.words), 1) AS p FROM w JOIN ref_words r USING (lang) LEFT JOIN seen s ON s.k = w.k AND s.rank = r.rank) w GROUP BY w.k),
char_js AS (SELECT k, sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2) AS js
  FROM (SELECT k, q, n / greatest(sum(n) OVER (PARTITION BY k), 1) AS p FROM chars JOIN ref_chars USING (lang, b)) GROUP BY k),
wins AS (SELECT k, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
hits AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, list_slice(words, i, i + 4)) AS n FROM wins) WHERE n > 1),
reps AS (SELECT k, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS nxt FROM hits) GROUP BY k),
base AS (SELECT k, doc_id, w.lang, text, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN reps USING (k)),
judged AS (SELECT b.*, n_words < {min_words} OR 100 * n_repeat_words > {repeat_pct} * n_words AS base_failed,
  coalesce(CASE WHEN total >= {ref_words} AND n_words >= {char_words} THEN sqrt(greatest(0, c.js)) END, 0) <= {char_limit}
  AND coalesce(CASE WHEN total >= {ref_words} AND n_words >= {word_words} THEN sqrt(greatest(0, j.js)) END, 0) <= {word_limit} AS near
  FROM base b LEFT JOIN totals t ON t.lang = b.lang LEFT JOIN word_js j ON j.k = b.k LEFT JOIN char_js c ON c.k = b.k)
"""


def sql(rules: Rules = Rules()) -> str:
    parts = SQL_PARTS.format(**vars(rules))
    return f"WITH {parts} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND near AS kept FROM judged"
