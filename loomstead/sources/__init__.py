"""Reading files and nested records, and telling what changed between two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.functions.text import blank_to_null
from loomstead.operators.predicates import ignored_path


def text_files(spark: SparkSession, folder: str, extensions: list[str], skip: str = "cleaned") -> DataFrame:
    """(path, content) of all files below a folder with one of some extensions (case ignored), without ignored paths."""
    ends = ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{ends}}}").load(folder)  # others aren't listed
    keep = ~ignored_path(F.col("path")) & ~F.contains("path", F.lit(f"/{skip}/"))
    return files.filter(keep).select("path", F.decode("content", "UTF-8").alias("content"))


def identity(source: Column, source_ref: Column, repo: Column, path: Column) -> Column:
    """The key of a document: (source, reference), else (repository, path), else none: such rows are always new."""
    return F.when(source.isNotNull() & source_ref.isNotNull(), F.struct(F.lit("source").alias("kind"), source.alias("a"), source_ref.alias("b"))).when(repo.isNotNull() & path.isNotNull(), F.struct(F.lit("repo").alias("kind"), repo.alias("a"), path.alias("b")))


def changes(old: DataFrame, new: DataFrame, key: str, content: str, derived: DataFrame | None = None) -> DataFrame:
    """(key, change): new, changed, unchanged or removed. With `derived`, an equal text counts as unchanged only if derived
    has rows of the key. An incoming snapshot without rows removes nothing."""
    h = F.sha2(F.col(content), 256)
    was, now = old.select(key, h.alias("was_")), new.select(F.col(key).alias("k_"), h.alias("now_"))
    both = was.join(now, F.col(key) == F.col("k_"), "full_outer")
    done = F.lit(True)
    if derived is not None:
        both = both.join(derived.select(F.col(key).alias("d_")).distinct(), F.coalesce(key, "k_") == F.col("d_"), "left")
        done = F.col("d_").isNotNull()
    change = F.when(F.col(key).isNull(), "new").when(F.col("k_").isNull(), "removed").when((F.col("was_") == F.col("now_")) & done, "unchanged").otherwise("changed")
    out = both.select(F.coalesce(key, "k_").alias(key), change.alias("change"))
    return out.filter("change <> 'removed'") if new.isEmpty() else out


def same_rows(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """One row: whether both have the same rows, repeats counted."""
    both = old.select(*columns, F.lit(1).alias("n_")).unionByName(new.select(*columns, F.lit(-1).alias("n_")))
    return both.groupBy(*columns).agg(F.sum("n_").alias("n_")).agg(F.coalesce(F.every(F.col("n_") == 0), F.lit(True)).alias("same"))


def replace_children(stored: DataFrame, new: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Children of the keys are dropped and those of new put in."""
    return stored.join(keys.select(key).distinct(), key, "left_anti").unionByName(new)


def flat_asset(node: str) -> list[Column]:
    """Columns of a nested record: trimmed, blank to null, tags and phases as arrays, the end taken out of the phases."""
    c = lambda p: F.col(f"{node}.{p}")
    end = F.get(F.filter(c("lifecycle.phases"), lambda x: x["phase"] == "endOfLife"), F.lit(0))["startDate"]
    return [
        blank_to_null(c("id")).alias("id"), blank_to_null(c("name")).alias("name"), blank_to_null(c("type")).alias("type"), blank_to_null(c("description")).alias("description"),
        F.coalesce(F.size(c("lifecycle.phases")), F.lit(0)).alias("n_phases"), blank_to_null(end).alias("end_date"),
    ]


def relation_rows(records: DataFrame, node: str, relations: list[str]) -> DataFrame:
    """(from_id, rel, to_id, to_name): one row for each far end; those without an id are left out."""
    every = F.array(*[_tagged(node, r) for r in relations])
    return records.select(F.col(f"{node}.id").alias("from_id"), F.explode(F.flatten(F.filter(every, lambda a: a.isNotNull()))).alias("e")).select("from_id", "e.*").filter("to_id IS NOT NULL")


def _tagged(node: str, rel: str) -> Column:
    return F.transform(F.col(f"{node}.{rel}"), lambda x: F.struct(F.lit(rel).alias("rel"), x["id"].alias("to_id"), x["name"].alias("to_name")))


def role_rows(records: DataFrame, node: str) -> DataFrame:
    """(id, person, role): one row for each role, a null role where a person has none, no repeats."""
    people = records.select(F.col(f"{node}.id").alias("id"), F.explode(F.col(f"{node}.people")).alias("p"))
    return people.select("id", F.col("p.name").alias("person"), F.explode_outer("p.roles").alias("role")).dropDuplicates()


def taxonomy_rows(rows: DataFrame, empty: list[str]) -> DataFrame:
    """(l1, l2, l3, ref) of a three-level list: placeholders are empty, the last reference counts, a first level without
    children stays as a stub."""
    clean = lambda c: F.when(~F.coalesce(F.trim(F.col(c)), F.lit("")).isin("", *empty), F.trim(F.col(c)))
    r = rows.select("row_no", *[clean(c).alias(c) for c in ("l1", "l2", "l3")], "ref").filter("l1 IS NOT NULL")
    full = r.filter("l2 IS NOT NULL AND l3 IS NOT NULL").groupBy("l1", "l2", "l3").agg(F.max_by("ref", "row_no").alias("ref"))
    stubs = r.select("l1").distinct().join(full.select("l1").distinct(), "l1", "left_anti")
    return full.unionByName(stubs.select("l1", *[F.lit(None).cast("string").alias(c) for c in ("l2", "l3", "ref")]))


def listing(names: Column, most: int = 12) -> Column:
    """Names joined by commas; of more than `most`, the number, the first ones and how many more."""
    s = F.sort_array(names)
    long_ = F.concat(F.size(s).cast("string"), F.lit(" in total, including "), F.array_join(F.slice(s, 1, most), ", "), F.lit(" (and "), (F.size(s) - most).cast("string"), F.lit(" more)"))
    return F.when(F.size(s) > most, long_).otherwise(F.array_join(s, ", "))


def rendered(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, text): a document of each asset from its columns and grouped relations; no names of persons are in it."""
    grouped = edges.groupBy(F.col("from_id").alias("id"), "rel").agg(listing(F.collect_set("to_name")).alias("names"))
    lines = grouped.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(": ", "rel", "names"))), "\n").alias("relations"))
    head = F.concat_ws("\n", F.concat(F.lit("# "), F.col("name")), F.concat(F.lit("Type: "), F.col("fs_type")), F.concat(F.lit("Lifecycle: "), F.col("lifecycle")), F.col("relations"))
    return assets.join(lines, "id", "left").select("id", head.alias("text"))
