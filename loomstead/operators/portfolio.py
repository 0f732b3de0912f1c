"""Portfolio and usage analytics: concentration, matrices, runways, gaps, coverage, exact drill-downs, gap-free series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.functions import dates
from loomstead.operators.predicates import eq_or_null
from loomstead.operators.relational import half_at, levels
from loomstead.storage import sized_cross


def far_counts(edges: DataFrame, rel: str, near: str = "from_id", far: str = "to_id", name: str = "reach") -> DataFrame:
    """(near, name): distinct far ends of a relation."""
    return edges.filter(F.col("rel") == rel).groupBy(near).agg(F.count_distinct(far).alias(name))


def concentration(edges: DataFrame, rel: str) -> DataFrame:
    """(name, n): distinct near ends for each far end, largest first."""
    return edges.filter(F.col("rel") == rel).groupBy(F.col("to_name").alias("name")).agg(F.count_distinct("from_id").alias("n"))


def concentration_statistics(totals: DataFrame, n: str, top: int = 5) -> DataFrame:
    """One row: groups, their sum, share of the largest, groups that make half, sum of the first `top`, and the rest."""
    first = F.least("k", F.greatest(F.lit(0), F.lit(top) - F.col("above"))) * F.col(n)
    return levels(totals, [], n).agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n_groups"),
        F.max("all").alias("total"),
        F.round(F.try_divide(F.max(n), F.max("all")), 6).alias("top_share"),
        F.min(half_at(n)).cast("long").alias("to_half"),
        F.sum(first).cast("long").alias("top_sum"),
        (F.max("all") - F.sum(first)).cast("long").alias("rest"),
    )


def dense_matrix(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, n) with every cell of the values that occur, nulls among them."""
    n = rows.groupBy(x, y).agg(F.count("*").alias("n"))
    xs, ys = n.select(F.col(x).alias("x_")).distinct(), n.select(F.col(y).alias("y_")).distinct()
    found = sized_cross(ys, xs).join(n.hint("merge"), F.col("x_").eqNullSafe(F.col(x)) & F.col("y_").eqNullSafe(F.col(y)), "left")
    return found.select(F.col("x_").alias(x), F.col("y_").alias(y), F.coalesce("n", F.lit(0)).alias("n"))


def runway(assets: DataFrame, reach: DataFrame, now: Column) -> DataFrame:
    """Assets with a dated ending: months away, whether it has begun, reach."""
    away = dates.months_away(F.col("end_date"), now)
    rows = assets.filter("end_date IS NOT NULL").join(reach, "id", "left")
    return rows.select("id", "name", F.round(away, 6).alias("months"), (away < 0).alias("started"), F.coalesce("reach", F.lit(0)).alias("reach"))


def action_gap(assets: DataFrame, reach: DataFrame, planned: DataFrame, poor: list[str], least: int = 20) -> DataFrame:
    """Assets of wide reach that end or fit badly: the reasons, and whether something linked deals with them."""
    ending = F.col("end_date").isNotNull() | F.coalesce(F.col("lifecycle").isin("phaseOut", "endOfLife"), F.lit(False))
    bad = F.coalesce(F.col("fit").isin(*poor), F.lit(False))
    reasons = F.filter(F.array(F.when(ending, F.lit("ending")), F.when(bad, F.lit("poor fit"))), lambda x: x.isNotNull())
    rows = assets.join(reach.filter(F.col("reach") >= least), "id").withColumn("reasons", reasons).filter(F.size("reasons") > 0)
    return rows.join(planned.select("id").distinct().withColumn("p_", F.lit(True)), "id", "left").select("id", "reach", F.array_join("reasons", ",").alias("reasons"), F.coalesce("p_", F.lit(False)).alias("planned"))


#: What a drill-down asks of an asset, for each dimension: a column, and the kind of asset it is asked of, if only of one.
DIMENSIONS = {
    "type": ("fs_type", None),
    "lifecycle": ("lifecycle", None),
    "fit": ("fit", None),
    "category": ("category", "component"),
    "time": ("time_class", "application"),
}
#: The relation whose far end a dimension names.
FAR = {"vendor": "vendor", "capability": "capability", "business_capability": "business", "organisation": "org"}


@dataclass(frozen=True)
class Portfolio:
    """What drill-downs read: assets, edges (from_id, rel, to_name), roles (id, kind, role), research (id, identified,
    verdict), and what the two kinds of asset are called."""

    assets: DataFrame
    edges: DataFrame
    roles: DataFrame
    research: DataFrame
    component: str
    application: str

    def having(self, rows: DataFrame) -> DataFrame:
        return self.assets.join(rows.select("id"), "id", "left_semi")

    def near(self, rel: str, name: str | None = None) -> DataFrame:
        """Near ends of a relation, to a far end of some name."""
        edges = self.edges.filter(F.col("rel") == rel)
        return (edges if name is None else edges.filter(F.col("to_name") == name)).select(F.col("from_id").alias("id"))

    def gap(self, key: str) -> DataFrame:
        """Assets whose record lacks something."""
        a = self.assets
        responsible = self.roles.filter("kind = 'RESPONSIBLE'").select("id")
        known = {
            "no_description": lambda: a.filter(F.coalesce("description", F.lit("")) == ""),
            "no_fit": lambda: a.filter("fit IS NULL"),
            "no_lifecycle": lambda: a.filter("lifecycle IS NULL"),
            "no_owner": lambda: a.join(responsible, "id", "left_anti"),
            "no_capability": lambda: a.filter(F.col("fs_type") == self.component).join(self.near("capability"), "id", "left_anti"),
        }
        return known[key]()


def drill(p: Portfolio, dimension: str, key: str = "", key2: str = "") -> DataFrame:
    """The assets behind a figure, by the same predicate as the figure's; the key "" stands for null. An unknown dimension or
    gap is an error, so that it isn't read as a figure of 0."""
    kinds = {"component": p.component, "application": p.application}
    if dimension == "all":
        return p.assets
    if dimension == "criticality":
        cell = eq_or_null(F.col("criticality"), key) & eq_or_null(F.col("data_class"), key2)
        return p.assets.filter(cell & (F.col("fs_type") == p.application))
    if dimension == "gap":
        return p.gap(key)
    if dimension == "verdict":
        return p.having(p.research.filter(F.col("identified") & (F.col("verdict") == key)))
    if dimension == "role":
        return p.having(p.roles.filter((F.col("kind") == "RESPONSIBLE") & (F.col("role") == key)))
    if dimension in FAR:
        return p.having(p.near(FAR[dimension], key))
    column, kind = DIMENSIONS[dimension]
    same = eq_or_null(F.col(column), key)
    return p.assets.filter(same & (F.col("fs_type") == kinds[kind]) if kind else same)


def resolve(rows: DataFrame, key: Column, levels: list[tuple[str, DataFrame]]) -> DataFrame:
    """rows with `node` and `level`: the first of some lookup tables (key, node) that knows the key. The tables are a taxonomy."""
    found = rows.withColumn("k_", key)
    names = []
    for i, (name, table) in enumerate(levels):
        lookup = table.dropDuplicates(["key"]).select(F.col("key").alias(f"l{i}_"), F.col("node").alias(f"n{i}_"))
        found = found.join(lookup.hint("shuffle_hash"), F.col("k_") == F.col(f"l{i}_"), "left").drop(f"l{i}_")
        names.append((name, f"n{i}_"))
    level = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(n)) for n, c in names])
    return found.withColumns({"node": F.coalesce(*[F.col(c) for _, c in names]), "level": level}).drop("k_", *[c for _, c in names])


def usage_series(log: DataFrame, now: Column, hours: int, n_buckets: int, offset_minutes: int, categories: list[str], spark) -> DataFrame:
    """(category, bucket, measures) for every bucket up to now and every category; unknown categories fold to "other"."""
    end = dates.bucket_start(now, hours, offset_minutes)
    starts = spark.range(n_buckets).select((F.unix_timestamp(end) - F.col("id") * hours * 3600).alias("b_"))
    frame = starts.join(F.broadcast(spark.createDataFrame([(c,) for c in [*categories, "other"]], "c_ string")), how="cross")
    folded = F.when(F.col("category").isin(*categories), F.col("category")).otherwise("other")
    rows = log.select(F.unix_timestamp(dates.bucket_start(F.col("created_at"), hours, offset_minutes)).alias("at"), folded.alias("category"), "total_tokens", "estimated")
    sums = rows.groupBy("at", "category").agg(F.sum("total_tokens").alias("total"), F.count("*").alias("calls"), F.sum(F.when(F.col("estimated") == 1, F.col("total_tokens"))).alias("estimated_tokens"))
    found = frame.join(sums.hint("merge"), (F.col("at") == F.col("b_")) & (F.col("category") == F.col("c_")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return found.select(F.col("c_").alias("category"), F.timestamp_seconds("b_").cast("string").alias("bucket"), zero("total"), zero("calls"), zero("estimated_tokens"))
