"""Graph operators on edge tables: statistics, components, bounded searches, communities, trees. Loops write each round to
the shared folder, so lineage stays short and lost executors cost a round at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.operators.relational import numbered
from loomstead.storage import bucketed, dealt, kept, sized_join

#: Weight of an edge by its kind, and of any other.
WEIGHTS = {
    "is_part_of": 1.0,
    "is_a": 1.0,
    "governs": 0.8,
    "enforces": 0.8,
    "constrains": 0.8,
    "depends_on": 0.7,
    "manages": 0.7,
    "defines": 0.7,
    "implements": 0.7,
    "complies_with": 0.6,
    "includes": 0.6,
    "supports": 0.5,
    "enables": 0.5,
    "uses": 0.4,
    "references": 0.3,
}
OTHER_WEIGHT = 0.3


def links(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (node, root): root is the smallest node that edges reach. Loops and repeats are ignored; nodes without
    edges are not listed. Large-star and small-star rounds alternate until nothing changes (some log2 of the longest path);
    each is written, so lineage stays short.

    Edges point from the smaller node to the larger. A round hands what hangs on a node to that node's least neighbour. Only
    nodes that both hang on others and have others hanging on them take part in that join, and the centre of a large star is
    not one of them: its edges stay where they are. What is written is counted, and the next grouping has as many tasks as that needs."""
    edges = edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = kept(edges, "links")
    edges, mark = kept(dealt(edges, edges.count(), "a", "b").distinct(), "links"), None
    while True:
        n = edges.count()
        low = edges.groupBy(F.col("b").alias("x_")).agg(F.min("a").alias("m_"))
        middle = kept(low.join(edges.select(F.col("a").alias("x_")).distinct().hint("merge"), "x_", "left_semi"), "links-middle")
        large = _met(edges, n, "a", middle).select(F.coalesce("m_", "a").alias("a"), "b")
        large = kept(dealt(large, n, "a", "b").distinct(), "links-large")
        least = large.groupBy(F.col("b").alias("x_")).agg(F.min("a").alias("m_"), F.count("*").alias("n_")).filter("n_ > 1").drop("n_")
        least = kept(least, "links-least")
        moved = _met(large, n, "b", least)
        each = F.when(F.col("m_").isNotNull() & (F.col("m_") != F.col("a")), F.array(F.struct(F.col("m_").alias("a"), "b"), F.struct(F.col("m_").alias("a"), F.col("a").alias("b")))).otherwise(F.array(F.struct("a", "b")))
        both = moved.select(F.explode(each).alias("e_")).select("e_.a", "e_.b")
        edges = kept(dealt(both, 2 * large.count(), "a", "b").distinct(), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _met(edges: DataFrame, n: int, key: str, least: DataFrame) -> DataFrame:
    """n edges with the m_ that belongs to their key (x_), if any: by a broadcast if these are few, else in as many tasks as edges need."""
    few = least.count() <= 500_000
    return (edges if few else dealt(edges, n, key)).join(least.hint("broadcast" if few else "merge"), F.col(key) == F.col("x_"), "left")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable; a node without edges is its own."""
    found = links(edges).withColumnRenamed("node", "n_")
    return nodes.join(found.hint("merge"), F.col("node") == F.col("n_"), "left").select("node", F.coalesce("root", "node").alias("component"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, average degree, density, isolated nodes, components, share of the largest."""
    comp = components(nodes, edges).groupBy("component").agg(F.count("*").alias("n"))
    sizes = comp.agg(F.count("*").alias("n_components"), F.max("n").alias("largest"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    n = nodes.agg(F.count("*").alias("n_nodes"))
    e = edges.agg(F.count("*").alias("n_edges"))
    lone = nodes.join(ends.hint("merge"), "node", "left_anti").agg(F.count("*").alias("n_isolated"))
    one = n
    for other in (e, lone, sizes):  # a row each
        one = one.join(F.broadcast(other), how="cross")
    pairs = F.greatest(F.lit(1), F.col("n_nodes") * (F.col("n_nodes") - 1))
    return one.select(
        "n_nodes", "n_edges", F.round(2 * F.col("n_edges") / F.col("n_nodes"), 4).alias("average_degree"), F.round(F.col("n_edges") / pairs, 6).alias("density"), "n_isolated", "n_components", F.round(F.col("largest") / F.col("n_nodes"), 4).alias("largest_share"),
    )


def weighted(edges: DataFrame, rel: str, rows: int | None = None) -> DataFrame:
    """(a, b, weight), both ways: weights of parallel edges added. Edges are added up one way and then turned; rows: about how many
    there are, if that is known, else they are written and counted. Tasks are as many as these need."""
    w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col(rel)), F.lit(OTHER_WEIGHT))
    one = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), w.alias("weight"))
    if rows is None:
        one = kept(one, "weighted")
        rows = one.count()
    each = dealt(one, rows, "a", "b").groupBy("a", "b").agg(F.round(F.sum("weight"), 6).alias("weight"))
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e_")
    return each.select(ways, "weight").select("e_.a", "e_.b", "weight")


#: Rows that a start's nodes are dealt into tasks by, and the most of one start in a task, about.
STEPS_A_TASK, STEPS_A_START = 1_000_000, 2_000_000


def _onward(front: DataFrame, edges: DataFrame, seen: list[DataFrame], by: list[str], value) -> DataFrame:
    """(start, node, value): what the front's (start, node, ...) edges lead to and is not seen (start, node), with the least value of its
    ways. edges: a, b and the columns `by`, which values are made of. A node's ends are listed once, and these lists are dealt by start, so
    no pair of a start and a node is shuffled, and what is seen is told in the same grouping. Starts that lead to very much, and
    ends of very large nodes, are cut into slices of ends. Tasks are as many as the counted steps need."""
    degree = edges.groupBy(F.col("a").alias("a_")).agg(F.count("*").alias("n_"))
    load = front.join(degree.hint("merge"), F.col("node") == F.col("a_")).groupBy("start").agg(F.sum("n_").alias("n_"))
    most, total = load.agg(F.coalesce(F.max("n_"), F.lit(0)), F.coalesce(F.sum("n_"), F.lit(0))).first()
    slices = -(-most // STEPS_A_START) or 1
    sliced = lambda end: F.pmod(F.xxhash64(end), F.lit(slices)).cast("int").alias("slice")
    ends = edges.groupBy(F.col("a").alias("a_"), sliced("b"), *by).agg(F.collect_list("b").alias("ends"))
    rows = front.join(ends.hint("merge"), F.col("node") == F.col("a_")).select("start", "slice", value.cast("long").alias("value"), "ends")
    for f in seen:
        rows = rows.unionByName(f.select("start", sliced("node"), F.lit(-1).cast("long").alias("value"), F.array("node").alias("ends")))
    rows = rows.repartition(-(-total // STEPS_A_TASK) or 1, "start", "slice")
    each = rows.select("start", "slice", "value", F.explode("ends").alias("node")).groupBy("start", "slice", "node").agg(F.min("value").alias("value"))
    return each.filter("value >= 0").select("start", "node", "value")


def reach(start: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth, path): breadth-first, each node once for a start, by its earliest parent, then by the strongest
    edge, then by label. edges: a, b, weight, label, both ways. A node's place in the search is the list of its steps (strength, label,
    node) from the start, so that the first way to a node is a minimum. In the last round, which has most of the steps, places are numbered within
    their start and paths are numbered, so that this minimum is one of single numbers. For depths alone see `search_depths`."""
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.struct((-F.col("weight").cast("double")).alias("far"), "label").alias("e_"))
    edges = kept(edges.groupBy("a", "b").agg(F.min("e_").alias("e_")).select("a", "b", "e_.far", "e_.label"), "graph-edges")  # read once a round
    step_type = "array<struct<far: double, label: string, node: bigint>>"
    front = kept(start.select(F.col("node").alias("start"), F.col("node").cast("long").alias("node"), F.lit(0).alias("depth"), F.lit("").alias("path"), F.array().cast(step_type).alias("place")), "graph-front")
    found = [front]
    for d in range(1, depth):
        by = F.struct("place", "far", "label", "path")
        step = front.join(edges, F.col("node") == F.col("a")).select("start", F.col("b").alias("node"), by.alias("by")).groupBy("start", "node").agg(F.min("by").alias("by"))
        seen = found[0].select("start", "node")
        for f in found[1:]:
            seen = seen.unionByName(f.select("start", "node"))
        step = step.join(seen, ["start", "node"], "left_anti")
        last = F.array(F.struct(F.col("by.far").alias("far"), F.col("by.label").alias("label"), F.col("node").alias("node")))
        path = F.concat_ws("/", F.nullif("by.path", F.lit("")), "by.label")
        front = kept(step.select("start", "node", F.lit(d).alias("depth"), path.alias("path"), F.concat("by.place", last).cast(step_type).alias("place")), "graph-front")
        found.append(front)
    every = [f.drop("place") for f in found]
    if depth > 0:
        every.append(_last_round(front, edges, found, depth))
    out = every[0]
    for f in every[1:]:
        out = out.unionByName(f)
    return out


def _last_round(front: DataFrame, edges: DataFrame, found: list[DataFrame], depth: int) -> DataFrame:
    """(start, node, depth, path) of the nodes that the front (with places) leads to."""
    labels = numbered(edges.select(F.col("label").alias("label_")).distinct(), [F.col("label_")], "label_no")
    labels = kept(labels, "graph-labels")
    paths = kept(numbered(front.select(F.col("path").alias("path_")).distinct(), [F.col("path_")], "path_no"), "graph-paths")
    n_labels, n_paths = labels.count(), paths.count()
    ends = kept(sized_join(edges, labels, F.col("label").eqNullSafe(F.col("label_")), "inner", n_labels).select("a", "b", "label_no"), "graph-ends")
    front = sized_join(front, paths, F.col("path") == F.col("path_"), "inner", n_paths)
    front = kept(front.withColumn("no", F.row_number().over(Window.partitionBy("start").orderBy("place"))).select("start", "node", "no", "path_no"), "graph-front")
    ways = (n_labels + 1) * (n_paths + 1)
    value = F.col("no").cast("long") * ways + F.col("path_no") * (n_labels + 1) + F.col("label_no")
    step = _onward(front, ends, found, ["label_no"], value)
    way = F.col("value") % ways
    step = step.select("start", "node", (way % (n_labels + 1)).alias("lno_"), F.floor(way / (n_labels + 1)).alias("pno_"))
    step = sized_join(step, labels, F.col("lno_") == F.col("label_no"), "inner", n_labels)
    step = sized_join(step, paths, F.col("pno_") == F.col("path_no"), "inner", n_paths)
    return step.select("start", "node", F.lit(depth).alias("depth"), F.concat_ws("/", F.nullif("path_", F.lit("")), "label_").alias("path"))


def search_depths(start: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth): the depth of each node that is at most so far from a start, for very many starts. edges: a, b, both ways.
    Repeated starts and edges count once, null ones not at all."""
    edges = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    edges = kept(edges.distinct(), "graph-edges")
    front = kept(start.select(F.col("node").alias("start"), F.col("node").alias("node")).filter("start IS NOT NULL").distinct(), "graph-front")
    found = [front]
    for _ in range(depth):
        front = kept(_onward(front, edges, found, [], F.lit(0)).select("start", "node"), "graph-front")
        found.append(front)
    rows = found[0].withColumn("depth", F.lit(0))
    for d, f in enumerate(found[1:], 1):
        rows = rows.unionByName(f.withColumn("depth", F.lit(d)))
    return rows


def ego(start: DataFrame, edges: DataFrame, degree: DataFrame, hops: int, most: int) -> DataFrame:
    """(start, node, depth): nodes by hop, the best connected first in each, at most `most` of them beside the start."""
    open_, parts = start.select("node").filter("node IS NOT NULL").distinct(), []
    for d in range(1, hops + 1):  # a start that has enough within fewer hops is not searched from any further
        near = kept(search_depths(open_, edges, d).filter("depth > 0"), "ego-near")
        full = near.groupBy("start").agg(F.count("*").alias("n_")).filter(F.col("n_") >= most).select("start")
        parts.append(near if d == hops else near.join(full.hint("merge"), "start", "left_semi"))
        if d < hops:
            open_ = kept(open_.join(full.select(F.col("start").alias("node")).hint("merge"), "node", "left_anti"), "ego-open")
            if open_.isEmpty():
                break
    found = parts[0]
    for other in parts[1:]:
        found = found.unionByName(other)
    found = found.join(degree.hint("merge"), "node", "left")
    w = Window.partitionBy("start").orderBy("depth", F.desc_nulls_last("degree"), "node")
    return found.withColumn("n_", F.row_number().over(w)).filter(F.col("n_") <= most).select("start", "node", "depth")


class Overview:
    """A readable part of a large graph: its nodes, the edges among them, and what was left out.

    nodes: node, matched (whether it passes the filters), claims, community. edges: a, b, each once. The best connected nodes that
    pass are chosen, at most `most`; nodes without edges never are. With `grow` (a search) their neighbours fill up what room is left,
    those of the first chosen first; then bridges do, nodes that two or more chosen ones touch, the most linked first. A
    node that no edge among the chosen touches is dropped. Ties go by node. What is chosen has at most `most` rows, so it is
    broadcast; edges are written once and never collected.

    Defined results: null nodes and ends, loops and repeated edges don't count; edges to unknown nodes neither."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, most: int, grow: bool = False):
        known = nodes.filter("node IS NOT NULL").dropDuplicates(["node"])
        both = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        both = both.join(known.select(F.col("node").alias("a")), "a", "left_semi").join(known.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")
        self.known, self.pairs = kept(known, "overview-nodes"), kept(both, "overview-edges")
        self.touching = self.pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        self.degree = kept(self.touching.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("total_degree")), "overview-degrees")
        self.candidates = self.known.filter("matched").join(self.degree.hint("merge"), "node")
        first = self.candidates.orderBy(F.desc("total_degree"), F.desc("claims"), "node").limit(most).select("node", "total_degree", "claims")
        w = Window.orderBy(F.desc("total_degree"), F.desc("claims"), "node")  # of `most` rows
        chosen = kept(first.select("node", F.row_number().over(w).alias("place"), F.lit(True).alias("hit")), "overview-chosen")
        self.n_first = room = chosen.count()
        if grow and 0 < room < most:
            chosen = self._more(chosen, most - room, [F.min("place").alias("by"), F.lit(1).alias("links")], 1)
            room = chosen.count()
        if 0 < room < most:
            chosen = self._more(chosen, most - room, [(-F.count("*")).alias("by"), F.count("*").alias("links")], 2)
        self.chosen = chosen

    def _more(self, chosen: DataFrame, room: int, how: list, least: int) -> DataFrame:
        """chosen and its neighbours with at least so many links, by `by`, as many as there is room for."""
        near = self.touching.join(F.broadcast(chosen.select(F.col("node").alias("a"), "place")), "a")
        near = near.groupBy(F.col("b").alias("node")).agg(*how).filter(F.col("links") >= least)
        near = near.join(F.broadcast(chosen.select("node")), "node", "left_anti").orderBy("by", "node").limit(room)
        return kept(chosen.unionByName(near.select("node", F.lit(None).cast("int").alias("place"), F.lit(False).alias("hit"))), "overview-chosen")

    def edges(self) -> DataFrame:
        ends = F.broadcast(self.chosen.select("node"))
        return self.pairs.join(ends.withColumnRenamed("node", "a"), "a", "left_semi").join(ends.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")

    def nodes(self) -> DataFrame:
        """node, community, claims, degree (among the chosen), total_degree, hit."""
        inner = self.edges().select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        rows = self.known.join(F.broadcast(self.chosen.select("node", "hit")), "node").join(inner.hint("merge"), "node").join(self.degree.hint("merge"), "node")
        return rows.select("node", "community", "claims", "degree", "total_degree", "hit")

    def communities(self) -> DataFrame:
        return self.nodes().filter("community IS NOT NULL").groupBy("community").agg(F.count("*").alias("n"))

    def counts(self) -> DataFrame:
        """One row: nodes, edges, connected and isolated nodes of the graph, candidates left out, chosen nodes that were dropped."""
        parts = [
            self.known.agg(F.count("*").alias("total_nodes")), self.pairs.agg(F.count("*").alias("total_edges")), self.degree.agg(F.count("*").alias("connected")),
            self.candidates.agg((F.count("*") - F.lit(self.n_first)).alias("omitted")), self.chosen.agg(F.count("*").alias("chosen_")), self.nodes().agg(F.count("*").alias("shown")),
        ]
        one = parts[0]
        for other in parts[1:]:  # a row each
            one = one.join(F.broadcast(other), how="cross")
        isolated, dropped = F.col("total_nodes") - F.col("connected"), F.col("chosen_") - F.col("shown")
        return one.select("total_nodes", "total_edges", "connected", isolated.alias("isolated"), "omitted", dropped.alias("dropped"), (F.col("omitted") > 0).alias("truncated"))


def communities(edges: DataFrame, rounds: int = 8, levels: int = 3, seed: int = 1) -> DataFrame:
    """(node, community) by modularity: in each round a hashed half of the nodes moves to the neighbouring community of the
    largest gain; then communities become nodes. Only nodes are looked at that moved, whose neighbours moved, or whose turn has not come
    since. After the levels, single nodes move once more between the communities that were found, and communities that fall apart are
    split. Ids are from 1 by smallest member. edges: a, b, weight, both ways."""
    edges = kept(edges.select("a", "b", "weight"), "community-edges")
    total = edges.agg(F.sum("weight")).first()[0]
    near, strength = _neighbours(edges)
    member = kept(strength.select("node", F.col("node").alias("c")), "community-of")
    if not total:
        return member.select("node", F.col("c").alias("community"))
    level_near, level_strength, of = near, strength, member
    for level in range(levels):
        of, moved = _settle(level_near, level_strength, of, total, rounds, f"{seed} {level}")
        member = kept(member.join(of.select(F.col("node").alias("c"), F.col("c").alias("d")).hint("merge"), "c").select("node", F.col("d").alias("c")), "community-of")
        if not moved or level == levels - 1:
            break
        half = _told(level_near, of.select("node", F.col("c").alias("y")), of.count()).groupBy(F.col("to").alias("a"), "y").agg(F.sum("weight").alias("weight"))
        level_edges = half.join(of.select(F.col("node").alias("a"), F.col("c").alias("x")).hint("merge"), "a").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("weight").alias("weight"))
        level_near, level_strength = _neighbours(kept(level_edges, "community-edges"))
        of = kept(level_strength.select("node", F.col("node").alias("c")), "community-level")
    member, _ = _settle(near, strength, member, total, rounds, f"{seed} last")
    member = _connected(near, member)
    low = member.groupBy("c").agg(F.min("node").alias("low"))
    return member.join(numbered(low, [F.col("low")], "community").hint("merge"), "c").select("node", "community")


def _neighbours(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, to, weight), dealt by node once and kept so, as each round joins it by node; and (node, k), what the edges of a node weigh
    together. edges: a written table."""
    near = bucketed(edges.select(F.col("a").alias("node"), F.col("b").alias("to"), "weight"), edges.count(), "node", "community-near")
    return near, kept(near.groupBy("node").agg(F.sum("weight").alias("k")), "community-strength")


def _told(near: DataFrame, what: DataFrame, n_nodes: int) -> DataFrame:
    """What is said of a node (node, and more, at most n_nodes rows), told to each of its neighbours: node, to, weight, and more. Edges stay
    where they are; a few hundred thousand nodes are broadcast, more are shuffled to them."""
    return near.join(what.hint("broadcast" if n_nodes <= 500_000 else "shuffle_hash"), "node")


def _settle(near: DataFrame, strength: DataFrame, of: DataFrame, total: float, rounds: int, seed: str) -> tuple[DataFrame, bool]:
    """(node, c) after rounds of moves from a start (node, c), and whether any node moved; ends when both halves of the nodes stay.

    In a round nodes tell their neighbours whose turn it is their community and what it weighs; what a node hears is shuffled once, by
    that node, and added up and judged there. Where few nodes are looked at, these ask their neighbours instead."""
    turn = lambda node, r: F.pmod(F.xxhash64(F.lit(seed), F.lit(r), F.col(node)), F.lit(2)) == 0
    n_nodes, n_edges = of.count(), near.count()
    moved_any, work, n_work, quiet = False, of.select(F.col("node").alias("w_")), n_nodes, 0
    for r in range(rounds):
        own = of.join(strength.hint("merge"), "node")
        own = kept(own.join(own.groupBy("c").agg(F.sum("k").alias("s")).hint("merge"), "c").select("node", "c", "k", "s"), "community-own")
        asked = work.filter(turn("w_", r))
        if 4 * n_work > n_nodes:
            heard = _told(near, own.select("node", F.col("c").alias("x"), "s"), n_nodes).filter((F.col("node") != F.col("to")) & turn("to", r)).select(F.col("to").alias("a"), F.col("x").alias("to"), "s", "weight")
            heard = dealt(heard, n_edges // 2, "a").join(asked.hint("shuffle_hash"), F.col("a") == F.col("w_"), "left_semi")
        else:
            ask = _told(near, asked.select(F.col("w_").alias("node")), n_work).filter(F.col("node") != F.col("to")).select(F.col("node").alias("a"), F.col("to").alias("b"), "weight")
            heard = dealt(ask, n_edges * n_work // max(1, 2 * n_nodes), "b").join(own.select(F.col("node").alias("b"), F.col("c").alias("to"), "s").hint("shuffle_hash"), "b").select("a", "to", "s", "weight")
        cand = heard.groupBy("a", "to").agg(F.sum("weight").alias("w"), F.first("s").alias("s"))
        cand = cand.join(own.select(F.col("node").alias("a"), F.col("c").alias("own"), "k").hint("shuffle_hash"), "a")
        gain = F.col("w") - F.col("k") * (F.col("s") - F.when(F.col("to") == F.col("own"), F.col("k")).otherwise(0.0)) / total
        best = cand.withColumn("g", F.round(gain, 9)).groupBy("a").agg(F.max_by(F.struct("to", "g"), F.struct("g", -F.col("to"))).alias("best"), F.max(F.when(F.col("to") == F.col("own"), F.col("g"))).alias("stay"))
        better = F.col("best.g") > F.coalesce("stay", F.lit(0.0)) + 1e-9
        next_ = kept(of.join(best.hint("merge"), F.col("node") == F.col("a"), "left").select("node", "c", F.when(better, F.col("best.to")).otherwise(F.col("c")).alias("n")), "community-level")
        changed = next_.filter("c <> n").select(F.col("node").alias("m_"))
        of = next_.select("node", F.col("n").alias("c"))
        touched = _told(near, changed.select(F.col("m_").alias("node")), n_nodes).select(F.col("to").alias("w_"))
        work = kept(touched.unionByName(changed.select(F.col("m_").alias("w_"))).unionByName(work.filter(~turn("w_", r))).distinct(), "community-work")
        moved, n_work = not changed.isEmpty(), work.count()
        moved_any, quiet = moved_any or moved, 0 if moved else quiet + 1
        if quiet == 2 or not n_work:
            break
    return of, moved_any


def _connected(near: DataFrame, member: DataFrame) -> DataFrame:
    """member (node, c) with communities that fall apart split into their connected parts; c is then the least node of each."""
    inner = dealt(_told(near, member, member.count()).filter("node < to").select("node", "c", "to"), near.count() // 2, "to")
    inner = inner.join(member.select(F.col("node").alias("to"), F.col("c").alias("y_")).hint("shuffle_hash"), "to").filter("c = y_")
    part = links(inner.select(F.col("node").alias("a"), F.col("to").alias("b"))).select(F.col("node").alias("n_"), "root")
    return kept(member.join(part.hint("merge"), F.col("node") == F.col("n_"), "left").select("node", F.coalesce("root", "node").alias("c")), "community-of")


def modularity(edges: DataFrame, of: DataFrame) -> DataFrame:
    """One row: modularity of communities (node, community) on edges a, b, weight, both ways."""
    e = edges.join(of.select(F.col("node").alias("a"), F.col("community").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("community").alias("y")), "b")
    total = e.agg(F.sum("weight").alias("m"))
    inner = e.groupBy("x").agg(F.sum(F.when(F.col("x") == F.col("y"), F.col("weight")).otherwise(0.0)).alias("i"), F.sum("weight").alias("k"))
    both = inner.join(F.broadcast(total), how="cross")  # total is one row
    return both.agg(F.sum(F.col("i") / F.col("m") - (F.col("k") / F.col("m")) ** 2).alias("modularity"))


def tree_depths(rows: DataFrame, most: int = 12) -> DataFrame:
    """(id, depth): roots are rows whose parent is missing or unknown; nodes in a loop, or deeper than `most`, have none."""
    known = rows.select(F.col("id").alias("p_"))
    sound = rows.join(known, F.col("parent_id") == F.col("p_"), "left").select("id", F.when(F.col("parent_id") != F.col("id"), F.col("p_")).alias("parent_id"))
    sound = kept(sound, "tree")
    found = level = kept(sound.filter("parent_id IS NULL").select("id", F.lit(0).alias("depth")), "tree-level")
    for d in range(1, most + 1):
        level = kept(sound.join(level.select(F.col("id").alias("parent_id")), "parent_id").select("id", F.lit(d).alias("depth")), "tree-level")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return sound.select("id").join(found, "id", "left")


def topic_tree(rows: DataFrame, active_claims: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """(id, parent_id, depth, claim_count, rel_count, all_claims): each topic under its known parent, with its own claims, the ends of
    relations at it, and the claims of all that is below it. rows: id, parent_id; active_claims: topic_id; edges: a, b. Unknown and own
    parents are none; topics in a loop, or deeper than `most`, have no depth and count for themselves alone. A topic's claims are sent
    up to each of its ancestors, at most `most` rows a topic, and added before the shuffle."""
    depths = kept(tree_depths(rows, most), "tree-depths")
    known = depths.filter("depth IS NOT NULL").select("id")
    parents = rows.select("id", "parent_id").filter("parent_id <> id").join(known.hint("merge"), "id", "left_semi")
    parents = kept(parents.join(known.select(F.col("id").alias("parent_id")).hint("merge"), "parent_id", "left_semi").select("id", "parent_id"), "tree-parents")
    own = active_claims.filter("topic_id IS NOT NULL").groupBy(F.col("topic_id").alias("c_")).agg(F.count("*").alias("claims"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("r_")).groupBy("r_").agg(F.count("*").alias("rels"))
    base = depths.join(own.hint("merge"), F.col("id") == F.col("c_"), "left").join(ends.hint("merge"), F.col("id") == F.col("r_"), "left")
    base = kept(base.select("id", "depth", F.coalesce("claims", F.lit(0)).alias("claim_count"), F.coalesce("rels", F.lit(0)).alias("rel_count")), "tree-counts")
    level = base.filter("claim_count > 0").select("id", F.col("claim_count").alias("n"))
    sums = [level]
    up = parents.select(F.col("id").alias("u_"), "parent_id")
    for _ in range(most):
        level = level.join(up.hint("merge"), F.col("id") == F.col("u_")).groupBy(F.col("parent_id").alias("id")).agg(F.sum("n").alias("n"))
        level = kept(level, "tree-sums")
        if level.isEmpty():
            break
        sums.append(level)
    every = sums[0]
    for x in sums[1:]:
        every = every.unionByName(x)
    total = every.groupBy(F.col("id").alias("a_")).agg(F.sum("n").alias("all_claims"))
    out = base.join(total.hint("merge"), F.col("id") == F.col("a_"), "left").join(up.hint("merge"), F.col("id") == F.col("u_"), "left")
    return out.select("id", "parent_id", "depth", "claim_count", "rel_count", F.coalesce("all_claims", F.lit(0)).cast("long").alias("all_claims"))


def needs_rebuild(rows: DataFrame) -> DataFrame:
    """One row: topics, those with parents, and whether there are too few of these to place new ones among (under 3, over 5 topics)."""
    n = rows.agg(F.count("*").alias("n_topics"), F.count("parent_id").alias("n_placed"))
    return n.withColumn("needs_rebuild", (F.col("n_placed") < 3) & (F.col("n_topics") > 5))


def assign_parents(rows: DataFrame, placements: DataFrame) -> DataFrame:
    """(id, parent_id): topics without a parent get the first of their placements (id, parent_id, place) whose parent is known and not
    the topic itself; the others keep theirs. Where the tree needs a full rebuild, nothing is placed."""
    known = rows.select(F.col("id").alias("k_")).distinct()
    good = placements.filter("id <> parent_id").join(known.hint("merge"), F.col("parent_id") == F.col("k_"), "left_semi")
    first = good.groupBy(F.col("id").alias("p_")).agg(F.min_by("parent_id", F.struct("place", "parent_id")).alias("given_"))
    gate = needs_rebuild(rows).select("needs_rebuild")
    out = rows.select("id", "parent_id").join(first.hint("merge"), F.col("id") == F.col("p_"), "left").join(F.broadcast(gate), how="cross")  # gate is one row
    return out.select("id", F.when(F.col("parent_id").isNull() & ~F.col("needs_rebuild"), F.col("given_")).otherwise(F.col("parent_id")).alias("parent_id"))


def break_cycles(rows: DataFrame) -> DataFrame:
    """(id, parent_id): unknown and own parents go, and so does that of every node whose chain of parents comes to a loop.
    Chains double in length each round; what has no end after as many steps as there are nodes is in a loop."""
    known = rows.select(F.col("id").alias("p_"))
    sound = rows.filter("parent_id <> id").select("id", "parent_id").join(known.hint("merge"), F.col("parent_id") == F.col("p_"), "left_semi")
    up, steps = kept(sound, "cycle"), 1
    sound, open_ = up, up.count()
    while open_ and steps <= open_:  # only chains that go on are joined: no ended one weighs on the key null
        two = up.select(F.col("id").alias("m_"), F.col("parent_id").alias("t_"))
        up = kept(up.join(two.hint("merge"), F.col("parent_id") == F.col("m_")).select("id", F.col("t_").alias("parent_id")), "cycle-up")
        open_, steps = up.count(), steps * 2
    straight = sound.join(up.select("id").hint("merge"), "id", "left_anti")
    return rows.select("id").join(straight.hint("merge"), "id", "left").select("id", "parent_id")
