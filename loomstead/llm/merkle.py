"""Merkle manifest of a dataset by incremental witnesses.

Every row is a leaf; the leaves of a source make a tree of runs of three, the subroots of the sources make one more. A leaf's witness
is, level by level, what stands left and right of its node in its run: hashing the node between them climbs the tree, so a
reader who trusts the root can check one row by its witness alone.

Leaves are numbered in each source without a task that holds one source, and dealt to blocks of 3^7 whose places are aligned, so
that each block is a whole subtree. A task streams through its blocks in order (`Witnesses.append`): what a level lacks to a
run of three stays open with the partial witnesses of the leaves below, and when the siblings come, the witnesses of all three are extended
and their parent moves up. A block's end closes its open runs. Block roots are then leaves of the next tree of blocks, further
appends to the same witnesses, until every source has one root; sources' subroots go the same way once more. A round has
3^7 times fewer rows than the one before, so nothing is ever gathered in one place but the rows of one block.

`manifest` builds the tree of any table; `proven` folds rows that are given again (perhaps changed) with the witnesses they had.

Defined results: nulls are `-` in a leaf, a null id or source comes first; rows of one id in a source are ordered by their leaf, and
equal rows are leaves of equal hash, each with its own place (which of them has which is open, the set of rows is not);
an empty table gives an empty manifest; a lone source's subroot is the root. Other columns of the table are not read, whatever
their names; helper columns are in tables of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.llm.common import crc32_text, sized_join, written

#: Nodes of a run, and levels of a block.
RUN, LEVELS = 3, 7
_UP = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


class Witnesses:
    """An append-only tree of so many levels at most, with the witness of every leaf appended so far."""

    def __init__(self, levels: int) -> None:
        self.n, self.levels = 0, levels
        self.witness: list[list[tuple[str, str]]] = []
        self.open: list[list[tuple[str, range]]] = [[] for _ in range(levels + 1)]

    def append(self, node: str) -> None:
        self.witness.append([])
        self._put(0, node, range(self.n, self.n + 1))
        self.n += 1

    def _put(self, level: int, node: str, below: range) -> None:
        self.open[level].append((node, below))
        if len(self.open[level]) == RUN and level < self.levels:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """A run has all its siblings: the witnesses below each are extended by the others, and their parent moves up."""
        run, self.open[level] = self.open[level], []
        for i, (_, below) in enumerate(run):
            step = "".join(x for x, _ in run[:i]), "".join(x for x, _ in run[i + 1 :])
            for k in below:
                self.witness[k].append(step)
        parent = hashlib.sha256("".join(x for x, _ in run).encode()).hexdigest()
        self._put(level + 1, parent, range(run[0][1].start, run[-1][1].stop))

    def close(self, height: int) -> str:
        """The root at a height; runs that are open are completed as they are."""
        for level in range(height):
            if self.open[level]:
                self._complete(level)
        return self.open[height][0][0]


def height(n: int) -> int:
    """Levels of a tree over n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


_BLOCKS = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("n", pa.int64()), ("up", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))), ("root", pa.string())])


def _streamed(levels: int):
    """Rows in order of (tree, place) to their witnesses within their block, and the block's root on the last row of each."""

    def flush(tree, places: list[int], w: Witnesses, n: int) -> pa.RecordBatch:
        root = w.close(min(levels, height(n)))
        up = [[{"before": b, "after": a} for b, a in steps] for steps in w.witness]
        return pa.RecordBatch.from_pydict({"tree": [tree] * len(places), "place": places, "n": [n] * len(places), "up": up, "root": [None] * (len(places) - 1) + [root]}, schema=_BLOCKS)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, places, w, total = None, [], Witnesses(levels), 0
        for batch in batches:
            for tree, place, n, node in zip(*(batch.column(c).to_pylist() for c in ("tree", "place", "n", "node"))):
                if (tree, place // RUN**levels) != key:
                    if places:
                        yield flush(key[0], places, w, total)
                    key, places, w, total = (tree, place // RUN**levels), [], Witnesses(levels), n
                w.append(node)
                places.append(place)
        if places:
            yield flush(key[0], places, w, total)

    return stream


def grown(nodes: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Trees over (tree, place from 0, n of the tree, node): the witness `up` of each (tree, place), and (tree, root)."""
    size = RUN**levels
    block = F.floor(F.col("place") / size).cast("long")
    dealt = nodes.select("tree", "place", "n", "node").repartition("tree", block).sortWithinPartitions("tree", "place")
    out = written(dealt.mapInArrow(_streamed(levels), f"tree string, place long, n long, up {_UP}, root string"), "merkle-blocks")
    roots = out.filter("root IS NOT NULL").select("tree", block.alias("place"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("root").alias("node"))
    witness = out.select("tree", "place", "up")
    if out.filter(F.col("n") > size).limit(1).count() == 0:
        return witness, roots.select("tree", F.col("node").alias("root"))
    above, tops = grown(roots, levels)
    above = above.select(F.col("tree").alias("t_"), F.col("place").alias("b_"), F.col("up").alias("more"))
    joined = sized_join(witness, above, F.col("tree").eqNullSafe(F.col("t_")) & (block == F.col("b_")), "left")
    return joined.select("tree", "place", F.concat("up", "more").alias("up")), tops


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Leaves with their place from 0 in their tree and the tree's number of leaves. Rows are dealt by ranges of (tree, order) and
    numbered within; each range of a tree begins where those before it end. Equal rows are told apart by a row number, so that
    even a range of one key can be dealt to many tasks."""
    salted = leaves.withColumn("salt", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange("tree", *order, "salt").withColumn("part", F.spark_partition_id())
    ranged = written(ranged.sortWithinPartitions("tree", *order, "salt"), "merkle-leaves")
    counts = ranged.groupBy("tree", "part").agg(F.count("*").alias("k"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("tree").alias("t_"), F.col("part").alias("p_"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"), F.sum("k").over(whole).alias("n"))
    within = F.row_number().over(Window.partitionBy("part", "tree").orderBy(*order, "salt"))
    rows = sized_join(ranged.withColumn("within", within), starts, F.col("tree").eqNullSafe(F.col("t_")) & (F.col("part") == F.col("p_")), "left")
    return rows.withColumn("place", (F.col("start") + F.col("within") - 1).cast("long")).drop("part", "salt", "t_", "p_", "start", "within")


def manifest(leaves: DataFrame, order: list[str], levels: int = LEVELS) -> DataFrame:
    """leaves (tree, leaf, and others; order: columns that order a tree's leaves) with subroot, root and the witness `up` of each."""
    leaves = written(placed(leaves, order), "merkle-placed")
    up, tops = grown(leaves.withColumnRenamed("leaf", "node"), levels)
    tops = written(tops, "merkle-subroots")
    forest = tops.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("root").alias("leaf"))
    forest = written(placed(forest, ["of"]), "merkle-sources")  # null first, as Spark and UTF-8 order
    higher, root = grown(forest.withColumnRenamed("leaf", "node"), levels)
    found = root.first()
    higher = forest.join(higher.hint("merge"), ["tree", "place"]).select(F.col("of").alias("of_"), F.col("leaf").alias("subroot"), F.col("up").alias("higher"))
    up = up.select(F.col("tree").alias("t_"), F.col("place").alias("at_"), "up")
    rows = leaves.join(up.hint("merge"), F.col("tree").eqNullSafe(F.col("t_")) & (F.col("place") == F.col("at_"))).drop("t_", "at_")
    rows = sized_join(rows, higher, F.col("tree").eqNullSafe(F.col("of_")), "left").drop("of_")
    return rows.withColumn("up", F.concat("up", "higher")).withColumn("root", F.lit(found.root if found else None).cast("string")).drop("higher")


def proof(up: Column) -> Column:
    """The hash of all siblings of a witness, level by level."""
    return F.sha2(F.concat(F.lit(""), F.array_join(F.transform(up, lambda x: F.concat(x["before"], x["after"])), "")), 256)


def folded(node: Column, up: Column) -> Column:
    """The root that a node and a witness lead to."""
    return F.aggregate(up, node, lambda x, step: digest(step["before"], x, step["after"]))


def proven(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row; see the contract of op13 for what is tampered with."""
    text = F.col("text")
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = (crc32_text(F.col("doc_id").cast("string")) % 2 == 0) & text.contains("\n")
    again = F.when(tampered, leaf(*others, F.translate(text, "\n", "")))  # null where the row is as it was
    rows = manifest(docs.select("doc_id", F.col("source").alias("tree"), leaf(*others, text).alias("leaf"), again.alias("again")), ["doc_id", "leaf"], levels)
    rows = rows.withColumn("folded_root", folded(F.coalesce("again", "leaf"), F.col("up")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("up")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def sql(levels: int = 9, source_levels: int = 4) -> str:
    """The same by one table a level, for at most 3^levels rows a source and 3^source_levels sources."""

    def tree(name: str, start: str, n: int) -> list[str]:
        """Tables name0..: (g, place, many, node, up), many: whether the level has more nodes than one."""
        out = [start]
        for k in range(n):
            last = f"{name}{k}"
            out.append(f"""{name}{k + 1} AS MATERIALIZED (
    SELECT g, place // 3 AS place, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(node, '' ORDER BY place)) ELSE any_value(node) END AS node, (any_value(n) + 2) // 3 AS n
    FROM {last} GROUP BY g, place // 3)""")
        return out

    def sibling(name: str, k: int) -> str:
        at = f"l.place // {3**k}" if name == "s" else f"t.place // {3**k}"
        key = "IS NOT DISTINCT FROM l.g" if name == "s" else "= 0"
        whose = lambda op: f"coalesce((SELECT string_agg(x.node, '' ORDER BY x.place) FROM {name}{k} x WHERE x.g {key} AND x.n > 1 AND x.place // 3 = ({at}) // 3 AND x.place {op} {at}), '')"
        return whose("<"), whose(">")

    steps = [("s", k) for k in range(levels)] + [("r", k) for k in range(source_levels)]
    pairs = [sibling(*x) for x in steps]
    columns = ", ".join(f"{a} AS a{i}, {b} AS b{i}" for i, (a, b) in enumerate(pairs))
    folds = []
    for i, (name, k) in enumerate(steps):
        n = f"(many_s > {3**k})" if name == "s" else f"(many_r > {3**k})"
        folds.append(f"f{i + 1} AS MATERIALIZED (SELECT * EXCLUDE (fold), CASE WHEN {n} THEN sha256(a{i} || fold || b{i}) ELSE fold END AS fold FROM f{i})")
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    whole = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    step = "xor(y >> 1, CASE WHEN y % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)), lambda x, c: list_reduce(list_prepend(xor(x, c), list_transform(range(8), lambda z: 0::UBIGINT)), lambda y, z: {step})), 4294967295::UBIGINT)"
    parts = [
        f"""d AS MATERIALIZED (
    SELECT doc_id, source AS g, sha256({whole} || {field("text")}) AS leaf,
        CASE WHEN {crc} % 2 = 0 THEN sha256({whole} || {field("replace(text, chr(10), '')")}) ELSE sha256({whole} || {field("text")}) END AS again
    FROM documents)""",
        "l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM d)",
        *tree("s", "s0 AS MATERIALIZED (SELECT g, place, leaf AS node, n FROM l)", levels),
        f"t AS MATERIALIZED (SELECT g, node, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM s{levels})",
        *tree("r", "r0 AS MATERIALIZED (SELECT 0 AS g, place, node, n FROM t)", source_levels),
        f"f0 AS MATERIALIZED (SELECT l.doc_id, l.leaf, t.node AS subroot, l.n AS many_s, t.n AS many_r, l.again AS fold, {columns} FROM l JOIN t ON l.g IS NOT DISTINCT FROM t.g)",
        *folds,
    ]
    proof_ = " || ".join(f"a{i} || b{i}" for i in range(len(steps)))
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, r.node AS root, sha256({proof_}) AS proof_sha256, fold AS folded_root, fold = r.node AS verified
FROM f{len(steps)}, r{source_levels} r"""
