"""Near-duplicate embeddings by dual traversal of cover trees.

1. Vectors that cannot be compared are set aside; equal vectors of a label are
   one class, its smallest id stands for it.
2. The classes of a label are a cell.  A cell of over ``BLOCK`` classes is split:
   some of its classes, about one for each ``BLOCK`` and ``PIVOTS`` at most, are
   centres, and every class goes to the nearest.  This is repeated for ``LEVELS``
   levels at most, so cells grow in number with the data and stay local; what is
   still too large then (a dense group) is cut by hash.
3. Pairs of cells are followed down the levels: a pair goes on only if its balls
   come within the threshold.  Each pair of last cells meets in one task, builds
   a cover tree of either (levels with halving radii) and walks both trees at
   once, dropping node pairs whose centres are farther apart than both radii and
   the threshold together.
4. A meeting returns, for each class, how many vectors it is linked to, and the
   links of a spanning forest, never all pairs of a dense group.

Centres are rows of tables like all else; nothing is collected or broadcast.
Copies of one vector are dealt to several tasks (:func:`salted_join`).

Defined results: null or unequal labels, and vectors that are null, empty, zero
or hold null or non-finite components link with nothing; vectors of different
lengths do not compare; repeated ids are one node, their copies count as links;
0.0 and -0.0 are equal; a class that is as near to two centres goes to the one of
the smaller id; an empty table gives no rows.  Columns other than vec_id, label
and embedding are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import salted_join, table, written
from framewright.llm.components import components

THRESHOLD = 0.93
#: Classes in a block, about.
BLOCK = 1024
#: Centres that a cell is split by, about, at most.
PIVOTS = 64
#: Times that a cell is split at most.
LEVELS = 5
#: Classes of a cell that one task compares with the cell's centres, about.
GROUP = 50_000
#: Points of a tree node that is not split further.
LEAF = 24


class Node:
    """A ball: centre, covering radius, and either children or the rows it holds."""

    __slots__ = ("centre", "radius", "children", "rows")

    def __init__(self, centre, radius, children, rows):
        self.centre, self.radius, self.children, self.rows = centre, radius, children, rows


def cover_tree(x: np.ndarray, rows: np.ndarray | None = None, centre: int | None = None, radius: float | None = None) -> Node:
    """A tree over the rows of unit vectors ``x``; a child's scale is half its parent's.

    Centres of siblings lie more than half the parent's scale apart, and the
    first child keeps the parent's centre (nesting).
    """
    rows = np.arange(len(x)) if rows is None else rows
    centre = int(rows[0]) if centre is None else centre
    far = np.sqrt(np.maximum(((x[rows] - x[centre]) ** 2).sum(axis=1), 0))
    own = float(far.max())
    if len(rows) <= LEAF or own == 0:
        return Node(centre, own, [], rows)
    half, left, children = (own if radius is None else min(own, radius)) / 2, rows, []
    pick = centre
    while len(left):
        near = ((x[left] - x[pick]) ** 2).sum(axis=1) <= half * half
        near |= left == pick
        children.append(cover_tree(x, left[near], pick, half))
        left = left[~near]
        if len(left):
            pick = int(left[0])
    return Node(centre, own, children, rows)


def dual_pairs(x: np.ndarray, a: Node, y: np.ndarray, b: Node, reach: float):
    """Blocks of rows (of x, of y) that can hold pairs within ``reach``."""
    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        if not p.children and not q.children:
            yield p.rows, q.rows
            continue
        left, right = p.children or [p], q.children or [q]
        one, two = x[[n.centre for n in left]], y[[n.centre for n in right]]
        gap = np.sqrt(np.maximum(2 - 2 * (one @ two.T), 0))
        bound = np.array([n.radius for n in left])[:, None] + np.array([n.radius for n in right])[None, :] + reach + 1e-7
        hits = gap <= bound
        # Single points need no descent: whole rows of them are compared at once.
        lone_l, lone_r = np.array([n.radius == 0 and not n.children for n in left]), np.array([n.radius == 0 and not n.children for n in right])
        flat = np.argwhere(hits & lone_l[:, None] & lone_r[None, :])
        if len(flat):
            for i in np.unique(flat[:, 0]):
                yield left[i].rows, np.concatenate([right[j].rows for j in flat[flat[:, 0] == i, 1]])
        stack += [(left[i], right[j]) for i, j in np.argwhere(hits & ~(lone_l[:, None] & lone_r[None, :]))]


def threshold_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with cosine(x[i], y[j]) >= threshold in double precision; ``same``: i < j only."""
    if not len(x) or not len(y):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    ux, uy = x / nx[:, None], y / ny[:, None]
    reach = float(np.sqrt(max(2 - 2 * threshold, 0)))
    tree = cover_tree(ux)
    found = []
    for r, s in dual_pairs(ux, tree, uy, tree if same else cover_tree(uy), reach):
        i, j = np.nonzero(ux[r] @ uy[s].T >= threshold - 1e-9)
        if len(i):
            found.append((r[i], s[j]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(f) for f in zip(*found))
    keep = np.ones(len(i), bool) if not same else i < j
    i, j = i[keep], j[keep]
    exact = np.empty(len(i))
    for k in range(0, len(i), 65_536):
        a, b = i[k : k + 65_536], j[k : k + 65_536]
        exact[k : k + 65_536] = (x[a] * y[b]).sum(axis=1) / (nx[a] * ny[b])
    return i[exact >= threshold], j[exact >= threshold]


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    parent: dict[int, int] = {}

    def top(v: int) -> int:
        parent.setdefault(v, v)
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            parent[x] = y
            kept.append(k)
    return kept


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _meeting(threshold: float, pairs: bool):
    def run(rows: pa.Table) -> pa.Table:
        side = np.asarray(rows.column("side"))
        rep, many = np.asarray(rows.column("rep")), np.asarray(rows.column("many"))
        x = _matrix(rows.column("v"))
        same = not (side == 1).any() and bool((np.asarray(rows.column("one")) == np.asarray(rows.column("two"))).all())
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        i, j = threshold_pairs(x[left], x[right], threshold, same)
        a, b = left[i], right[j]
        if pairs:
            return pa.table({"a": pa.array(rep[a], pa.int64()), "b": pa.array(rep[b], pa.int64()), "n": pa.array(np.zeros(len(a)), pa.int64())})
        ends = np.concatenate([a, b])
        linked = np.bincount(ends, np.concatenate([many[b], many[a]]), len(rep)).astype(np.int64)
        some = np.flatnonzero(linked)
        edge = _forest(rep[a], rep[b])
        return pa.table(
            {
                "a": pa.array(np.concatenate([rep[some], rep[a][edge]]), pa.int64()),
                "b": pa.array(np.concatenate([rep[some], rep[b][edge]]), pa.int64()),
                "n": pa.array(np.concatenate([linked[some], np.zeros(len(edge), np.int64)]), pa.int64()),
            }
        )

    return run


def _comparable(vectors: DataFrame) -> DataFrame:
    ok = "size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.expr("transform(cast(embedding as array<double>), x -> x + 0d)").alias("v")).where(  # no -0.0
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.expr(ok), F.lit(False))
    )


_CELL = ["label", "dim", "cell"]


def _nearest(rows: pa.Table, centres: pa.Table) -> pa.Table:
    """Classes of one cell with the nearest of its centres and their distance from it."""
    x = _matrix(rows.column("v"))
    c = np.array(centres.column("centres")[0].as_py(), np.float64) if centres.num_rows and rows.num_rows else np.ones((1, x.shape[1]))
    cosine = (x / np.sqrt((x * x).sum(axis=1))[:, None]) @ (c / np.sqrt((c * c).sum(axis=1))[:, None]).T
    best = cosine.argmax(axis=1)
    far = np.sqrt(np.maximum(2 - 2 * cosine[np.arange(len(x)), best], 0))
    child = pa.array([f"{cell}/{k:04d}" for cell, k in zip(rows.column("cell").to_pylist(), best.tolist())], pa.string())
    return rows.select(["label", "dim", "rep", "many", "v"]).append_column("cell", child).append_column("far", pa.array(far))


def _split(placed: DataFrame, large: DataFrame, block: int, level: int) -> tuple[DataFrame, DataFrame]:
    """The classes of the cells ``large`` dealt to new cells, and the new cells: cell, parent, centre."""
    own = written(salted_join(placed, large, _CELL, ["rep"]).drop("far"))
    share = 1.5 * F.least(F.col("n") / block, F.lit(PIVOTS)) / F.col("n")
    chosen = (F.pmod(F.xxhash64(F.lit(level), "rep"), F.lit(1 << 40)) < share * (1 << 40)) | (F.col("rep") == F.col("first"))
    centres = own.where(chosen).groupBy(*_CELL, "n").agg(F.array_sort(F.collect_list(F.struct("rep", "v"))).alias("c"))  # about 1.5 PIVOTS at most
    centres = written(centres.withColumn("centres", F.transform("c", lambda s: s["v"])).drop("c"))
    many = F.ceil(F.col("n") / GROUP)
    dealt = own.withColumn("g", F.pmod(F.xxhash64(F.lit(5), "rep"), many).cast("int")).drop("n", "first")
    copies = centres.withColumn("g", F.explode(F.sequence(F.lit(0), (many - 1).cast("int"))))
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in ("label", "dim", "rep", "many", "v")) + ", cell string, far double"
    out = dealt.groupBy(*_CELL, "g").cogroup(copies.groupBy(*_CELL, "g")).applyInArrow(_nearest, schema)
    named = centres.select("label", "dim", F.col("cell").alias("parent"), F.posexplode("centres").alias("k", "centre"))
    return written(out), named.withColumn("cell", F.concat_ws("/", "parent", F.lpad(F.col("k").cast("string"), 4, "0"))).drop("k")


def _cells(placed: DataFrame) -> DataFrame:
    return written(placed.groupBy(*_CELL).agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.min("rep").alias("first")))


def _met(classes: DataFrame, threshold: float, pairs: bool, block: int) -> DataFrame:
    """Meetings of the last cells of ``classes`` (label, dim, v, rep, many)."""
    reach = float(np.sqrt(max(2 - 2 * threshold, 0)))
    placed = classes.withColumn("cell", F.lit("")).withColumn("far", F.lit(2.0))
    alive = _cells(placed).withColumn("centre", F.lit(None).cast("array<double>"))
    meet = alive.select("label", "dim", F.col("cell").alias("one"), F.col("cell").alias("two"))
    last = []
    for level in range(LEVELS):
        large, small = alive.where(F.col("n") > block), alive.where(F.col("n") <= block)
        if large.isEmpty():
            break
        last.append(salted_join(placed, small.select(*_CELL, "n"), _CELL, ["rep"]).drop("far", "n"))
        placed, named = _split(placed, large.select(*_CELL, "n", "first"), block, level)
        new = named.join(_cells(placed), _CELL)
        # A pair goes on as the pairs of its cells' children that come near enough; a cell that is not split is its own child.
        child = written(new.unionByName(small.withColumn("parent", F.col("cell"))))
        alive = child.drop("parent")
        a = child.select("label", "dim", F.col("parent").alias("one"), F.col("cell").alias("a"), F.col("centre").alias("ca"), F.col("radius").alias("ra"))
        b = child.select("label", "dim", F.col("parent").alias("two"), F.col("cell").alias("b"), F.col("centre").alias("cb"), F.col("radius").alias("rb"))
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
        cosine = dot("ca", "cb") / F.sqrt(dot("ca", "ca") * dot("cb", "cb"))
        near = F.coalesce(F.sqrt(F.greatest(2 - 2 * cosine, F.lit(0.0))) <= F.col("ra") + F.col("rb") + reach + 1e-6, F.lit(True))
        meet = meet.join(a, ["label", "dim", "one"]).join(b, ["label", "dim", "two"]).where((F.col("one") < F.col("two")) | (F.col("a") <= F.col("b"))).where(near)
        meet = written(meet.select("label", "dim", F.least("a", "b").alias("one"), F.greatest("a", "b").alias("two")))
    final = placed.drop("far")
    for p in last:
        final = final.unionByName(p)
    parts = alive.select(*_CELL, "n", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    dealt = salted_join(final, parts.drop("n"), _CELL, ["rep"]).withColumn("part", F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("parts")).cast("int")).drop("parts")
    each = parts.select(*_CELL, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    side = lambda k: each.select("label", "dim", F.col("cell").alias(k), F.concat_ws("#", "cell", "part").alias(f"{k}_block"))
    meet = meet.join(side("one"), ["label", "dim", "one"]).join(side("two"), ["label", "dim", "two"]).where("one < two or one_block <= two_block")
    meet = written(meet.select("label", "dim", F.col("one_block").alias("one"), F.col("two_block").alias("two")))
    dealt = dealt.withColumn("block", F.concat_ws("#", "cell", "part")).drop("cell", "part")
    sides = dealt.join(meet.withColumn("block", F.col("one")), ["label", "dim", "block"]).withColumn("side", F.lit(0)).unionByName(
        dealt.join(meet.where("one <> two").withColumn("block", F.col("two")), ["label", "dim", "block"]).withColumn("side", F.lit(1))
    )
    return sides.drop("block").groupBy("label", "dim", "one", "two").applyInArrow(_meeting(threshold, pairs), "a bigint, b bigint, n bigint")


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    valid = _comparable(vectors).withColumn("dim", F.size("v"))
    classes = written(valid.groupBy("label", "dim", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")))
    return valid, classes


def near_pairs(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Exact pairs (a, b), a < b, of class representatives of equal label at or above ``threshold``.

    All of them: a dense group of n classes gives about n²/2 rows.  Links and
    components of such groups are what :func:`near_vectors` is for.
    """
    found = _met(_classes(vectors)[1], threshold, True, block)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    valid, classes = _classes(vectors)
    met = written(_met(classes, threshold, False, block))
    links = met.where("a = b and n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    member = written(salted_join(valid, classes, ["label", "dim", "v"], ["vec_id"]).select("vec_id", "rep", "many"))
    # An id with unlike vectors ties their classes together; all other members follow their class.
    both = member.groupBy("vec_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("vec_id")
    edges = met.where("a <> b").select("a", "b").union(member.join(both, "vec_id").select(F.col("rep").alias("a"), F.col("vec_id").alias("b")))
    found = salted_join(member, components(edges).withColumnRenamed("node", "rep"), ["rep"], ["vec_id"], "left")
    found = found.groupBy("vec_id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    counts = salted_join(member, links, ["rep"], ["vec_id"], "left").groupBy("vec_id").agg(F.sum(F.col("many") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    out = every.where("vec_id is not null").join(counts, "vec_id", "left").join(found, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    # Rows without an id have nothing to join on: they do not meet in one task.
    out = out.unionByName(every.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's links over all ``embeddings``."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
         WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(x, y) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM link GROUP BY x)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, comp.component_id, e.vec_id = comp.component_id AS kept
FROM e JOIN comp ON comp.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id
"""
