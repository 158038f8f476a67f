"""Graph measures on edge tables (snapshot, src, dst) and their vertices (snapshot, name)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut

#: Edges of a snapshot up to which one task searches it for cycles.
LOCAL_EDGES = 200_000


def degrees(vertices: DataFrame, edges: DataFrame, by: tuple[str, ...] = ("snapshot",)) -> DataFrame:
    """Adds fan_in and fan_out to the vertices, zero for isolated ones. ``edges`` are distinct."""
    key = [*by, "name"]
    ends = edges.select(*by, F.col("dst").alias("name"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    ends = ends.unionByName(edges.select(*by, F.col("src").alias("name"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    ends = ends.unionByName(vertices.select(*key, F.lit(0).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy(*key).agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def sizes(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: modules and imports."""
    n = vertices.agg(F.count(F.lit(1)).alias("modules"))
    return n.join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("imports"))))  # a row each


def instability(fan_in: Column, fan_out: Column) -> Column:
    """Share of a module's couplings that point outwards; zero without any."""
    total = fan_in + fan_out
    return F.when(total > 0, fan_out / total).otherwise(F.lit(0.0))


def top(rows: DataFrame, value: str, limit: int, name: str = "name") -> DataFrame:
    """The ``limit`` largest, ties by name."""
    return rows.orderBy(F.desc(value), name).limit(limit)


def cyclic_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """snapshot, name, component (the smallest member) of all vertices on a cycle through another vertex.

    A snapshot whose edges one task can hold is searched there. Larger ones go through rounds of colouring, after edges that
    no cycle can use are trimmed: those from a vertex that none enters or to one that none leaves.
    """
    edges = edges.where("src <> dst").select("snapshot", "src", "dst").distinct()
    sizes = edges.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > local_edges).select("snapshot")
    small = edges.join(large, "snapshot", "left_anti")
    found = small.groupBy("snapshot").applyInArrow(_tarjan, "snapshot string, name string, component string")
    if large.limit(1).count():
        found = found.unionByName(_coloured(edges.join(large, "snapshot", "left_semi")))
    return found


def _tarjan(table: pa.Table) -> pa.Table:
    """Strong components of one snapshot in linear time, without recursion."""
    snapshot = table.column("snapshot")[0].as_py()
    out: dict[str, list[str]] = {}
    for a, b in zip(table.column("src").to_pylist(), table.column("dst").to_pylist()):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    open_: dict[str, None] = {}
    rows = []
    for start in out:
        if start in index:
            continue
        path: list[tuple[str, Iterator[str]]] = []
        entering: str | None = start
        while entering is not None or path:
            if entering is not None:
                index[entering] = low[entering] = len(index)
                open_[entering] = None
                path.append((entering, iter(out[entering])))
                entering = None
            here, rest = path[-1]
            for there in rest:
                if there not in index:
                    entering = there
                    break
                if there in open_:
                    low[here] = min(low[here], index[there])
            if entering is not None:
                continue
            path.pop()
            if path:
                low[path[-1][0]] = min(low[path[-1][0]], low[here])
            if low[here] == index[here]:
                members = []
                while not members or members[-1] != here:
                    members.append(open_.popitem()[0])
                if len(members) > 1:
                    rows += [(snapshot, m, min(members)) for m in members]
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.table([pa.array(c, pa.string()) for c in columns], ["snapshot", "name", "component"])


def _coloured(edges: DataFrame) -> DataFrame:
    """Strong components by rounds of colouring: the largest name that reaches a vertex is its colour, and what reaches
    the namer inside its colour is the namer's component."""
    done: DataFrame | None = None
    edges = cut(edges)
    while edges.limit(1).count():
        edges = _trimmed(edges)
        ends = edges.select("snapshot", F.col("src").alias("name")).unionByName(edges.select("snapshot", F.col("dst").alias("name"))).distinct()
        colour = _spread(ends.withColumn("mark", F.col("name")), edges.select("snapshot", F.col("src").alias("from"), F.col("dst").alias("name")))
        seen = colour.select("snapshot", F.col("name").alias("src"), F.col("mark").alias("m1"))
        inside = edges.join(seen, ["snapshot", "src"]).join(seen.select("snapshot", F.col("src").alias("dst"), F.col("m1").alias("m2")), ["snapshot", "dst"])
        inside = cut(inside.where("m1 = m2").select("snapshot", F.col("dst").alias("from"), F.col("src").alias("name")))
        roots = colour.withColumn("mark", F.when(F.col("mark") == F.col("name"), F.col("name")))
        reached = _spread(roots, inside).where("mark IS NOT NULL")
        part = reached.groupBy("snapshot", "mark").agg(F.min("name").alias("component"), F.count(F.lit(1)).alias("n"))
        part = cut(reached.join(part.where("n > 1"), ["snapshot", "mark"]).select("snapshot", "name", "component"))
        done = part if done is None else done.unionByName(part)
        gone = reached.select("snapshot", F.col("name").alias("src"))
        edges = edges.join(gone, ["snapshot", "src"], "left_anti").join(gone.withColumnRenamed("src", "dst"), ["snapshot", "dst"], "left_anti")
        edges = cut(edges.select("snapshot", "src", "dst"))
    return done if done is not None else edges.select("snapshot", F.col("src").alias("name"), F.col("dst").alias("component"))


def _trimmed(edges: DataFrame) -> DataFrame:
    n = edges.count()
    while n:
        left, entered = edges.select("snapshot", F.col("src").alias("dst")).distinct(), edges.select("snapshot", F.col("dst").alias("src")).distinct()
        edges = cut(edges.join(left, ["snapshot", "dst"], "left_semi").join(entered, ["snapshot", "src"], "left_semi").select("snapshot", "src", "dst"))
        before, n = n, edges.count()
        if n == before:
            break
    return edges


def _spread(marks: DataFrame, steps: DataFrame) -> DataFrame:
    """The largest mark that reaches each vertex over ``steps`` (snapshot, from, name)."""
    marks = cut(marks)
    while True:
        carried = steps.join(marks.select("snapshot", F.col("name").alias("from"), "mark"), ["snapshot", "from"]).select("snapshot", "name", "mark")
        both = marks.select("snapshot", "name", "mark", F.col("mark").alias("old")).unionByName(carried.withColumn("old", F.lit(None).cast("string")))
        new = cut(both.groupBy("snapshot", "name").agg(F.max("mark").alias("mark"), F.max("old").alias("old")))
        moved = new.where("NOT mark <=> old").limit(1).count()
        marks = new.drop("old")
        if not moved:
            return marks


def cycles(components: DataFrame) -> DataFrame:
    """snapshot, component, members (sorted), size of each cycle, largest first."""
    rows = components.groupBy("snapshot", "component").agg(F.array_sort(F.collect_list("name")).alias("members"))
    return rows.withColumn("size", F.size("members")).orderBy("snapshot", F.desc("size"), "members")


def dot(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a Graphviz document between its first and last one: part (0 node, 1 edge), line."""
    node = vertices.select(F.lit(0).alias("part"), F.format_string('    "%s";', "name").alias("line"))
    edge = edges.select(F.lit(1).alias("part"), F.format_string('    "%s" -> "%s";', "src", "dst").alias("line"))
    return node.unionByName(edge)
