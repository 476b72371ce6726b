"""Graphs of (src, dst) edges, undirected: each edge once with src < dst.

Iterations are joins of DataFrames, checkpointed every round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.session import checkpoint, ship, stored

from .relational import sharing


#: Edges, pairs of users and roots of a graph are dealt over so many tasks at least, however small they are.
PARTS = 16
#: About so many of an item's users are compared with as many at once, so many users go to a task, and so many items are in a matrix.
BLOCK, DEALT, WIDE = 512, 8192, 4096
#: Graphs of up to so many vertices are searched as matrices.
DENSE = 4000


def corating(df: DataFrame, user: str, item: str, least: int) -> DataFrame:
    """(src, dst): users who share at least so many items; users without such a partner do not occur.

    Only users with that many items count. Of two that share `least` items,
    sorted rarest first, the first that they share is one of all but the last
    `least` - 1 of either, so pairs meet there alone, once, and their whole
    sets are compared; by counting shared items, where sets are much larger than that.
    Users of an item are dealt into blocks, and each two of these are compared as matrices.
    """
    ship(df.sparkSession)
    own = df.select(F.col(user).alias("g"), F.col(item).alias("i")).where("g is not null and i is not null").distinct()
    own = checkpoint(own.withColumn("size", F.count("*").over(Window.partitionBy("g"))).where(F.col("size") >= least))
    often = own.groupBy("i").agg(F.count("*").alias("f"))
    sets = own.join(often, "i").groupBy("g", "size").agg(F.array_sort(F.collect_list(F.struct("f", "i"))).alias("s")).select("g", "size", F.col("s.i").alias("items"))
    sets = checkpoint(sets.select("*", F.posexplode(F.slice("items", F.lit(1), (F.col("size") - (max(least, 1) - 1)).cast("int"))).alias("before", "i")))
    users = sets.groupBy("i").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK)
    size = sets.agg(F.avg("size")).first()[0] or 0.0
    met, dealt = users.agg(F.sum(F.col("n").cast("double") * F.col("n")), F.sum(F.col("n") * blocks)).first()
    counted = own.groupBy("i").agg(F.count("*").cast("double").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0.0
    if (met or 0.0) * size / 4 > counted:
        return sharing(own, "g", "i", least).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    kind, tasks = own.schema["g"].dataType.simpleString(), max(PARTS, -(-(dealt or 0) // DEALT))
    cells = sets.join(users.select("i", blocks.alias("blocks")), "i").withColumn("block", F.pmod(F.xxhash64("g"), "blocks"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = cells.select("i", "g", "items", "before", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    cells = cells.withColumn("task", F.pmod(F.xxhash64("i", "lo", "hi"), F.lit(tasks)))

    def compared(some: pd.DataFrame) -> pd.DataFrame:
        found = [pairs(cell, least) for _, cell in some.groupby(["i", "lo", "hi"], sort=False)]
        return pd.DataFrame({"src": np.concatenate([x for x, _ in found]), "dst": np.concatenate([x for _, x in found])})

    return cells.repartition(tasks, "task").groupBy("task").applyInPandas(compared, f"src {kind}, dst {kind}")


def pairs(cell: pd.DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs between two blocks of an item's users (or within one) who share `least` items, none of them before that item."""
    ids, items = cell["g"].to_numpy(), cell["items"].to_numpy()
    length = np.array([len(x) for x in items])
    row = np.repeat(np.arange(len(ids)), length)
    place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    code, _ = pd.factorize(np.concatenate(items))
    first = (cell["block"] == cell["lo"]).to_numpy()
    left, right = np.flatnonzero(first), np.flatnonzero((cell["block"] == cell["hi"]).to_numpy())

    def common(some: np.ndarray) -> np.ndarray:
        """How many of these entries two users share."""
        out = np.zeros((len(left), len(right)), np.float32)
        r, (c, values) = row[some], pd.factorize(code[some])
        for at in range(0, len(values), WIDE):
            here = (c >= at) & (c < at + WIDE)
            x = np.zeros((len(ids), min(WIDE, len(values) - at)), np.float32)
            x[r[here], c[here] - at] = 1.0
            out += x[left] @ x[right].T
        return out

    i, j = np.nonzero((common(np.ones(len(row), bool)) >= least) & (common(place < np.repeat(cell["before"].to_numpy(), length)) == 0))
    a, b = ids[left[i]], ids[right[j]]
    within = cell["lo"].iloc[0] == cell["hi"].iloc[0]
    swap = a > b
    keep = (a < b) if within else np.ones(len(a), bool)
    return np.where(swap, b, a)[keep], np.where(swap, a, b)[keep]


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def neighbours(edges: DataFrame) -> DataFrame:
    """(src, near): a vertex's neighbours in up to PARTS lists; the edges are made once (they may be dear), and rounds move lists, not edges."""
    ways = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    both = edges.select(ways.alias("e")).select("e.*").repartition(PARTS, "src")
    return both.groupBy("src", F.pmod(F.xxhash64("dst"), F.lit(PARTS)).alias("part")).agg(F.collect_list("dst").alias("near")).select("src", "near")


def vertices(edges: DataFrame) -> DataFrame:
    return both_ways(edges).select(F.col("src").alias("id")).distinct()


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): the least id that a vertex is connected with. Labels travel along edges and jump to the label of their label."""
    both = checkpoint(neighbours(edges))
    now = checkpoint((nodes if nodes is not None else both.select(F.col("src").alias("id")).distinct()).select("id", F.col("id").alias("component")))
    while True:
        seen = both.join(now.withColumnRenamed("id", "src"), "src").select(F.explode("near").alias("id"), "component").groupBy("id").agg(F.min("component").alias("other"))
        new = now.join(seen, "id", "left").select("id", F.least("component", "other").alias("c"), F.col("component").alias("was"))
        jump = new.select(F.col("id").alias("c"), F.col("c").alias("root"))
        new = checkpoint(new.join(jump, "c", "left").select("id", F.least("c", "root").alias("component"), "was"))
        if new.where("component <> was").isEmpty():
            return new.select("id", "component")
        now = new.select("id", "component")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label): every round each vertex takes its neighbours' most frequent label, the least of ties."""
    both = checkpoint(neighbours(edges))
    now = checkpoint(both.select(F.col("src").alias("id")).distinct().select("id", F.col("id").alias("label")))
    for _ in range(rounds):
        counts = both.join(now.withColumnRenamed("id", "src"), "src").select(F.explode("near").alias("id"), "label").groupBy("id", "label").agg(F.count("*").alias("n"))
        best = counts.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b"))
        now = checkpoint(best.select("id", F.col("b.label").alias("label")))
    return now


def communities(labels: DataFrame, label: str) -> DataFrame:
    """(members), smaller communities first, then by their members."""
    return labels.groupBy(label).agg(F.array_sort(F.collect_list("id")).alias("members")).select("members").orderBy(F.size("members"), "members")


def shortest_paths(edges: DataFrame, compat: bool = False) -> DataFrame:
    """(root, node, dist, sigma): breadth-first from every vertex; sigma counts shortest paths.

    compat counts a node's parents instead of its shortest paths.
    """
    both = checkpoint(both_ways(edges))
    level = vertices(edges).select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("dist"), F.lit(1.0).alias("sigma"))
    seen = level = checkpoint(level)
    while True:
        reached = level.join(both.withColumnRenamed("src", "node"), "node").select("root", F.col("dst").alias("node"), (F.col("dist") + 1).alias("dist"), "sigma")
        reached = reached.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        level = checkpoint(reached.groupBy("root", "node").agg(F.first("dist").alias("dist"), (F.count("*").cast("double") if compat else F.sum("sigma")).alias("sigma")))
        if level.isEmpty():
            return seen
        seen = checkpoint(seen.unionByName(level))


def sparse_flows(near: list[np.ndarray], roots: np.ndarray, compat: bool, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, flow) of the arcs on shortest paths from these roots, root by root along the arcs.

    Vertices may stand for so many twins each (`classes`), which are joined with
    each other where a vertex is its own neighbour; all of them are roots then,
    and the flow is that of a single arc. The root's twins are a vertex of their own.
    """
    n, indices = len(near), np.concatenate(near)
    begin = np.concatenate([[0], np.cumsum([len(x) for x in near])])
    flow, size = np.zeros(len(indices)), np.ones(n) if size is None else size
    for r in roots:
        own = np.arange(begin[r], begin[r + 1])
        front, steps, w = indices[own], [], size.copy()
        w[r] -= 1
        seen, sigma = np.zeros(n, bool), np.zeros(n)
        seen[front], sigma[front] = True, 1.0
        seen[r] |= w[r] == 0
        while len(front):
            count = begin[front + 1] - begin[front]
            at = np.repeat(begin[front] - np.cumsum(count) + count, count) + np.arange(count.sum())
            parent = np.repeat(front, count)
            new = ~seen[indices[at]]
            at, parent = at[new], parent[new]
            front, child = np.unique(indices[at], return_inverse=True)
            paths = np.bincount(child, sigma[parent] * w[parent], len(front))
            steps.append((at, parent, indices[at], sigma[parent] / paths[child]))
            seen[front], sigma[front] = True, np.bincount(child, w[parent], len(front)) if compat else paths
        credit = np.ones(n)
        for at, parent, child, share in reversed(steps):
            f = credit[child] * share
            flow[at] += f * np.where((parent == r) | (child == r), w[r], size[r])
            np.add.at(credit, parent, f * w[child])
        flow[own] += credit[indices[own]] * np.where(indices[own] == r, 2.0, 1.0)
    return np.repeat(np.arange(n), np.diff(begin)), indices, flow


def dense_flows(near: list[np.ndarray], roots: np.ndarray, compat: bool, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same by products with the adjacency matrix, many roots at once."""
    n = len(near)
    A, flow, size = np.zeros((n, n)), np.zeros((n, n)), np.ones(n) if size is None else size
    for i, x in enumerate(near):
        A[i, x] = 1.0
    joined = A.copy()
    np.fill_diagonal(A, 0.0)
    for some in np.array_split(roots, -(-len(roots) // 256)):
        row = np.arange(len(some))
        w = np.tile(size, (len(some), 1))
        w[row, some] -= 1
        # the root itself stands apart, so levels begin with its neighbours
        levels, sums = [joined[some]], [joined[some]]
        seen = levels[0] > 0
        while levels[-1].any():
            # paths that go on to vertices not seen before
            paths = np.where(seen, 0.0, (levels[-1] * w) @ A)
            seen |= paths > 0
            sums.append(paths)
            levels.append(np.where(paths > 0, ((levels[-1] > 0) * w) @ A, 0.0) if compat else paths)
        credit, left = np.ones((len(some), n)), w[row, some] / size[some]
        for above, paths in zip(levels[-2::-1], sums[:0:-1]):
            share = np.divide(credit, paths, out=np.zeros_like(paths), where=paths > 0)
            credit += above * ((share * w) @ A)
            above = above * size[some][:, None]
            above[row, some] *= left
            share[row, some] *= left
            flow += above.T @ share
        share = np.divide(credit, sums[0], out=np.zeros_like(credit), where=sums[0] > 0)
        share[row, some] *= 2.0
        flow[some] += share
    i, j = np.nonzero(joined)
    return i, j, flow[i, j]


def twins(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, class), and (src, dst, n, o, e): classes of vertices with the same neighbours (apart from each other), and their arcs.

    A class is named by its least vertex. Of two joined classes all vertices are
    joined, and in a class with an arc to itself too; n and o are the
    numbers of vertices of src and dst, e that of edges. So the classes are the whole graph, of
    which shortest paths, cuts of equal edges and components are found on them.
    Sets of neighbours are told apart by 128 bits of hashes, and the numbers of
    edges prove the classes. The edges (stored ones) are read, not shuffled.
    """
    ways = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    prints = lambda c: (F.xxhash64(c), F.xxhash64(c, F.lit(1)))
    x, y = prints("dst")
    open_ = edges.select(ways.alias("e")).select("e.*").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"), F.bit_xor(x).alias("x"), F.bit_xor(y).alias("y"))
    p, q = prints("id")
    same, joined = Window.partitionBy("d", "x", "y"), Window.partitionBy("d", F.col("x").bitwiseXOR(p), F.col("y").bitwiseXOR(q))
    rows = open_.select("id", F.min("id").over(same).alias("a"), F.count("*").over(same).alias("n"), F.min("id").over(joined).alias("b"))
    # no vertex has twins of both kinds
    member = stored(rows.select("id", F.when(F.col("n") > 1, F.col("a")).otherwise(F.col("b")).alias("class")))
    arcs = joined_classes(edges, member)
    if not arcs.where(F.col("e") != F.when(F.col("src") == F.col("dst"), F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("o"))).isEmpty():
        member = stored(member.select("id", F.col("id").alias("class")))
        arcs = joined_classes(edges, member)
    return member, arcs


def joined_classes(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(src, dst, n, o, e): arcs of classes, the sizes of both ends and the number of edges."""
    counted = of_classes(edges, member).groupBy(F.col("lo").alias("src"), F.col("hi").alias("dst")).agg(F.count("*").alias("e"))
    size = member.groupBy(F.col("class").alias("src")).agg(F.count("*").alias("n"))
    return stored(counted.join(size, "src").join(size.withColumnsRenamed({"src": "dst", "n": "o"}), "dst").select("src", "dst", "n", "o", "e"))


def of_classes(edges: DataFrame, member: DataFrame) -> DataFrame:
    """Edges with the classes that they join, as lo and hi."""
    side = lambda c, name: member.select(F.col("id").alias(c), F.col("class").alias(name))
    rows = edges.select("src", "dst").join(side("src", "a"), "src").join(side("dst", "b"), "dst")
    return rows.select("src", "dst", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))


def class_flows(arcs: DataFrame, compat: bool) -> DataFrame:
    """(src, dst, betweenness) of a single edge of each arc of classes (src, dst, n, o).

    Each of PARTS tasks has all classes as lists of neighbours and searches
    from its share of them.
    """
    ship(arcs.sparkSession)
    both = arcs.select("src", "dst", "n").unionByName(arcs.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("o").alias("n")))
    near = stored(both.groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("near"), F.max("n").alias("n")))
    kind = near.schema["id"].dataType.simpleString()

    def flows(graph: pd.DataFrame) -> pd.DataFrame:
        graph = graph.sort_values("id")
        ids = graph["id"].to_numpy()
        roots = np.arange(graph["part"].iloc[0], len(ids), PARTS)
        if not len(roots):
            return pd.DataFrame({"src": ids[:0], "dst": ids[:0], "flow": np.zeros(0)})
        search = dense_flows if len(ids) <= DENSE else sparse_flows
        i, j, flow = search([np.searchsorted(ids, np.asarray(x)) for x in graph["near"]], roots, compat, graph["n"].to_numpy(float))
        some = flow > 0
        i, j = i[some], j[some]
        return pd.DataFrame({"src": ids[np.minimum(i, j)], "dst": ids[np.maximum(i, j)], "flow": flow[some]})

    # both directions of an edge are searched from all roots, so each path counts twice
    parts = near.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).repartition(PARTS, "part")
    found = parts.groupBy("part").applyInPandas(flows, f"src {kind}, dst {kind}, flow double")
    return found.groupBy("src", "dst").agg((F.sum("flow") / 2).alias("betweenness"))


def betweenness(edges: DataFrame, compat: bool = False) -> DataFrame:
    """(src, dst, betweenness): shortest paths over each edge, shared among equal ones; credit flows back level by level.

    The search is over classes of vertices with the same neighbours, as all
    edges between two classes have the same value. compat counts a node's
    parents instead of its shortest paths.
    """
    edges = stored(edges.select("src", "dst"))
    member, arcs = twins(edges)
    found = stored(class_flows(arcs, compat).withColumnsRenamed({"src": "lo", "dst": "hi"}))
    return of_classes(edges, member).join(found, ["lo", "hi"]).select("src", "dst", "betweenness")


def modularity(edges: DataFrame, labels: DataFrame, label: str = "component", current: DataFrame | None = None) -> DataFrame:
    """(modularity) of a partition of the graph's vertices: within-community edges against those expected from degrees.

    Edges and degrees are the original graph's. With `current`, the cut graph,
    adjacency and degrees are its own, self-pairs do not count, and only m
    stays the original's.
    """
    edges = checkpoint(edges.select("src", "dst"))  # read four times
    return modularity_of(edges, edges.count(), labels, label, current)


def modularity_of(edges: DataFrame, m: int, labels: DataFrame, label: str, current: DataFrame | None) -> DataFrame:
    """The same of stored edges, of which there are m."""
    graph = edges if current is None else current
    degree = both_ways(graph).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"))
    rows = labels.select("id", F.col(label).alias("c")).join(degree, "id", "left").select("id", "c", F.coalesce("k", F.lit(0)).cast("double").alias("k"))
    sums = rows.groupBy("c").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q"))
    side = labels.select("id", F.col(label).alias("c"))
    inside = graph.join(side.select(F.col("id").alias("src"), "c"), "src").join(side.select(F.col("id").alias("dst"), F.col("c").alias("d")), "dst").where("c = d").groupBy("c").agg(F.count("*").alias("e"))
    expected = F.col("s") * F.col("s") - (F.col("q") if current is not None else F.lit(0.0))
    one = (2 * F.coalesce("e", F.lit(0)) - expected / (2 * m)) / (2 * m) if m else F.lit(0.0)
    return sums.join(inside, "c", "left").agg(F.sum(one).alias("modularity"))


def class_modularity(arcs: DataFrame, m: int, found: DataFrame, current: DataFrame | None) -> DataFrame:
    """The same of classes of twins; found has (id, n, component, alone): their sizes, and whether their vertices are components of their own."""
    graph = (arcs if current is None else current).select("src", "dst")
    side = lambda name, *columns: found.select(F.col("id").alias(name), *columns)
    both = graph.unionByName(graph.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = both.join(side("dst", "n"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("n") - F.when(F.col("src") == F.col("dst"), 1).otherwise(0)).alias("k"))
    rows = found.join(degree, "id", "left").withColumn("k", F.coalesce("k", F.lit(0)).cast("double"))
    sums = rows.groupBy("component").agg(F.sum(F.col("n") * F.col("k")).alias("s"), F.sum(F.col("n") * F.col("k") * F.col("k")).alias("q"), F.max("alone").alias("alone"))
    ends = graph.join(side("src", "n", "component", "alone"), "src").join(side("dst", F.col("n").alias("o"), F.col("component").alias("other")), "dst").where("component = other and not alone")
    inside = ends.groupBy("component").agg(F.sum(F.when(F.col("src") == F.col("dst"), F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("n") * F.col("o"))).alias("e"))
    expected = F.when(F.col("alone"), F.col("q")).otherwise(F.col("s") * F.col("s")) - (F.col("q") if current is not None else F.lit(0.0))
    one = (2 * F.coalesce("e", F.lit(0)) - expected / (2 * m)) / (2 * m) if m else F.lit(0.0)
    return sums.join(inside, "component", "left").agg(F.sum(one).alias("modularity"))


def girvan_newman(edges: DataFrame, patience: int = 10, compat: bool = False) -> tuple[DataFrame, float]:
    """(id, component) of the best modularity, and that. Each round cuts all edges tied at the highest betweenness.

    Ends without edges, or after so many rounds in a row that are no better than
    the round before. The driver keeps the best modularity; the cut set of a round is a join.
    Rounds are over classes of vertices with the same neighbours: their edges tie, so they stay such classes.
    """
    original = stored(edges.select("src", "dst"))  # they may be dear, so vertices come from the stored ones
    member, arcs = twins(original)
    m = arcs.agg(F.sum("e")).first()[0] or 0
    size = stored(member.groupBy(F.col("class").alias("id")).agg(F.count("*").alias("n")))
    now, best, kept, waited, last = arcs, None, None, 0, -1.0
    while True:
        # twins without any edge left are not connected with each other
        tied = vertices(now).withColumn("tied", F.lit(True))
        found = checkpoint(components(now, size).join(size, "id").join(tied, "id", "left").select("id", "n", "component", F.col("tied").isNull().alias("alone")))
        score = class_modularity(arcs, m, found, now if compat else None).first()[0] or 0.0
        waited = 0 if score > last + 1e-12 else waited + 1
        if best is None or score > best + 1e-12:
            best, kept = score, found
        last = score
        if waited >= patience or now.isEmpty():
            own = F.when(F.col("alone"), F.col("id")).otherwise(F.col("component"))
            return member.join(kept.select(F.col("id").alias("class"), "component", "alone"), "class").select("id", own.alias("component")), best
        scored = checkpoint(class_flows(now, compat))
        most = scored.agg(F.max(F.round("betweenness", 9))).first()[0]
        now = checkpoint(now.join(scored.where(F.round("betweenness", 9) == most).select("src", "dst"), ["src", "dst"], "left_anti"))
