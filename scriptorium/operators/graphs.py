"""Dialogue graphs and reading walks.

A graph is one row with arrays of nodes and edges, so that each is worked on where it lies, in Arrow
batches. Reachability over edge tables that belong together runs as joins in rounds.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def adjacency(nodes: list[str], edges: list[tuple[str, str]]) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Children and parents over the known nodes, in edge order, repeated edges once."""
    known, seen = set(nodes), set()
    children, parents = defaultdict(list), defaultdict(list)
    for a, b in edges:
        if a in known and b in known and (a, b) not in seen:
            seen.add((a, b))
            children[a].append(b)
            parents[b].append(a)
    return children, parents


def walk_order(nodes: list[str], edges: list[tuple[str, str]], root: str | None) -> list[str]:
    """Depth-first order from the root, then from the other nodes as they come."""
    children, _ = adjacency(nodes, edges)
    out, seen = [], set()
    for start in ([root] if root in set(nodes) else []) + nodes:
        stack = [start]
        while stack:
            n = stack.pop()
            if n not in seen:
                seen.add(n)
                out.append(n)
                stack.extend(reversed(children[n]))
    return out


def display_order(nodes: list[str], edges: list[tuple[str, str]], root: str | None) -> tuple[list[str], bool]:
    """Topological order that prefers the walk order, and whether a cycle remained (appended in walk order)."""
    walk = walk_order(nodes, edges, root)
    rank = {n: i for i, n in enumerate(walk)}
    children, parents = adjacency(nodes, edges)
    waiting = {n: len(parents[n]) for n in rank}
    ready = [rank[n] for n in rank if not waiting[n]]
    heapq.heapify(ready)
    out = []
    while ready:
        n = walk[heapq.heappop(ready)]
        out.append(n)
        for c in children[n]:
            waiting[c] -= 1
            if not waiting[c]:
                heapq.heappush(ready, rank[c])
    cyclic = len(out) < len(walk)
    done = set(out)
    return out + [n for n in walk if n not in done], cyclic


def reach(nodes: list[str], edges: list[tuple[str, str]], root: str | None) -> set[str]:
    children, _ = adjacency(nodes, edges)
    seen = {root} if root in set(nodes) else set()
    queue = deque(seen)
    while queue:
        for c in children[queue.popleft()]:
            if c not in seen:
                seen.add(c)
                queue.append(c)
    return seen


def components(nodes: list[str], edges: list[tuple[str, str]]) -> dict[str, str]:
    """Weak components, named by their first node."""
    parent = {n: n for n in nodes}

    def find(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order = {n: i for i, n in reversed(list(enumerate(nodes)))}
    for a, b in edges:
        if a in parent and b in parent:
            x, y = find(a), find(b)
            if x != y:
                x, y = (x, y) if order[x] < order[y] else (y, x)
                parent[y] = x
    return {n: find(n) for n in parent}


def guards(nodes: list[str], edges: list[tuple[str, str]], root: str | None, own: dict[str, set[str]]) -> dict[str, set[str]]:
    """Conditions that hold on every way to a node: its own and those common to all its parents, in display order."""
    order, _ = display_order(nodes, edges, root)
    _, parents = adjacency(nodes, edges)
    out: dict[str, set[str]] = {}
    for n in order:
        known = [out[p] for p in parents[n] if p in out]
        out[n] = own.get(n, set()) | (set.intersection(*known) if known else set())
    return out


def diagnostics(nodes: list[str], edges: list[tuple[str, str]], root: str | None) -> list[str]:
    """What is wrong or unusual in a graph, as sorted words."""
    known = set(nodes)
    found = set()
    if not nodes:
        found.add("no nodes")
    if root is None:
        found.add("root missing")
    elif root == "":
        found.add("root empty")
    elif root not in known:
        found.add("root not found")
    if len(known) < len(nodes):
        found.add("repeated node")
    for a, b in edges:
        if a not in known:
            found.add("missing parent")
        if b not in known:
            found.add("dangling edge")
    _, parents = adjacency(nodes, edges)
    if any(len(p) > 1 for p in parents.values()):
        found.add("several parents")
    if nodes and display_order(nodes, edges, root)[1]:
        found.add("cycle")
    if nodes and root in known and len(reach(nodes, edges, root)) < len(known):
        found.add("orphan")
    return sorted(found)


def bounded_walk(start: list[str], edges: list[tuple[str, str, str]], hops: int = 3, most_nodes: int = 32, most_edges: int = 64) -> tuple[list[str], bool]:
    """Nodes within ``hops`` of the start over (edge_id, a, b), edges in id order, and whether a bound cut the walk."""
    by = defaultdict(list)
    for e, a, b in sorted(edges):
        by[a].append((e, b))
        by[b].append((e, a))
    seen, used, layer, cut = list(dict.fromkeys(start)), set(), list(dict.fromkeys(start)), False
    for _ in range(hops):
        nxt = []
        for n in layer:
            for e, m in by[n]:
                if e in used:
                    continue
                if len(used) >= most_edges:
                    return seen, True
                used.add(e)
                if m not in seen:
                    if len(seen) >= most_nodes:
                        cut = True
                        continue
                    seen.append(m)
                    nxt.append(m)
        layer = nxt
    return seen, cut


def dialogue_groups(records: DataFrame) -> DataFrame:
    """(record_id, section_no, unit_no, group_no, root_id, nodes, edges) of the latest build of canonical records, by positions."""
    newest = records.groupBy("record_id").agg(F.max("built_at").alias("built_at"))
    r = records.join(newest, ["record_id", "built_at"]).select("record_id", F.posexplode("sections").alias("section_no", "s")).select("record_id", "section_no", F.posexplode("s.units").alias("unit_no", "u"))
    g = r.select("record_id", "section_no", "unit_no", F.posexplode("u.value.groups").alias("group_no", "g")).where("g is not null")
    clean = lambda a: F.filter(F.coalesce(F.col(a), F.array()), lambda x: x.isNotNull())
    return g.select("record_id", "section_no", "unit_no", "group_no", F.col("g.root_id").alias("root_id"), clean("g.nodes").alias("nodes"), clean("g.edges").alias("edges")).dropDuplicates(["record_id", "section_no", "unit_no", "group_no"])


def per_graph(groups: DataFrame, what: Callable[[list[str], list[tuple[str, str]], str | None], list[tuple]], columns: str) -> DataFrame:
    """Rows (record_id, section_no, unit_no, group_no, *columns) that ``what`` gives for each graph."""
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string("record_id string, section_no int, unit_no int, group_no int, " + columns)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                nodes = list(dict.fromkeys(n["source_id"] for n in r["nodes"] if n["source_id"] is not None))
                edges = [(e["parent_id"], e["child_id"]) for e in r["edges"]]
                rows += [(r["record_id"], r["section_no"], r["unit_no"], r["group_no"], *x) for x in what(nodes, edges, r["root_id"])]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    return groups.mapInArrow(run, schema)


def reachable(edges: DataFrame, starts: DataFrame, hops: int | None = None, most_rounds: int = 10_000) -> DataFrame:
    """(node, hops) reachable from starts (node) over edges (a, b), as joins in rounds; each node with its least hops.

    Rounds end when nothing new is found, or after ``hops`` steps if a depth is asked for. ``most_rounds``
    only guards against endless work: a walk that isn't over by then raises.
    """
    from ..session import cut

    seen = cut(starts.select("node").distinct().withColumn("hops", F.lit(0)))
    front = seen
    i = 0
    while hops is None or i < hops:
        i += 1
        if i > most_rounds:
            raise ValueError(f"the walk isn't over after {most_rounds} rounds")
        nxt = front.join(edges, front["node"] == edges["a"]).select(F.col("b").alias("node")).where("node is not null").distinct().join(seen, "node", "left_anti").withColumn("hops", F.lit(i))
        front = cut(nxt)
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def chain_places(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, hops) of all nodes that the heads of chains reach, by doubling pointers; ``links``: node, back (null at a head).

    A node has one link at most, back to another node of the table. Each round doubles the reach of every
    pointer, so that a chain of n nodes takes log2(n) rounds whatever the number of chains. Nodes whose links
    lead to no head (a cycle) are not reached; a chain longer than 2 ** ``most_rounds`` raises, and so do two
    links of one node.
    """
    from ..session import cut

    if not links.groupBy("node").count().where("count > 1").isEmpty():
        raise ValueError("a node has several links")
    state = cut(links.select("node", "back", F.when(F.col("back").isNull(), 0).otherwise(1).alias("hops")))
    left = None
    for _ in range(most_rounds):
        # each round ends some pointer unless only cycles are left
        open_now = state.where("back is not null").count()
        if not open_now or open_now == left:
            break
        left = open_now
        to = state.select(F.col("node").alias("back"), F.col("back").alias("further"), F.col("hops").alias("more"))
        state = cut(state.join(to, "back", "left").select("node", F.col("further").alias("back"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")))
    else:
        raise ValueError(f"chains are longer than 2 ** {most_rounds}")
    return state.where("back is null").select("node", "hops")


def arrivals(ranks: DataFrame, order: DataFrame, k: int = 20) -> DataFrame:
    """Links (low, high) made when documents arrive one by one and each takes its best ``k`` among those already there.

    ``ranks``: source, target, rank; ``order``: key, place. The restriction to earlier arrivals comes
    before the cut at ``k``. Links are undirected and counted once.
    """
    from pyspark.sql.window import Window

    o = lambda c: order.select(F.col("key").alias(c), F.col("place").alias(f"{c}_place"))
    seen = ranks.join(o("source"), "source").join(o("target"), "target").where("target_place < source_place")
    best = seen.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("rank", "target"))).where(F.col("n") <= k)
    return best.select(F.least("source", "target").alias("low"), F.greatest("source", "target").alias("high")).distinct()
