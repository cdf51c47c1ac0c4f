"""Closures and propagation over edge tables, as frontier joins to a fix point.

Each round joins only the frontier, so work follows the edges reached.  Rounds
are cut with ``checkpoint`` into the shared folder, which survives lost executors
and keeps plans short; cycles end because visited nodes never re-enter.  What was
visited is the union of the rounds' frontiers: a round writes its own only, and every
``_MERGE`` rounds they become one.  Rounds join by sort and merge: a broadcast each round
would send the edges or the frontier through the driver again and again.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, its lineage gone."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        place = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not place and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


_MERGE = 16


def _with(visited: DataFrame, frontier: DataFrame, step: int) -> DataFrame:
    both = visited.union(frontier)
    return both if step % _MERGE else cut(both)


def _merged(df: DataFrame) -> DataFrame:
    """Joins with ``df`` never go through the driver."""
    return df.hint("merge")


def reverse(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.select(F.col(dst).alias(src), F.col(src).alias(dst))


def closure(edges: DataFrame, roots: DataFrame, most: int = 1000) -> DataFrame:
    """(node, depth) of everything reachable from ``roots`` (node) along (src, dst), roots
    at depth 0, each at its least depth."""
    visited = cut(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = visited
    e = _merged(cut(edges.select("src", "dst")))
    for depth in range(1, most):
        step = frontier.join(e, frontier["node"] == e["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(_merged(visited), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return visited
        visited = _with(visited, frontier, depth)
    raise RuntimeError("closure did not settle")


def selection(edges: DataFrame, roots: DataFrame, upstream: bool = False, downstream: bool = False) -> DataFrame:
    """Selected nodes.  Each direction starts from the roots alone, so asking for both does
    not walk down from what was found upward.  Edges lead from upstream to downstream."""
    found = roots.select("node")
    if downstream:
        found = found.union(closure(edges, roots).select("node"))
    if upstream:
        found = found.union(closure(reverse(edges), roots).select("node"))
    return found.distinct()


def pairs_closure(edges: DataFrame, reflexive: bool = True, most: int = 64) -> DataFrame:
    """(node, ancestor) of a membership or parent table (child, parent), cycle-safe; with
    ``reflexive`` every node counts as its own ancestor.  Paths double each round."""
    e = edges.select("child", "parent").where("child is not null and parent is not null").distinct()
    reach = cut(e)
    n = reach.count()
    for _ in range(most):
        longer = reach.alias("a").join(_merged(reach.alias("b")), F.col("a.parent") == F.col("b.child")).select("a.child", "b.parent")
        reach = cut(reach.union(longer).distinct())
        now = reach.count()
        if now == n:
            break
        n = now
    out = reach.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"))
    if reflexive:
        every = e.select("child").union(e.select("parent")).distinct()
        out = out.union(every.select(F.col("child").alias("node"), F.col("child").alias("ancestor"))).distinct()
    return out


def stage_levels(nodes: DataFrame, edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(node, stage): 0 without upstreams, else one more than the highest upstream's.  Nodes
    are settled stage by stage, each once all its upstreams are; cycles raise."""
    e = cut(edges.select("src", "dst").distinct())
    every = nodes.select("node").distinct()
    inside = e.join(_merged(every), e["src"] == every["node"], "left_semi")
    # upstreams each node still waits for; a round touches only what its nodes lead to
    waits = every.join(_merged(inside.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("open"))), "node", "left")
    waits = cut(waits.select("node", F.coalesce("open", F.lit(0)).alias("open")))
    ready = cut(waits.where("open = 0").select("node", F.lit(0).alias("stage")))
    done, met, left = ready, None, waits.count()
    for stage in range(1, most):
        left -= ready.count()
        if not left:
            return done
        if ready.isEmpty():
            raise ValueError("the graph has a cycle")
        hit = e.join(_merged(ready), e["src"] == ready["node"]).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
        met = hit if met is None else met.union(hit).groupBy("node").agg(F.sum("n").alias("n"))
        met = cut(met.join(_merged(waits), "node"))
        ready = cut(met.where("n = open").select("node", F.lit(stage).alias("stage")))
        met = met.where("n < open").select("node", "n")
        done = _with(done, ready, stage)
    raise RuntimeError("stages did not settle")


def propagate_failures(tasks: DataFrame, edges: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks with new states, edges with resolutions).  ``tasks`` are (node, state),
    ``failed`` (node, resolution).  What depends on a failed or skipped node is skipped,
    on a cancelled one cancelled; terminal tasks keep their state and stop the spread,
    but the edges into them are marked.  The first edge to reach a node decides, and of
    edges in one round the one from the smallest upstream."""
    terminal = ("SUCCEEDED", "FAILED", "SKIPPED", "CANCELLED")
    open_ = _merged(cut(tasks.where(~F.col("state").isin(*terminal)).select("node")))
    e = _merged(cut(edges.select("src", "dst")))
    frontier = cut(failed.select("node", "resolution"))
    marked, changed = None, None
    visited, step = frontier.select("node"), 0
    while not frontier.isEmpty():
        step += 1
        hit = cut(frontier.join(e, frontier["node"] == e["src"]).select("src", "dst", "resolution"))
        marked = hit if marked is None else marked.union(hit)
        state = F.when(F.col("w.resolution") == "CANCELLED", "CANCELLED").otherwise("SKIPPED")
        first = hit.groupBy(F.col("dst").alias("node")).agg(F.min_by(F.struct("resolution"), "src").alias("w"))
        new = first.join(open_, "node", "left_semi").join(_merged(visited), "node", "left_anti").select("node", state.alias("resolution"))
        frontier = cut(new)
        visited = _with(visited, frontier.select("node"), step)
        changed = frontier if changed is None else changed.union(frontier)
    if changed is None:
        return tasks, edges.withColumn("resolution", F.lit(None).cast("string"))
    out = tasks.join(_merged(changed), "node", "left").select("node", F.coalesce("resolution", "state").alias("state"))
    return out, edges.join(_merged(marked), ["src", "dst"], "left")


def walk_log(logs: DataFrame, head: str, depth: int = 100) -> DataFrame:
    """(path, step): a chain of metadata files from ``head`` over (path, previous), newest
    first; stops at the limit, at a missing file and at a file seen before."""
    return closure(logs.select(F.col("path").alias("src"), F.col("previous").alias("dst")).where("dst is not null"),
                   logs.sparkSession.createDataFrame([(head,)], "node string"), most=depth + 1).select(F.col("node").alias("path"), F.col("depth").alias("step"))


def task_definitions(planned: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depends_on): dependencies inside the planned set only, sorted."""
    inside = edges.join(planned, edges["src"] == planned["node"], "left_semi")
    needs = inside.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("depends_on"))
    return planned.select("node").distinct().join(needs, "node", "left").withColumn(
        "depends_on", F.coalesce("depends_on", F.array().cast("array<string>"))
    )


def readiness(edges: DataFrame) -> DataFrame:
    """(node, deps_total, deps_satisfied, ready) from dependency edges with ``satisfied``."""
    return edges.groupBy(F.col("dst").alias("node")).agg(
        F.count("*").alias("deps_total"), F.count_if("satisfied").alias("deps_satisfied")
    ).withColumn("ready", F.col("deps_total") == F.col("deps_satisfied"))


def topological_order(graph: dict[str, Sequence[str]]) -> list[str]:
    """Nodes of a plan (bounded, on the driver) with upstreams first, ties by key; a cycle is
    named in the error.  ``graph`` maps a node to its upstreams."""
    import heapq

    waits = {n: len(set(u)) for n, u in graph.items()}
    after: dict[str, list[str]] = {n: [] for n in graph}
    for n, ups in graph.items():
        for u in set(ups):
            after[u].append(n)
    heap = [n for n, w in waits.items() if not w]
    heapq.heapify(heap)
    out = []
    while heap:
        n = heapq.heappop(heap)
        out.append(n)
        for d in after[n]:
            waits[d] -= 1
            if not waits[d]:
                heapq.heappush(heap, d)
    if len(out) < len(graph):
        at = min(set(graph) - set(out))
        path = [at]
        while True:
            at = min(u for u in graph[at] if waits[u])
            if at in path:
                raise ValueError("cycle: " + " -> ".join([*path[path.index(at) :], at]))
            path.append(at)
    return out
