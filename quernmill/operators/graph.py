"""Graphs of keys that share items: edges, communities, components, betweenness, modularity, splitting."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernmill.operators.similarity import common_counts
from quernmill.session import cut


def shared_item_edges(pairs: DataFrame, key: str, item: str, min_common: int) -> DataFrame:
    """src < dst for every two keys with at least min_common items in common; keys without an edge are no vertices."""
    return common_counts(pairs, key, item, min_common).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of src < dst edges, without loops and repeats."""
    e = edges.select("src", "dst").where(F.col("src") != F.col("dst"))
    return e.union(e.select("dst", "src")).distinct()


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """id, label after `rounds` synchronous rounds; each vertex takes its neighbours' most frequent label, the smallest of several.

    Labels are counted before they are ranked, so a vertex with very many neighbours sends one
    row a label. Each round is written out, so the plan doesn't grow.
    """
    both = cut(undirected(edges))
    labels = cut(both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")))
    for _ in range(rounds):
        votes = both.join(labels, F.col("src") == F.col("id")).groupBy("dst", "label").agg(F.count("*").alias("n"))
        # the least (-count, label) of each vertex, partially aggregated
        best = votes.groupBy("dst").agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("best"))
        labels = cut(best.select(F.col("dst").alias("id"), F.col("best.label").alias("label")))
    return labels


def communities(labels: DataFrame) -> DataFrame:
    """label, members (sorted), size; to be listed by size and first member."""
    return labels.groupBy("label").agg(F.sort_array(F.collect_list("id")).alias("members")).withColumn("size", F.size("members"))


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """id, component: the smallest id that can be reached, by alternating large-star and small-star steps.

    Every step rewrites each vertex's edges to the least neighbour, so long chains shrink by
    half and no vertex keeps a large neighbourhood; only counts come to the driver. Raises if the last round still changes something.
    """
    links = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where(F.col("u") != F.col("v")).distinct())
    vertices = cut(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())
    previous = None
    for _ in range(most_rounds):
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v"))
        links = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if state == previous:
            break
        previous = state
    else:
        raise ValueError(f"components still change after {most_rounds} rounds")
    roots = links.groupBy("u").agg(F.min("v").alias("component"))
    return vertices.join(roots, F.col("id") == F.col("u"), "left").select("id", F.coalesce("component", "id").alias("component"))


def _credit(root, adjacency) -> dict[tuple, float]:
    """Edge credits of one breadth-first search (adjacency: vertex -> neighbours): shortest paths counted down, flow shared by them on the way up."""
    depth, paths, order, parents = {root: 0}, {root: 1.0}, [], {root: []}
    queue = deque([root])
    while queue:
        v = queue.popleft()
        order.append(v)
        for w in adjacency[v]:
            if w not in depth:
                depth[w], paths[w], parents[w] = depth[v] + 1, 0.0, []
                queue.append(w)
            if depth[w] == depth[v] + 1:
                paths[w] += paths[v]
                parents[w].append(v)
    flow, credit = dict.fromkeys(order, 1.0), {}
    for w in reversed(order):
        for v in parents[w]:
            part = flow[w] * paths[v] / paths[w]
            credit[(v, w) if v < w else (w, v)] = part
            flow[v] += part
    return credit


def edge_betweenness(edges: DataFrame, largest_component: int = 200_000, visits: int = 2_000_000) -> DataFrame:
    """src < dst, betweenness: shortest paths through each edge, each pair of vertices counted once.

    Searches from all vertices run in parallel, each in its component, whose adjacency is kept
    by each task that has a root of it; components beyond `largest_component` edges are refused.
    The roots of a component are cut into slices of about `visits` edge visits, and slices of all
    components are spread over as many partitions as there is work for.
    """
    both = undirected(edges)
    parts = cut(both.join(connected_components(edges), F.col("src") == F.col("id")).select("component", "src", "dst"))
    near = parts.groupBy("component", "src").agg(F.collect_list("dst").alias("near"))
    graph = cut(near.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.size("near")).alias("links"), F.sort_array(F.collect_list(F.struct("src", "near"))).alias("graph")))
    slices = F.least(F.ceil(F.col("n") * F.col("links") / visits), F.col("n")).cast("int")
    worst, wanted = graph.agg(F.max("links"), F.sum(slices)).head()
    if (worst or 0) > 2 * largest_component:
        raise ValueError(f"a component of {worst // 2} edges; edge_betweenness takes {largest_component}")
    work = graph.select("component", "graph", slices.alias("slices"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    schema = "src string, dst string, part double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names = [v["src"] for v in row["graph"]]
                place = {name: i for i, name in enumerate(names)}
                adjacency = [[place[w] for w in v["near"]] for v in row["graph"]]
                total: dict[tuple[int, int], float] = {}
                for root in range(row["slice"], len(names), row["slices"]):
                    for edge, part in _credit(root, adjacency).items():
                        total[edge] = total.get(edge, 0.0) + part
                yield pa.RecordBatch.from_arrays([pa.array([names[e[0]] for e in total], pa.string()), pa.array([names[e[1]] for e in total], pa.string()), pa.array(total.values(), pa.float64())], ["src", "dst", "part"])

    spread = work.repartition(max(1, min(wanted or 0, 4096)), "component", "slice").select("graph", "slice", "slices")
    return spread.mapInArrow(run, schema).groupBy("src", "dst").agg(F.round(F.sum("part") / 2, 6).alias("betweenness"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, q: the share of edges within communities less its expectation from degrees; a vertex without label is a community of its own."""
    e = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where(F.col("src") != F.col("dst")).distinct()
    of = labels.select(F.col("id"), F.col("label"))
    labelled = e.join(of.select(F.col("id").alias("src"), F.col("label").alias("ls")), "src", "left").join(of.select(F.col("id").alias("dst"), F.col("label").alias("ld")), "dst", "left")
    labelled = labelled.select(F.coalesce("ls", "src").alias("ls"), F.coalesce("ld", "dst").alias("ld"))
    ends = labelled.select("ls", "ld", F.explode(F.array("ls", "ld")).alias("label"))
    per = ends.groupBy("label").agg(F.count("*").cast("double").alias("degree"), (F.count_if(F.col("ls") == F.col("ld")) / 2).alias("within"))
    m2 = F.sum("degree")
    return per.agg(F.round(F.sum("within") / (m2 / 2) - F.sum(F.col("degree") * F.col("degree")) / (m2 * m2), 6).alias("q"))


def girvan_newman(edges: DataFrame, largest_component: int = 2_000) -> DataFrame:
    """id, community: the split with the best modularity on the way of removing the edge with the highest betweenness again and again.

    Removing an edge changes betweenness in its component only, so components are worked on
    independently: each gives its best own split, against the degrees and edge count of the
    whole graph. Ties take the smallest edge; the unsplit component is a candidate.
    """
    e = cut(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where(F.col("src") != F.col("dst")).distinct())
    m = e.count()
    parts = e.join(connected_components(e), F.col("src") == F.col("id")).groupBy("component").agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("links"))
    worst = parts.agg(F.max(F.size("links"))).head()[0] or 0
    if worst > largest_component:
        raise ValueError(f"a component of {worst} edges; girvan_newman takes {largest_component}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                got = _split([(x["src"], x["dst"]) for x in row["links"]], m)
                yield pa.RecordBatch.from_arrays([pa.array(got.keys(), pa.string()), pa.array(got.values(), pa.string())], ["id", "community"])

    return parts.select("links").mapInArrow(run, "id string, community string")


def _split(links: list[tuple[str, str]], m: int) -> dict[str, str]:
    adjacency: dict[str, set[str]] = {}
    for a, b in links:
        adjacency.setdefault(a, set()).add(b)
        adjacency.setdefault(b, set()).add(a)
    degree = {v: len(n) for v, n in adjacency.items()}

    def groups() -> dict[str, str]:
        label: dict[str, str] = {}
        for v in sorted(adjacency):
            if v not in label:
                label[v], todo = v, [v]
                while todo:
                    for w in adjacency[todo.pop()]:
                        if w not in label:
                            label[w] = v
                            todo.append(w)
        return label

    def quality(label: dict[str, str]) -> float:
        ends: dict[str, int] = {}
        for v, g in label.items():
            ends[g] = ends.get(g, 0) + degree[v]
        return sum(label[a] == label[b] for a, b in links) / m - sum(d * d for d in ends.values()) / (4 * m * m)

    label = groups()
    best, kept = quality(label), label
    while any(adjacency.values()):
        total: dict[tuple[str, str], float] = {}
        fixed = {v: sorted(n) for v, n in adjacency.items()}
        for root in sorted(fixed):
            for edge, part in _credit(root, fixed).items():
                total[edge] = total.get(edge, 0.0) + part
        (a, b), _ = min(total.items(), key=lambda x: (-round(x[1], 9), x[0]))
        adjacency[a].discard(b)
        adjacency[b].discard(a)
        now = groups()
        if len(set(now.values())) != len(set(label.values())):
            label = now
            q = quality(label)
            if q > best + 1e-12:
                best, kept = q, label
    return kept
