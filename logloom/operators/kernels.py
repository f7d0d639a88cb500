"""Graph heuristics that are sequential by nature, one connected component at a time.

Each kernel takes ``nodes, edges`` of one component and returns a label for
each node.  ``per_component`` runs it through ``applyInPandas``; a component
beyond ``LIMIT`` nodes raises an error instead of being cut short.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components

LIMIT = 5000
Graph = dict[int, dict[int, float]]


def graph_of(edges: pd.DataFrame) -> Graph:
    out: Graph = defaultdict(dict)
    for s, d, w in zip(edges.src, edges.dst, edges.weight, strict=True):
        out[int(s)][int(d)] = out[int(d)][int(s)] = float(w)
    return out


def majority(graph: Graph, rounds: int = 100) -> dict[int, int]:
    """Asynchronous majority clustering: nodes in order take the label with the most weight (ties: least label)."""
    label = {n: n for n in graph}
    moved: set[tuple[int, int]] = set()
    for _ in range(rounds):
        still = True
        for n in sorted(graph):
            votes: dict[int, float] = defaultdict(float)
            for m, w in graph[n].items():
                votes[label[m]] += w
            best = min(votes, key=lambda c: (-round(votes[c], 6), c))
            if best != label[n] and (n, best) not in moved:
                moved.add((n, best))
                label[n], still = best, False
        if still:
            break
    return label


def heaviest_neighbour(graph: Graph, rounds: int = 100) -> dict[int, int]:
    """The improved variant: a node takes the label of its heaviest neighbour (ties: least node)."""
    label = {n: n for n in graph}
    moved: set[tuple[int, int]] = set()
    for _ in range(rounds):
        still = True
        for n in sorted(graph):
            best = label[min(graph[n], key=lambda m: (-graph[n][m], m))]
            if best != label[n] and (n, best) not in moved:
                moved.add((n, best))
                label[n], still = best, False
        if still:
            break
    return label


def partition_modularity(graph: Graph, label: dict[int, int]) -> float:
    m2 = sum(w for n in graph for w in graph[n].values())
    if not m2:
        return 0.0
    inner, strength = defaultdict(float), defaultdict(float)
    for n in graph:
        for k, w in graph[n].items():
            strength[label[n]] += w
            if label[n] == label[k]:
                inner[label[n]] += w
    return sum(inner[c] / m2 - (strength[c] / m2) ** 2 for c in strength)


def louvain(graph: Graph) -> dict[int, int]:
    """Modularity maximisation by moving nodes in ascending order, then by merging communities."""
    groups = {n: {n} for n in graph}
    work: Graph = {n: dict(graph[n]) for n in graph}
    loops: dict[int, float] = defaultdict(float)
    m2 = sum(w for n in graph for w in graph[n].values())
    while True:
        label = {n: n for n in work}
        strength = {n: sum(work[n].values()) + loops[n] for n in work}
        total = dict(strength)
        changed, again = False, True
        while again:
            again = False
            for n in sorted(work):
                near: dict[int, float] = defaultdict(float)
                for k, w in work[n].items():
                    near[label[k]] += w
                total[label[n]] -= strength[n]
                gain = {c: near[c] - total.get(c, 0.0) * strength[n] / m2 for c in {*near, label[n]}}
                best = min(gain, key=lambda c: (-round(gain[c], 12), c))
                if gain[best] <= gain[label[n]] + 1e-12:
                    best = label[n]
                total[best] = total.get(best, 0.0) + strength[n]
                if best != label[n]:
                    label[n], again, changed = best, True, True
        if not changed:
            return {x: min(g) for g in groups.values() for x in g}
        merged: dict[int, set[int]] = defaultdict(set)
        for n, c in label.items():
            merged[c] |= groups[n]
        bigger: Graph = {c: defaultdict(float) for c in merged}
        inside: dict[int, float] = defaultdict(float)
        for n in work:
            inside[label[n]] += loops[n]
            for k, w in work[n].items():
                if label[n] == label[k]:
                    inside[label[n]] += w
                else:
                    bigger[label[n]][label[k]] += w
        groups, work, loops = dict(merged), {c: dict(v) for c, v in bigger.items()}, inside


def min_cut(graph: Graph) -> tuple[float, set[int]]:
    """Global minimum cut by maximum adjacency orders."""
    work = {n: dict(graph[n]) for n in graph}
    inside = {n: {n} for n in graph}
    best, side = float("inf"), set()
    while len(work) > 1:
        weight = {n: 0.0 for n in work}
        order: list[int] = []
        while weight:
            n = min(weight, key=lambda x: (-weight[x], x))
            cut = weight.pop(n)
            order.append(n)
            for k, w in work[n].items():
                if k in weight:
                    weight[k] += w
        last, before = order[-1], order[-2]
        if cut < best:
            best, side = cut, set(inside[last])
        inside[before] |= inside.pop(last)
        for k, w in work.pop(last).items():
            work[k].pop(last, None)
            if k != before:
                work[before][k] = work[k][before] = work[before].get(k, 0.0) + w
    return best, side


def recursive_cut(graph: Graph) -> dict[int, int]:
    """Cut again and again; parts of at most three nodes, and cuts that do not raise modularity, stay."""
    label = {n: min(graph) for n in graph}
    queue = [set(graph)]
    while queue:
        part = queue.pop()
        if len(part) <= 3:
            continue
        own = {n: {k: w for k, w in graph[n].items() if k in part} for n in part}
        _, side = min_cut(own)
        new = label | {n: min(side) for n in side} | {n: min(part - side) for n in part - side}
        if partition_modularity(graph, new) > partition_modularity(graph, label) + 1e-12:
            label = new
            queue += [side, part - side]
    return label


def graph_entropy(graph: Graph) -> dict[int, int]:
    """Grow clusters from seeds (ascending) while the summed entropy falls."""

    def entropy(n: int, inside: set[int]) -> float:
        all_ = sum(graph[n].values())
        p = sum(w for k, w in graph[n].items() if k in inside) / all_ if all_ else 0.0
        return float(-p * np.log2(p) - (1 - p) * np.log2(1 - p)) if 0 < p < 1 else 0.0

    left, label = set(graph), {}
    while left:
        seed = min(left)
        inside = {seed} | set(graph[seed])
        total = sum(entropy(n, inside) for n in graph)
        for n in sorted(graph[seed]):
            less = sum(entropy(x, inside - {n}) for x in graph)
            if less < total - 1e-12:
                inside, total = inside - {n}, less
        for n in sorted({k for x in inside for k in graph[x]} - inside):
            less = sum(entropy(x, inside | {n}) for x in graph)
            if less < total - 1e-12:
                inside, total = inside | {n}, less
        own = (inside & left) | {seed}
        for n in own:
            label[n] = seed
        left -= own
    return label


def maximal_cliques(graph: Graph) -> list[list[int]]:
    """All maximal cliques, by pivoting."""
    out: list[list[int]] = []
    stack = [(set(), set(graph), set())]
    while stack:
        clique, wanted, done = stack.pop()
        if not wanted and not done:
            out.append(sorted(clique))
            continue
        if not wanted:
            continue
        pivot = max(wanted | done, key=lambda n: (len(wanted & graph[n].keys()), -n))
        for n in sorted(wanted - graph[pivot].keys()):
            stack.append((clique | {n}, wanted & graph[n].keys(), done & graph[n].keys()))
            wanted = wanted - {n}
            done = done | {n}
    return sorted(out)


def forward_groups(edges: list[tuple[int, int]], nodes: list[int]) -> dict[int, int]:
    """Groups by depth-first search over edges to later nodes only."""
    later: dict[int, list[int]] = defaultdict(list)
    for a, b in edges:
        later[min(a, b)].append(max(a, b))
    label: dict[int, int] = {}
    for n in sorted(nodes):
        if n in label:
            continue
        stack = [n]
        while stack:
            x = stack.pop()
            if x not in label:
                label[x] = n
                stack += [k for k in later[x] if k not in label]
    return label


def per_component(nodes: DataFrame, edges: DataFrame, kernel: Callable[[Graph], dict[int, int]]) -> DataFrame:
    """``node_id, cluster_id`` by a kernel over each component; nodes without edges are alone."""
    labels = components(nodes, edges)
    owned = edges.join(labels.withColumnRenamed("node_id", "src"), "src").select("cluster_id", "src", "dst", "weight")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        graph = graph_of(part)
        if len(graph) > LIMIT:
            raise ValueError(f"a component of {len(graph)} nodes is beyond the limit of {LIMIT}; raise the edge threshold")
        found = kernel(graph)
        return pd.DataFrame({"node_id": list(found), "cluster_id": list(found.values())})

    made = owned.groupBy("cluster_id").applyInPandas(run, "node_id long, cluster_id long")
    return nodes.select("node_id").join(made, "node_id", "left").select("node_id", F.coalesce("cluster_id", "node_id").alias("cluster_id"))


def maximal_clique_clusters(graph: Graph, k: int = 2, threshold: float = 0.0) -> dict[int, int]:
    """Percolation of maximal cliques of at least k nodes whose intensity exceeds the threshold.

    A node of several cliques goes to the one with the larger summed weight
    around it (ties: the later clique); uncovered nodes are alone.
    """
    label: dict[int, int] = {n: n for n in graph}
    strength: dict[int, float] = {}
    for clique in maximal_cliques(graph):
        weights = [graph[a][b] for i, a in enumerate(clique) for b in clique[i + 1 :]]
        if len(clique) < max(2, k) or np.exp(np.mean(np.log(weights))) <= threshold:
            continue
        for n in clique:
            own = sum(graph[n][m] for m in clique if m != n)
            if n not in strength or own >= strength[n]:
                strength[n], label[n] = own, clique[0]
    return label


def recursive_louvain(graph: Graph) -> dict[int, int]:
    """Louvain again inside each community until one remains."""
    done: dict[int, int] = {}
    queue = [graph]
    while queue:
        part = queue.pop()
        label = louvain(part)
        groups: dict[int, set[int]] = defaultdict(set)
        for n, c in label.items():
            groups[c].add(n)
        for own in groups.values():
            if len(groups) == 1 or len(own) == 1:
                done |= {n: min(own) for n in own}
            else:
                inner = {n: {m: w for m, w in part[n].items() if m in own} for n in own}
                queue.append(inner)
    return done


def cut_sides(graph: Graph) -> dict[int, int]:
    """The two sides of the global minimum cut."""
    if len(graph) < 2:
        return {n: n for n in graph}
    _, side = min_cut(graph)
    other = set(graph) - side
    return {n: min(side) for n in side} | {n: min(other) for n in other}


def refined_neighbour(graph: Graph) -> dict[int, int]:
    """Heaviest-neighbour clustering, then once more over the clusters; one cluster for all means none."""
    first = heaviest_neighbour(graph)
    outer: Graph = defaultdict(dict)
    for n in graph:
        for m, w in graph[n].items():
            a, b = first[n], first[m]
            if a != b:
                outer[a][b] = max(outer[a].get(b, 0.0), w)
    second = heaviest_neighbour(outer) if outer else {}
    label = {n: second.get(c, c) for n, c in first.items()}
    return {n: n for n in graph} if len(set(label.values())) == 1 and len(graph) > 2 else label
