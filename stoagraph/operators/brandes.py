"""Betweenness of many graphs: blocks and cut vertices by one walk, Brandes' dependencies inside the blocks only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: What the first step hands on: finished scores of a graph, or some sources of a large block still to be followed.
HANDED = "graph string, whole boolean, ids array<string>, scores array<double>, weights array<bigint>, starts array<bigint>, ends array<bigint>, first bigint, last bigint, scale double"
_HANDED = pa.schema([("graph", pa.string()), ("whole", pa.bool_()), ("ids", pa.list_(pa.string())), ("scores", pa.list_(pa.float64())), *((c, pa.list_(pa.int64())) for c in ("weights", "starts", "ends")), ("first", pa.int64()), ("last", pa.int64()), ("scale", pa.float64())])
SCORED = "graph string, ids array<string>, scores array<double>"
_SCORED = pa.schema([("graph", pa.string()), ("ids", pa.list_(pa.string())), ("scores", pa.list_(pa.float64()))])

#: Entries of the arrays that are worked on at once, names in a batch that is handed on, fewest sources of a part.
_AT_ONCE, _NAMES, _SOURCES = 250_000, 50_000, 512


def _graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(graph, ids, near)`` of each run of rows of one graph, without loops; a vertex is its place in ``ids``."""
    graph, place, near = None, {}, []
    for batch in batches:
        for g, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if g != graph:
                if place:
                    yield graph, list(place), near
                graph, place, near = g, {}, []
            if a != b:
                i = place.setdefault(a, len(place))
                j = place.setdefault(b, len(place))
                while len(near) < len(place):
                    near.append(set())
                near[i].add(j)
                near[j].add(i)
    if place:
        yield graph, list(place), near


def taken_apart(near: list[set[int]]) -> tuple[list[int], list[tuple]]:
    """The ordered pairs that each vertex parts, and the blocks in which further paths lead through vertices.

    A block is ``(vertices, weights, edges)``; a vertex weighs as much as all vertices that lie behind it, seen from the
    block, and itself. Pairs whose ends lie in different branches of a vertex pass it in any case and are counted here.
    """
    n = len(near)
    num, low, hang, apart, score, count, blocks = [-1] * n, [0] * n, [1] * n, [0] * n, [0] * n, 0, []
    for root in range(n):
        if num[root] >= 0:
            continue
        num[root] = low[root] = count
        count += 1
        members, stack, own, walk = [root], [], [], [(root, -1, iter(near[root]))]
        while walk:
            v, above, rest = walk[-1]
            for w in rest:
                if num[w] < 0:
                    num[w] = low[w] = count
                    count += 1
                    members.append(w)
                    stack.append(w)
                    walk.append((w, v, iter(near[w])))
                    break
                if w != above and num[w] < low[v]:
                    low[v] = num[w]
            else:
                walk.pop()
                if above < 0:
                    continue
                if low[v] < low[above]:
                    low[above] = low[v]
                if low[v] >= num[above]:
                    k = len(stack) - 1
                    while stack[k] != v:
                        k -= 1
                    below = sum(hang[x] for x in stack[k:])
                    hang[above] += below
                    apart[above] += below * below
                    if len(stack) - k > 2:
                        own.append((above, below, stack[k:]))
                    del stack[k:]
        total = len(members)
        for x in members:
            behind = 0 if x == root else total - hang[x]
            score[x] = (total - 1) ** 2 - apart[x] - behind**2
        for top, below, others in own:
            edges = [(x, y) for x in others for y in near[x] if num[y] < num[x]]
            if 2 * len(edges) < len(others) * (len(others) + 1):  # nothing lies between in a complete block
                blocks.append(([top, *others], [total - below, *(hang[x] for x in others)], edges))
    return score, blocks


def neighbours(edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of all vertices in one array, and where those of each begin."""
    one, two = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
    return np.concatenate(([0], np.cumsum(np.bincount(one, minlength=n)))), two[np.argsort(one, kind="stable")]


def _followed(starts, ends, weights, first, size, sources, kind) -> np.ndarray | None:
    """What passes each vertex on the ways from these sources; None if the numbers of ways leave the range of floats.

    ``first`` and ``size`` tell the block of each vertex: its first vertex and how many it has. All sources advance
    together; ``shift`` moves a source's vertices to its own stretch of the arrays.
    """
    long = size[sources]
    shift = np.cumsum(long) - long - first[sources]
    vertex = np.arange(long.sum()) - np.repeat(shift, long)
    ways, mark, share = np.zeros(len(vertex), kind), np.full(len(vertex), -1), np.zeros(len(vertex))
    own = at = sources
    key = own_key = shift + at
    ways[key], mark[key], steps = 1, 0, []
    while len(key):
        k = starts[at + 1] - starts[at]
        row = np.repeat(np.arange(len(at)), k)
        to = ends[np.arange(len(row)) + np.repeat(starts[at] - np.cumsum(k) + k, k)]
        met = shift[row] + to
        new = np.flatnonzero(mark[met] < 0)
        row, to, met = row[new], to[new], met[new]
        gone = key[row]
        with np.errstate(over="ignore"):
            np.add.at(ways, met, ways[gone])
        mark[met] = np.arange(len(met))
        once = np.flatnonzero(mark[met] == np.arange(len(met)))
        steps.append((gone, met))
        at, key, shift = to[once], met[once], shift[row[once]]
    if kind is float and not np.isfinite(ways).all():
        return None
    weight = weights[vertex]
    for gone, met in reversed(steps):
        np.add.at(share, gone, (ways[gone] / ways[met]).astype(float) * (weight[met] + share[met]))
    share[own_key] = 0
    return np.bincount(vertex, share * np.repeat(weights[own], long), len(weights))


def followed(starts, ends, weights, first, size, sources) -> np.ndarray:
    """Sum over the sources, as many at once as fit the arrays; numbers of ways beyond the floats are whole numbers of any length."""
    out = np.zeros(len(weights))
    cost = size[sources] + starts[first[sources] + size[sources]] - starts[first[sources]]
    lot = np.cumsum(cost) // _AT_ONCE
    for some in np.split(sources, np.flatnonzero(np.diff(lot)) + 1):
        if len(some):
            done = _followed(starts, ends, weights, first, size, some, float)
            out += _followed(starts, ends, weights, first, size, some, object) if done is None else done
    return out


def _finished(held: list[tuple], blocks: list[tuple]) -> pa.RecordBatch:
    """Scores of the held graphs, with what passes inside their small blocks."""
    begin = np.cumsum([0, *(len(ids) for _, _, ids, _ in held)])
    score = np.concatenate([np.array(s, float) for *_, s in held])
    if blocks:
        long = np.array([len(vertices) for _, vertices, _, _ in blocks])
        from_ = np.cumsum(long) - long
        edges = np.concatenate([np.array(e) + f for (*_, e), f in zip(blocks, from_, strict=True)])
        starts, ends = neighbours(edges, int(long.sum()))
        weights = np.concatenate([np.array(w, float) for _, _, w, _ in blocks])
        at = np.concatenate([np.array(v) + begin[g] for g, v, _, _ in blocks])
        np.add.at(score, at, followed(starts, ends, weights, np.repeat(from_, long), np.repeat(long, long), np.arange(long.sum())))
    rows = []
    for (graph, whole, ids, _), i in zip(held, begin, strict=False):
        rows.append({"graph": graph, "whole": whole, "ids": ids, "scores": score[i : i + len(ids)] * _scale(len(ids))})
    return pa.RecordBatch.from_pylist(rows, _HANDED)


def _scale(n: int) -> float:
    return 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0


def scored(work: int) -> Callable:
    """From rows ``(graph, a, b)`` that are sorted by graph to ``HANDED``: blocks of more than ``work`` steps come as parts of their sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blocks, names, load = [], [], 0, 0
        for graph, ids, near in _graphs(batches):
            score, own = taken_apart(near)
            whole = True
            for vertices, weights, edges in own:
                n, place = len(vertices), {v: i for i, v in enumerate(vertices)}
                edges = [(place[a], place[b]) for a, b in edges]
                if n * len(edges) <= work:
                    blocks.append((len(held), vertices, weights, edges))
                    load += n * (n + 2 * len(edges))
                    continue
                whole = False
                starts, ends = neighbours(np.array(edges), n)
                step = max(min(_SOURCES, work), work // len(edges))
                part = {"graph": graph, "whole": False, "ids": [ids[v] for v in vertices], "weights": weights, "starts": starts, "ends": ends, "scale": _scale(len(ids))}
                for i in range(0, n, step):
                    yield pa.RecordBatch.from_pylist([part | {"first": i, "last": min(n, i + step)}], _HANDED)
            held.append((graph, whole, ids, score))
            names += len(ids)
            if names > _NAMES or load > _AT_ONCE:
                yield _finished(held, blocks)
                held, blocks, names, load = [], [], 0, 0
        if held:
            yield _finished(held, blocks)

    return run


def parts_followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From parts of large blocks to ``SCORED``: what passes each vertex of the block from the part's sources."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            starts, ends, weights = (row[c].values.to_numpy() for c in ("starts", "ends", "weights"))
            n = len(weights)
            sources = np.arange(row["first"].as_py(), row["last"].as_py())
            score = followed(starts, ends, weights.astype(float), np.zeros(n, int), np.full(n, n), sources)
            yield pa.RecordBatch.from_pylist([{"graph": row["graph"].as_py(), "ids": row["ids"].as_py(), "scores": score * row["scale"].as_py()}], _SCORED)
