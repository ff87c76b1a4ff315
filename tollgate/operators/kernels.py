"""Graph kernels on plain arrays, free of Spark.

Ties are pinned: the frontier is ordered by (cost, node), and a node keeps the
first predecessor of least cost, edges being relaxed in the order of their ids.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np

INF = float("inf")


@dataclass
class Csr:
    """Edges sorted by source node, then id; ``first[v]`` is where node v's edges begin."""

    first: np.ndarray
    edge: np.ndarray
    target: np.ndarray
    source_of: np.ndarray
    target_of: np.ndarray
    freeflow: np.ndarray
    capacity: np.ndarray
    length: np.ndarray

    @classmethod
    def build(cls, n_nodes: int, src, dst, freeflow, capacity, length) -> "Csr":
        """From arrays indexed by edge id."""
        src, dst = np.asarray(src, dtype=np.int64), np.asarray(dst, dtype=np.int64)
        order = np.lexsort((np.arange(len(src)), src))
        first = np.searchsorted(src[order], np.arange(n_nodes + 1))
        return cls(first, order, dst[order], src, dst, np.asarray(freeflow, float), np.asarray(capacity, float), np.asarray(length, float))

    @cached_property
    def lists(self) -> tuple[list[int], list[int], list[int]]:
        """first, edge and target as lists, which a search reads faster one by one."""
        return self.first.tolist(), self.edge.tolist(), self.target.tolist()

    @cached_property
    def padded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Rows of one width for each node: incoming edges (-1: none) by their source and id, those
        sources, and the targets of outgoing ones (``nodes``: none); None where a few crowded
        nodes would make nearly all of it empty."""
        n, out = self.nodes, []
        if n == 0 or self.edges == 0:
            return None
        for at, other in ((self.target_of, self.source_of), (self.source_of, self.target_of)):
            many = np.bincount(at, minlength=n)
            if n * int(many.max()) > 16 * self.edges + 1024:
                return None
            order = np.lexsort((np.arange(self.edges), other, at))
            table = np.full((n, int(many.max())), -1, dtype=np.int64)
            table[at[order], np.arange(self.edges) - np.repeat(np.cumsum(many) - many, many)] = order
            out += [table, np.where(table >= 0, other[table], n)]
        return out[0], out[1], out[3]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("lists", "padded", "top_speed", "layers")}

    @property
    def nodes(self) -> int:
        return len(self.first) - 1

    @property
    def edges(self) -> int:
        return len(self.edge)


def bpr_cost(g: Csr, load: np.ndarray, alpha: float, beta: float, scale: float, marginal: bool = False) -> np.ndarray:
    """Cost of every edge; the same function as the column expression."""
    c = g.capacity * scale
    r = np.where(c > 0, np.maximum(load, 0.0) / np.where(c > 0, c, 1.0), 0.0)
    p = (r * r) * (r * r) if beta == 4 else r**beta
    return g.freeflow * (1.0 + alpha * ((beta + 1.0) if marginal else 1.0) * p)


def search(g: Csr, source: int, weight, targets=None, bound=None, blocked_nodes=frozenset(), blocked_edges=frozenset()) -> tuple[dict[int, float], dict[int, int]]:
    """Costs and last edges from ``source``, until all ``targets`` are settled.

    ``bound(v)``, a lower bound of the rest, turns it into a goal-directed search.
    An edge of infinite weight isn't there.
    """
    dist, via, done = {source: 0.0}, {}, set()
    want = set(targets) if targets is not None else None
    heap = [(bound(source) if bound else 0.0, source)]
    first, edge, target = g.lists
    if isinstance(weight, np.ndarray):
        weight = weight.tolist()
    while heap:
        _, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        if want is not None:
            want.discard(v)
            if not want:
                break
        base = dist[v]
        for k in range(first[v], first[v + 1]):
            e, w = edge[k], target[k]
            if w in done or w in blocked_nodes or e in blocked_edges:
                continue
            cost = base + weight[e]
            if cost < dist.get(w, INF):
                dist[w], via[w] = cost, e
                heapq.heappush(heap, (cost + bound(w) if bound else cost, w))
    return {v: dist[v] for v in done}, via


#: Numbers that a search from many origins may hold, and the most origins it takes at once.
CELLS, ORIGINS = 16_000_000, 512
#: Numbers that one step of it works on.
STEP_CELLS = 500_000


def many_at_once(g: Csr) -> int:
    return max(1, min(ORIGINS, CELLS // max(1, g.nodes)))


def search_many(g: Csr, origins: np.ndarray, weight: np.ndarray, tree: bool = True) -> tuple[np.ndarray, np.ndarray | None] | None:
    """Costs [node, origin] and, with ``tree``, last edges (-1: none), the same as those of
    ``search`` bit by bit; None where only ``search`` can tell them.

    Nodes are corrected level by level, as far as they are from one of the
    origins in edges, back and forth, for all origins at once, until nothing
    changes. A sum of costs along a path grows with each of its parts, so the
    least sums are those of Dijkstra; of the edges that give a node its cost,
    the one whose source was settled first is last on its path.
    """
    if not len(weight) or not (weight > 0).all() or g.padded is None:
        return None
    into, froms, targets = g.padded
    n, b = g.nodes, len(origins)
    costs = np.where(into >= 0, weight[into], 1.0)
    dist = np.full((n + 1, b), INF)  # the last row stands for no node
    dist[origins, np.arange(b)] = 0.0
    most = max(1, STEP_CELLS // (into.shape[1] * b))
    due = np.zeros(n + 1, dtype=bool)
    seen, front, steps = np.zeros(n + 1, dtype=bool), origins[b // 2 : b // 2 + 1], []
    seen[n] = True
    while len(front):
        seen[front] = True
        steps += [front[k : k + most] for k in range(0, len(front), most)]
        front = np.unique(targets[front])
        front = front[~seen[front]]
    rest = np.flatnonzero(~seen)
    steps += [rest[k : k + most] for k in range(0, len(rest), most)]
    due[targets[origins]] = True
    due[n] = False
    while due.any():
        for step in steps:
            v = step[due[step]]
            if len(v):
                due[v] = False
                new, own = (dist[froms[v]] + costs[v][:, :, None]).min(axis=1), dist[v]
                less = (new < own).any(axis=1)
                if less.any():
                    dist[v] = np.minimum(new, own)
                    due[targets[v[less]]] = True
                    due[n] = False
        steps.reverse()
    if not tree:
        return dist[:n], None
    via = np.full((n, b), -1, dtype=np.int32)
    for at in range(0, n, most):
        v = np.arange(at, min(n, at + most))
        before = dist[froms[v]]
        before[before + costs[v][:, :, None] != dist[v][:, None, :]] = INF
        k = before.argmin(axis=1)
        via[v] = np.where(before.min(axis=1) < dist[v], np.take_along_axis(into[v], k, axis=1), -1)
    # A cost too small to change a sum leaves the order of settling open.
    lost = (via < 0) & (dist[:n] < INF)
    lost[origins, np.arange(b)] = False
    return None if lost.any() else (dist[:n], via)


def trees(g: Csr, src: np.ndarray, weight: np.ndarray, tree: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """For blocks of the rows of ``src``, sorted: the rows, each row's column, and ``search_many``
    of the block's origins. Few origins, and those it can't tell, are searched one by one."""
    own, row = np.unique(src, return_inverse=True)
    size = many_at_once(g)
    for at in range(0, len(own), size):
        part = own[at : at + size]
        rows = np.arange(*np.searchsorted(row, [at, at + len(part)]))
        found = search_many(g, part, weight, tree) if len(part) >= 8 else None
        if found is None:
            dist, via = np.full((g.nodes, len(part)), INF), np.full((g.nodes, len(part)), -1, dtype=np.int32)
            listed = weight.tolist()
            for k, s in enumerate(part.tolist()):
                d, last = search(g, s, listed)
                for out, held in ((dist, d), (via, last)):
                    out[np.fromiter(held, np.int64, len(held)), k] = np.fromiter(held.values(), out.dtype, len(held))
            found = dist, via
        yield rows, row[rows] - at, *found


def path_to(g: Csr, via: dict[int, int], source: int, target: int) -> list[int]:
    out = []
    while target != source:
        e = via[target]
        out.append(e)
        target = int(g.source_of[e])
    return out[::-1]


def haversine(lat1, lon1, lat2, lon2):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(np.asarray(lon2) - lon1) / 2) ** 2
    return 2 * 6_371_000.0 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


def goal_bound(g: Csr, lat: np.ndarray, lon: np.ndarray, target: int):
    """Great-circle distance over the greatest chord speed of any edge: never more than the rest costs.

    The speed is worked out once for a graph.
    """
    if "top_speed" not in g.__dict__:
        chord = haversine(lat[g.source_of], lon[g.source_of], lat[g.target_of], lon[g.target_of])
        g.top_speed = float(np.max(np.where(g.freeflow > 0, chord / np.where(g.freeflow > 0, g.freeflow, 1.0), 0.0), initial=0.0))
    top = g.top_speed
    if top <= 0:
        return lambda v: 0.0
    to_lat, to_lon = math.radians(lat[target]), math.radians(lon[target])
    shrink = math.cos(to_lat)

    def bound(v: int) -> float:
        at = math.radians(lat[v])
        a = math.sin((to_lat - at) / 2) ** 2 + math.cos(at) * shrink * math.sin((to_lon - math.radians(lon[v])) / 2) ** 2
        return 2 * 6_371_000.0 * math.atan2(math.sqrt(a), math.sqrt(1 - a)) / top * (1 - 1e-12)

    return bound


class Reach:
    """What each node of a directed graph reaches: strongly connected components, and the
    links between them. Nodes may have any ids; ``ids`` has them ascending."""

    def __init__(self, src: np.ndarray, dst: np.ndarray):
        self.ids, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
        n = len(self.ids)
        a, b = ends[: len(src)], ends[len(src) :]
        order = np.argsort(a, kind="stable")
        self.comp = self._components(n, np.searchsorted(a[order], np.arange(n + 1)).tolist(), b[order].tolist())
        self.parts = int(self.comp.max(initial=-1)) + 1
        by = np.argsort(self.comp, kind="stable")
        self.members = np.split(by, np.searchsorted(self.comp[by], np.arange(1, self.parts))) if self.parts else []
        links = np.unique(np.column_stack([self.comp[a], self.comp[b]]), axis=0)
        links = links[links[:, 0] != links[:, 1]]
        self.first, self.next = np.searchsorted(links[:, 0], np.arange(self.parts + 1)), links[:, 1]

    @staticmethod
    def _components(n: int, first: list[int], target: list[int]) -> np.ndarray:
        """Tarjan's strongly connected components, with a stack of its own."""
        comp, low, seen, stack, parts = np.full(n, -1), [0] * n, [-1] * n, [], 0
        tick = 0
        for root in range(n):
            if seen[root] >= 0:
                continue
            work = [(root, first[root])]
            seen[root] = low[root] = tick
            tick += 1
            stack.append(root)
            while work:
                v, at = work.pop()
                while at < first[v + 1]:
                    w = target[at]
                    at += 1
                    if seen[w] < 0:
                        work += [(v, at), (w, first[w])]
                        seen[w] = low[w] = tick
                        tick += 1
                        stack.append(w)
                        break
                    if comp[w] < 0:
                        low[v] = min(low[v], seen[w])
                else:
                    if low[v] == seen[v]:
                        while True:
                            w = stack.pop()
                            comp[w] = parts
                            if w == v:
                                break
                        parts += 1
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[v])
        return comp

    def nodes_of(self, part: int) -> np.ndarray:
        """Places in ``ids`` of all nodes that a component reaches, its own included, ascending."""
        seen, front = {part}, [part]
        while front:
            c = front.pop()
            for d in self.next[self.first[c] : self.first[c + 1]].tolist():
                if d not in seen:
                    seen.add(d)
                    front.append(d)
        return np.sort(np.concatenate([self.members[c] for c in seen]))


def k_shortest(g: Csr, source: int, target: int, k: int, weight) -> list[tuple[float, list[int]]]:
    """Up to ``k`` loopless paths by cost; equal costs in the order of their discovery."""
    if source == target:
        return [(0.0, [])]
    weight = weight.tolist() if isinstance(weight, np.ndarray) else weight
    dist, via = search(g, source, weight, [target])
    if target not in dist or dist[target] == INF:
        return []
    found = [(dist[target], path_to(g, via, source, target))]
    waiting: list[tuple[float, int, list[int]]] = []
    seen = {tuple(found[0][1])}
    while len(found) < k:
        last = found[-1][1]
        at, root_cost, visited = source, 0.0, set()
        for i, step in enumerate(last):
            root = last[:i]
            cut = {p[i] for _, p in found if len(p) > i and p[:i] == root}
            dist, via = search(g, at, weight, [target], blocked_nodes=visited, blocked_edges=cut)
            if target in dist and dist[target] < INF:
                path = root + path_to(g, via, at, target)
                if tuple(path) not in seen:
                    seen.add(tuple(path))
                    heapq.heappush(waiting, (root_cost + dist[target], len(seen), path))
            visited.add(at)
            root_cost += weight[step]
            at = int(g.target_of[step])
        if not waiting:
            break
        cost, _, path = heapq.heappop(waiting)
        found.append((cost, path))
    return found


def split(costs: list[float]) -> list[float]:
    """Shares by inverse cost; a path without cost among others gets none, all without cost share evenly."""
    w = [1.0 / c if c > 0 else 0.0 for c in costs]
    total = sum(w)
    return [x / total for x in w] if total > 0 else [1.0 / len(costs)] * len(costs) if costs else []


def simulate(g: Csr, cohorts: tuple[np.ndarray, ...], route, tick_s: float, max_ticks: int, alpha: float, beta: float, scale: float) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Discrete-time vehicles. ``cohorts``: release tick, from, to, summed weight and number
    of the vehicles that one tick releases for one pair, in the order of the ticks.
    They take one path and move alike, so a cohort is one body, however many it has.

    In each tick: release what has departed by its start, route it on the load
    the tick began with, move all vehicles at speeds under that load with what
    is left of the tick carried over edge ends, then take the new load from who
    stands where. A run ends when nothing is under way or waiting; an empty
    batch still has one tick. Each tick is given as it ends: its number, the
    vehicles under way and those that have arrived so far, the load, and the
    places of the cohorts that ended in it with the time of each of their trips.
    """
    release, src, dst, weight, vehicles = cohorts
    load, done, begin = np.zeros(g.edges), 0, 0
    steps, stored = np.zeros(0, dtype=np.int64), 0
    who, at, end = (np.zeros(0, dtype=np.int64) for _ in range(3))
    offset, spent = np.zeros(0), np.zeros(0)
    for tick in range(1, max_ticks + 1):
        upto = int(np.searchsorted(release, tick, side="right"))
        if upto > begin:
            paths = route(list(zip(src[begin:upto].tolist(), dst[begin:upto].tolist())), load)
            # A path that several cohorts take is stored once a tick; what none drives on any more goes.
            live = [steps[a:b] for a, b in zip(at.tolist(), end.tolist())] if stored > 1_000_000 and stored > 2 * int((end - at).sum()) else None
            if live is not None:
                size = end - at
                steps, end = np.concatenate([*live, np.zeros(0, dtype=np.int64)]), np.cumsum(size)
                at, stored = end - size, len(steps)
            own, new, starts = {}, [], []
            for path in paths:
                if id(path) not in own:
                    own[id(path)] = stored
                    new.append(np.array(path, dtype=np.int64))
                    stored += len(path)
                starts.append(own[id(path)])
            steps = np.concatenate([steps, *new])
            first, size = np.array(starts, dtype=np.int64), np.array([len(p) for p in paths], dtype=np.int64)
            who, at, end = np.concatenate([who, np.arange(begin, upto)]), np.concatenate([at, first]), np.concatenate([end, first + size])
            offset, spent = (np.concatenate([x, np.zeros(upto - begin)]) for x in (offset, spent))
            begin = upto
        cost = bpr_cost(g, load, alpha, beta, scale)
        with np.errstate(divide="ignore", invalid="ignore"):
            speed = np.where(cost > 0, g.length / cost, INF)
        passed = (g.length <= 0) | (speed <= 0) | (speed == INF)
        left = np.full(len(who), float(tick_s))
        moving = np.flatnonzero((at < end) & (left > 0))
        while len(moving):
            e = steps[at[moving]]
            at[moving[passed[e]]] += 1
            offset[moving[passed[e]]] = 0.0
            moves, e = moving[~passed[e]], e[~passed[e]]
            need = (g.length[e] - offset[moves]) / speed[e]
            over = need <= left[moves]
            car = moves[over]
            spent[car] += need[over]
            left[car] -= need[over]
            at[car] += 1
            offset[car] = 0.0
            car = moves[~over]
            offset[car] += speed[e[~over]] * left[car]
            spent[car] += left[car]
            left[car] = 0.0
            moving = moving[(left[moving] > 0) & (at[moving] < end[moving])]
        there = at >= end
        ended, times = who[there], spent[there]
        who, at, end, offset, spent = (x[~there] for x in (who, at, end, offset, spent))
        load = np.bincount(steps[at], weights=weight[who], minlength=g.edges) if len(who) else np.zeros(g.edges)
        done += int(vehicles[ended].sum())
        yield tick, int(vehicles[who].sum()), done, load, ended, times
        if not len(who) and begin >= len(release):
            break
