"""All-or-nothing loads of very many pairs on a long graph, free of Spark.

Nodes are put into layers, so that edges stay in a layer or join neighbouring
ones; a path crosses every layer between its ends. Matrices of least costs from
layer to layer, as wide as the widest layer, answer all pairs at once, and the
flows of the pairs go back through the same matrices to the edges: work grows
with the layers and the pairs, not with origins times nodes. Costs are those of
``kernels.search`` but for the last digits, as sums are taken in another order;
of paths that cost the same any may be taken.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import kernels as K

INF = float("inf")
#: Numbers that the matrices of all layers may have, and pairs that are answered at once.
CELLS, ROWS = 4_000_000, 20_000
#: The widest layer, and the most pieces that don't hang together.
WIDTH, PIECES = 160, 1000
#: Origins times nodes from which matrices are weighed against searches.
LARGE = 50_000_000


@dataclass
class Side:
    """Edges seen upwards. Of each place: edges to the next layer, from the layer before, and
    back to the layer before (-1: none) with the place at their other end; ``flat``: layer,
    from, to and id of the edges within a layer."""

    to_next: tuple[np.ndarray, np.ndarray]
    from_last: tuple[np.ndarray, np.ndarray]
    to_last: tuple[np.ndarray, np.ndarray]
    flat: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Layers:
    layer: np.ndarray
    place: np.ndarray
    size: np.ndarray
    up: Side
    down: Side

    @property
    def count(self) -> int:
        return len(self.size)

    @property
    def width(self) -> int:
        return int(self.size.max(initial=0))


def layered(g: K.Csr) -> Layers | None:
    """The layers of a graph; None where they are too wide for matrices."""
    n, a, b = g.nodes, g.source_of, g.target_of
    ends = np.concatenate([a, b])
    order = np.argsort(ends, kind="stable")
    near, first = np.concatenate([b, a])[order], np.searchsorted(ends[order], np.arange(n + 1))

    def around(front):
        many = first[front + 1] - first[front]
        return near[np.repeat(first[front] - np.cumsum(many) + many, many) + np.arange(many.sum())]

    def spread(start, seen, mark):
        """The layers around a node; ``seen`` has ``mark`` where one of them is."""
        fronts = [np.array([start])]
        seen[start] = mark
        while len(fronts[-1]):
            front = np.unique(around(fronts[-1]))
            fronts.append(front[seen[front] != mark])
            seen[fronts[-1]] = mark
        return fronts[:-1]

    layer, seen, at, pieces = np.full(n, -1), np.zeros(n, dtype=np.int64), 0, 0
    for start in range(n):
        if layer[start] < 0:
            pieces += 1
            if pieces > PIECES:
                return None
            # From an end of the piece its layers are many and small.
            for k in range(3):
                fronts = spread(start, seen, 3 * pieces + k)
                start = int(fronts[-1][0])
            for front in fronts:
                layer[front] = at
                at += 1
    size = np.bincount(layer, minlength=at)
    if not n or int(size.max()) > WIDTH or at * int(size.max()) ** 2 > CELLS:
        return None
    by = np.argsort(layer, kind="stable")
    place = np.empty(n, dtype=np.int64)
    place[by] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)

    def table(ids, here, other):
        """[layer, place, k]: the k-th edge of ``ids`` at each node and its other end's place."""
        row = layer[here[ids]] * int(size.max()) + place[here[ids]]
        order = np.argsort(row, kind="stable")
        ids, row = ids[order], row[order]
        many = np.bincount(row, minlength=at * int(size.max()))
        edge = np.full((at * int(size.max()), max(1, int(many.max(initial=0)))), -1, dtype=np.int64)
        edge[row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)] = ids
        edge = edge.reshape(at, int(size.max()), -1)
        return np.where(edge >= 0, place[other[edge]], 0), edge

    rise = layer[b] - layer[a]
    ups, downs, flat = (np.flatnonzero(rise == r) for r in (1, -1, 0))
    out_up, in_up, out_down, in_down = table(ups, a, b), table(ups, b, a), table(downs, a, b), table(downs, b, a)
    turned = lambda x: tuple(t[::-1] for t in x)
    level = layer[a[flat]]
    return Layers(layer, place, size, Side(out_up, in_up, out_down, (level, place[a[flat]], place[b[flat]], flat)), Side(turned(out_down), turned(in_down), turned(out_up), (at - 1 - level, place[a[flat]], place[b[flat]], flat)))


def layers_of(g: K.Csr) -> Layers | None:
    """The same, worked out once for a graph."""
    if "layers" not in g.__dict__:
        g.layers = layered(g)
    return g.layers


def pays(g: K.Csr, origins: int) -> bool:
    """Whether matrices take less than searches from so many origins."""
    if origins * g.nodes < LARGE or layers_of(g) is None:
        return False
    n, w = layers_of(g).count, layers_of(g).width
    return 4 * n * n.bit_length() * w**3 < 100 * origins * g.nodes


def settles(cost: np.ndarray) -> bool:
    """Whether sums tell paths apart: no cost gets lost in them, and none is that of a tenth of
    all edges, which leaves many paths alike, to be told apart by the rule of searches."""
    least = cost.min(initial=INF)
    return 0 < least and cost.max(initial=0.0) < 1e12 * least and 10 * int(np.unique(cost, return_counts=True)[1].max(initial=0)) <= len(cost)


def crossing(layers: int, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each pair of layers the one that halves the least stretch with both in it: it lies between them, or is one of them."""
    least, most = np.minimum(one, other), np.maximum(one, other)
    a, b = np.zeros(len(one), dtype=np.int64), np.full(len(one), layers, dtype=np.int64)
    while True:
        m = (a + b) // 2
        below, above = most < m, least > m
        if not (below | above).any():
            return m
        b, a = np.where(below, m, b), np.where(above, m + 1, a)


def closure(b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Least costs by steps of ``b`` between its first ``n`` places, in place, and the last place that shortened each (-1: none)."""
    via = np.full(b.shape, -1, dtype=np.int16)
    own, last = b[:n, :n], via[:n, :n]
    for k in range(n):
        over = own[:, k, None] + own[k]
        last[over < own] = k
        np.minimum(own, over, out=own)
    return b, via


def steps_of(x: np.ndarray, via: np.ndarray) -> np.ndarray:
    """The flow of each single step, given that of the least paths of ``closure``, in place.

    Both parts of a path cost less than it, so this ends.
    """
    while True:
        a, b = np.nonzero((via >= 0) & (x > 0))
        if not len(a):
            return x
        k, f = via[a, b], x[a, b]
        x[a, b] = 0.0
        np.add.at(x, (a, k), f)
        np.add.at(x, (k, b), f)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b).min(axis=1)


class Half:
    """Least costs of a graph seen from one side: ``within``, inside each layer by way of it and the layers before it."""

    def __init__(self, layers: Layers, side: Side, cost: np.ndarray, size: np.ndarray):
        w = layers.width
        self.side, self.size = side, size
        self.next, self.last, self.back = (np.where(e >= 0, cost[e], INF) for _, e in (side.to_next, side.from_last, side.to_last))
        self.flat, self.flat_edge = np.full((layers.count, w, w), INF), np.full((layers.count, w, w), -1, dtype=np.int32)
        # Of edges between the same two places the cheapest is written last, and stays.
        at, a, b, e = (x[np.argsort(-cost[side.flat[3]], kind="stable")] for x in side.flat)
        self.flat[at, a, b], self.flat_edge[at, a, b] = cost[e], e
        self.within, self.via = np.full((layers.count, w, w), INF), np.full((layers.count, w, w), -1, dtype=np.int16)
        own = np.arange(w)
        for i in range(layers.count):
            b = self.flat[i].copy()
            if i:
                b = np.minimum(b, (self.down(i).min(axis=1)[:, side.from_last[0][i]] + self.last[i]).min(axis=2))
            b[own, own] = 0.0
            self.within[i], self.via[i] = closure(b, int(size[i]))

    def down(self, i: int) -> np.ndarray:
        """[place, edge back, place in the layer before]: cost of that edge and of what follows there."""
        return self.back[i][:, :, None] + self.within[i - 1][self.side.to_last[0][i]]

    def arrivals(self) -> np.ndarray:
        """[layer, from, to]: costs to where the next layer is entered first."""
        out = np.full((len(self.within) - 1, *self.within.shape[1:]), INF)
        for k in range(self.last.shape[2]):
            np.minimum(out, np.take_along_axis(self.within[:-1], self.side.from_last[0][1:, :, k][:, None, :], axis=2) + self.last[1:, :, k][:, None, :], out=out)
        return out

    def departures(self, beyond: np.ndarray) -> np.ndarray:
        """[layer, from, to]: costs to the next layer by leaving this one for the last time; ``beyond``: within the next layer and those after it."""
        out = np.full((len(self.within) - 1, *self.within.shape[1:]), INF)
        for k in range(self.next.shape[2]):
            np.minimum(out, np.take_along_axis(beyond[1:], self.side.to_next[0][:-1, :, k][:, :, None], axis=1) + self.next[:-1, :, k][:, :, None], out=out)
        return out

    def unpack_arrivals(self, x: np.ndarray, own: np.ndarray, flow: np.ndarray) -> None:
        i, s, z = np.nonzero(x)
        if len(i):
            at = self.side.from_last[0][i + 1, z]
            k = (self.within[i[:, None], s[:, None], at] + self.last[i + 1, z]).argmin(axis=1)
            f, row = x[i, s, z], np.arange(len(i))
            np.add.at(flow, self.side.from_last[1][i + 1, z, k], f)
            np.add.at(own, (i, s, at[row, k]), f)

    def unpack_departures(self, x: np.ndarray, beyond: np.ndarray, own: np.ndarray, flow: np.ndarray) -> None:
        j, y, t = np.nonzero(x)
        if len(j):
            to = self.side.to_next[0][j, y]
            k = (self.next[j, y] + beyond[j[:, None] + 1, to, t[:, None]]).argmin(axis=1)
            f, row = x[j, y, t], np.arange(len(j))
            np.add.at(flow, self.side.to_next[1][j, y, k], f)
            np.add.at(own, (j + 1, to[row, k], t), f)

    def unpack_within(self, x: np.ndarray, flow: np.ndarray) -> None:
        w = x.shape[1]
        own = np.arange(w)
        for i in range(len(x) - 1, -1, -1):
            x[i, own, own] = 0.0
            if not x[i].any():
                continue
            one = steps_of(x[i], self.via[i])
            one[own, own] = 0.0
            s, y = np.nonzero(one)
            f, row = one[s, y], np.arange(len(s))
            over = np.full(len(s), INF)
            if i:
                down = self.down(i)
                least = down.min(axis=1)
                at = self.side.from_last[0][i, y]
                found = least[s[:, None], at] + self.last[i, y]
                k = found.argmin(axis=1)
                over = found[row, k]
            here = self.flat[i, s, y] <= over
            np.add.at(flow, self.flat_edge[i, s[here], y[here]], f[here])
            if not here.all():
                s, y, f, k, p = s[~here], y[~here], f[~here], k[~here], at[row, k][~here]
                d = down[s, :, p].argmin(axis=1)
                np.add.at(flow, self.side.from_last[1][i, y, k], f)
                np.add.at(flow, self.side.to_last[1][i, s, d], f)
                x[i - 1] += np.bincount(self.side.to_last[0][i, s, d] * w + p, f, w * w).reshape(w, w)


def pushed(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The flow of a product's parts, given that of the product."""
    s, v = np.nonzero(x)
    if not len(s):
        return None
    z, f, w = (a[s] + b.T[v]).argmin(axis=1), x[s, v], len(x)
    return np.bincount(s * w + z, f, w * w).reshape(w, w), np.bincount(z * w + v, f, w * w).reshape(w, w)


def loads(layers: Layers, cost: np.ndarray, src: np.ndarray, dst: np.ndarray, many: np.ndarray, over: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Edge flows, sum of weight times cost, and pairs without a path. Pairs are sorted by ``over``, their ``crossing``."""
    w, n = layers.width, layers.count
    up = Half(layers, layers.up, cost, layers.size)
    down = Half(layers, layers.down, cost, layers.size[::-1])
    flow, spent, lost = np.zeros(len(cost)), 0.0, 0
    x_up, x_down = np.zeros((n, w, w)), np.zeros((n, w, w))
    ends = [0, *(np.flatnonzero(over[1:] != over[:-1]) + 1).tolist(), len(over)]
    for one, other, x_one, x_other, turned in ((up, down, x_up, x_down, False), (down, up, x_down, x_up, True)):
        beyond, x_beyond = other.within[::-1], x_other[::-1]
        first, rest = one.arrivals(), one.departures(beyond)
        x_first, x_rest = np.zeros_like(first), np.zeros_like(rest)
        for a, b in zip(ends, ends[1:]):
            li, lj, m = layers.layer[src[a:b]], layers.layer[dst[a:b]], int(over[a])
            if turned:
                li, lj, m = n - 1 - li, n - 1 - lj, n - 1 - m
            rows = np.flatnonzero(li < lj if turned else li <= lj)
            if not len(rows):
                continue
            li, lj, x = li[rows], lj[rows], many[a:b][rows]
            s, t = layers.place[src[a:b][rows]], layers.place[dst[a:b][rows]]
            low, high = int(li.min()), int(lj.max())
            base = np.minimum(one.within[m], beyond[m])
            across, via = closure(base.copy(), int(one.size[m]))
            # To the crossing, first arrivals; from it on, [to, crossing].
            to, on = np.full((m - low + 1, w, w), INF), np.empty((high - m + 1, w, w))
            to[-1][np.arange(w), np.arange(w)] = 0.0
            for i in range(m - 1, low - 1, -1):
                to[i - low] = product(first[i], to[i + 1 - low])
            on[0] = across.T
            for j in range(m, high):
                on[j + 1 - m] = product(rest[j].T, on[j - m])
            at = np.empty(len(rows), dtype=np.int64)
            for c in range(0, len(rows), ROWS):
                part = slice(c, c + ROWS)
                found = to[li[part] - low, s[part]] + on[lj[part] - m, t[part]]
                k = found.argmin(axis=1)
                d = found[np.arange(len(k)), k]
                gone = d == INF
                at[part] = np.where(gone, -1, k)
                lost += int(gone.sum())
                spent += float(x[part][~gone] @ d[~gone])
            there = at >= 0
            li, lj, s, t, x, at = (v[there] for v in (li, lj, s, t, x, at))
            x_to = np.bincount(((li - low) * w + s) * w + at, x, to.size).reshape(to.shape)
            x_on = np.bincount(((lj - m) * w + t) * w + at, x, on.size).reshape(on.shape)
            for i in range(low, m):
                if (p := pushed(x_to[i - low], first[i], to[i + 1 - low])) is not None:
                    x_first[i] += p[0]
                    x_to[i + 1 - low] += p[1]
            for j in range(high - 1, m - 1, -1):
                if (p := pushed(x_on[j + 1 - m], rest[j].T, on[j - m])) is not None:
                    x_rest[j] += p[0].T
                    x_on[j - m] += p[1]
            single = steps_of(x_on[0].T.copy(), via)
            mine = one.within[m] <= beyond[m]
            x_one[m] += np.where(mine, single, 0.0)
            x_beyond[m] += np.where(mine, 0.0, single)
        one.unpack_arrivals(x_first, x_one, flow)
        one.unpack_departures(x_rest, beyond, x_beyond, flow)
    up.unpack_within(x_up, flow)
    down.unpack_within(x_down, flow)
    return flow, spent, lost
