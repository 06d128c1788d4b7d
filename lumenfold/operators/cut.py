"""Minimum cuts and seam labelling. A seam problem is one frame set at preview size: it fits a task."""

from __future__ import annotations

from collections import deque

import numpy as np

from ..config import Seam


class Network:
    """Max-flow by breadth-first levels and blocking flows, over arcs in pairs."""

    def __init__(self, nodes: int) -> None:
        self.n = nodes + 2
        self.arcs: list[list[int]] = [[] for _ in range(self.n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def edge(self, a: int, b: int, ab: float, ba: float) -> None:
        for u, v, c in ((a, b, ab), (b, a, ba)):
            self.arcs[u].append(len(self.to))
            self.to.append(v)
            self.room.append(float(c))

    def terminal(self, a: int, source: float, sink: float) -> None:
        """What can flow into a node from the source, and out of it to the sink."""
        if source > 0:
            self.edge(self.n - 2, a, source, 0.0)
        if sink > 0:
            self.edge(a, self.n - 1, sink, 0.0)

    def _levels(self) -> list[int]:
        level = [-1] * self.n
        level[self.n - 2] = 0
        todo = deque([self.n - 2])
        while todo:
            a = todo.popleft()
            for e in self.arcs[a]:
                if self.room[e] > 1e-12 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    todo.append(self.to[e])
        return level

    def flow(self) -> float:
        source, sink, total = self.n - 2, self.n - 1, 0.0
        while (level := self._levels())[sink] >= 0:
            at = [0] * self.n
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    push = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= push
                        self.room[e ^ 1] += push
                    total += push
                    path, a = [], source
                    continue
                while at[a] < len(self.arcs[a]):
                    e = self.arcs[a][at[a]]
                    if self.room[e] > 1e-12 and level[self.to[e]] == level[a] + 1:
                        break
                    at[a] += 1
                else:
                    if a == source:
                        break
                    back = path.pop()
                    a = self.to[back ^ 1]
                    at[a] += 1
                    continue
                path.append(e)
                a = self.to[e]
        return total

    def source_side(self) -> list[bool]:
        return [x >= 0 for x in self._levels()[:-2]]


def energy(labels: np.ndarray, value: np.ndarray, weight: np.ndarray, edges: np.ndarray, cfg: Seam = Seam()) -> float:
    """value, weight: pixel x label, NaN where a label has no sample there."""
    rows = np.arange(len(labels))
    return float(_data(weight, cfg)[rows, labels].sum() + sum(_pair(value, a, b, labels[a], labels[b], cfg) for a, b in edges))


def _data(weight: np.ndarray, cfg: Seam) -> np.ndarray:
    return np.where(np.isnan(weight), cfg.unavailable, np.nanmax(weight, axis=1, keepdims=True) - weight)


def _pair(value: np.ndarray, a: int, b: int, la: int, lb: int, cfg: Seam) -> float:
    if la == lb:
        return 0.0
    gaps = abs(value[a, la] - value[a, lb]), abs(value[b, la] - value[b, lb])
    return cfg.smoothness * (sum(0.0 if g != g else g for g in gaps) + cfg.min_cost)


def label_seams(value: np.ndarray, weight: np.ndarray, edges: np.ndarray, cfg: Seam = Seam()) -> np.ndarray:
    """Labels of low energy: from the best weights, each label in turn takes what lowers the cost, by a cut."""
    data = _data(weight, cfg)
    labels = data.argmin(axis=1)
    best = energy(labels, value, weight, edges, cfg)
    for _ in range(cfg.sweeps):
        before = best
        for new in range(weight.shape[1]):
            net = Network(len(labels))
            keep, take = data[np.arange(len(labels)), labels].copy(), data[:, new].copy()
            for a, b in edges:
                # source side keeps, sink side takes: kk + (tk - kk) [a takes] - tk [b takes] + (kt + tk - kk) [a keeps, b takes]
                kk, kt, tk = (_pair(value, a, b, x, y, cfg) for x, y in ((labels[a], labels[b]), (labels[a], new), (new, labels[b])))
                take[a] += tk - kk
                take[b] -= tk
                net.edge(int(a), int(b), max(0.0, kt + tk - kk), 0.0)
            for p in range(len(labels)):
                low = min(keep[p], take[p])
                net.terminal(p, take[p] - low, keep[p] - low)
            net.flow()
            trial = np.where(net.source_side(), labels, new)
            cost = energy(trial, value, weight, edges, cfg)
            if cost < best - 1e-9:
                labels, best = trial, cost
        if best >= before - 1e-9:
            break
    return polished(labels, value, data, edges, cfg)


def polished(labels: np.ndarray, value: np.ndarray, data: np.ndarray, edges: np.ndarray, cfg: Seam = Seam(), rounds: int = 6) -> np.ndarray:
    """Pixel by pixel the label that costs least beside its neighbours, until none changes; never a higher energy."""
    near: list[list[int]] = [[] for _ in labels]
    for a, b in edges:
        near[a].append(int(b))
        near[b].append(int(a))
    labels = labels.copy()
    for _ in range(rounds):
        changed = False
        for p in range(len(labels)):
            cost = [data[p, k] + sum(_pair(value, p, q, k, labels[q], cfg) for q in near[p]) for k in range(data.shape[1])]
            best = int(np.argmin(cost))
            if cost[best] < cost[labels[p]] - 1e-12:
                labels[p], changed = best, True
        if not changed:
            break
    return labels


SMALL = 16  #: pixels of problems that are solved side by side


def label_many(value: np.ndarray, weight: np.ndarray, edges: np.ndarray, cfg: Seam = Seam()) -> tuple[np.ndarray, np.ndarray]:
    """value, weight: problem x pixel x label -> labels and energies, as `label_seams` has them of each problem.

    Small problems of one shape take the same steps at once: expansions by cuts, sweep by sweep while any gains, then pixel by pixel.
    """
    data = np.where(np.isnan(weight), cfg.unavailable, np.fmax.reduce(weight, axis=2, keepdims=True) - weight)
    labels = data.argmin(axis=2)
    best = _energies(labels, value, data, edges, cfg)
    active = np.arange(len(labels))
    for _ in range(cfg.sweeps):
        before = best[active].copy()
        for new in range(weight.shape[2]):
            v, d, own = value[active], data[active], labels[active]
            trial = np.where(_kept(v, d, own, new, edges, cfg), own, new)
            cost = _energies(trial, v, d, edges, cfg)
            gains = cost < best[active] - 1e-9
            labels[active[gains]], best[active[gains]] = trial[gains], cost[gains]
        active = active[best[active] < before - 1e-9]
        if not len(active):
            break
    labels = _polished_many(labels, value, data, edges, cfg)
    return labels, _energies(labels, value, data, edges, cfg)


def _of(table: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """problem x place x label -> what it says of one label a place."""
    return np.take_along_axis(table, labels[..., None], axis=2)[..., 0]


def _gaps(va: np.ndarray, vb: np.ndarray, la: np.ndarray, lb: np.ndarray, cfg: Seam) -> np.ndarray:
    """Costs of edges between pixels of values va, vb (problem x edge x label) that are labelled la, lb."""
    gaps = sum(np.nan_to_num(np.abs(_of(v, la) - _of(v, lb)), nan=0.0) for v in (va, vb))
    return np.where(la == lb, 0.0, cfg.smoothness * (gaps + cfg.min_cost))


def _energies(labels: np.ndarray, value: np.ndarray, data: np.ndarray, edges: np.ndarray, cfg: Seam) -> np.ndarray:
    a, b = edges[:, 0], edges[:, 1]
    return _of(data, labels).sum(axis=1) + _gaps(value[:, a], value[:, b], labels[:, a], labels[:, b], cfg).sum(axis=1)


def _kept(value: np.ndarray, data: np.ndarray, labels: np.ndarray, new: int, edges: np.ndarray, cfg: Seam) -> np.ndarray:
    """Which pixels keep their label in the best expansion of a new one: problem x pixel."""
    a, b = edges[:, 0], edges[:, 1]
    va, vb, la, lb = value[:, a], value[:, b], labels[:, a], labels[:, b]
    other = np.full_like(la, new)
    kk, kt, tk = (_gaps(va, vb, x, y, cfg) for x, y in ((la, lb), (la, other), (other, lb)))
    keep, take = _of(data, labels), data[:, :, new].copy()
    n, pixels = len(labels), data.shape[1]
    room = np.zeros((n, pixels + 2, pixels + 2))
    for e, (p, q) in enumerate(edges):
        take[:, p] += tk[:, e] - kk[:, e]
        take[:, q] -= tk[:, e]
        room[:, p, q] += np.maximum(0.0, kt[:, e] + tk[:, e] - kk[:, e])
    low = np.minimum(keep, take)
    room[:, -2, :-2], room[:, :-2, -1] = take - low, keep - low
    return _source_sides(room)[:, :-2]


def _source_sides(room: np.ndarray) -> np.ndarray:
    """room: network x node x node, source and sink last -> which nodes the source reaches once no path to the sink is left.

    Paths of least steps are found and filled in all networks at once, those that are done aside.
    """
    reached = np.zeros(room.shape[:2], bool)
    todo = np.arange(len(room))
    while len(todo):
        r, here = room[todo], np.zeros((len(todo), room.shape[1]), bool)
        here[:, -2] = True
        fresh, before = here.copy(), np.zeros(here.shape, np.int64)
        while fresh.any():
            steps = fresh[:, :, None] & (r > 1e-12)
            fresh = steps.any(axis=1) & ~here
            before[fresh] = steps.argmax(axis=1)[fresh]
            here |= fresh
        ends = here[:, -1]
        reached[todo[~ends]] = here[~ends]
        todo, before = todo[ends], before[ends]
        push, at, on = np.full(len(todo), np.inf), np.full(len(todo), room.shape[1] - 1), np.arange(len(todo))
        path = []
        while len(on):
            was = before[on, at[on]]
            push[on] = np.minimum(push[on], room[todo[on], was, at[on]])
            path.append((on, was, at[on].copy()))
            at[on] = was
            on = on[was != room.shape[1] - 2]
        for on, p, q in path:
            room[todo[on], p, q] -= push[on]
            room[todo[on], q, p] += push[on]
    return reached


def _polished_many(labels: np.ndarray, value: np.ndarray, data: np.ndarray, edges: np.ndarray, cfg: Seam, rounds: int = 6) -> np.ndarray:
    """As `polished`."""
    near: list[list[int]] = [[] for _ in range(data.shape[1])]
    for a, b in edges:
        near[a].append(int(b))
        near[b].append(int(a))
    labels, rows = labels.copy(), np.arange(len(labels))
    for _ in range(rounds):
        changed = False
        for p, others in enumerate(near):
            cost = data[:, p].copy()
            for k in range(data.shape[2]):
                for q in others:
                    cost[:, k] += _gaps(value[:, [p]], value[:, [q]], np.full((len(rows), 1), k), labels[:, [q]], cfg)[:, 0]
            best = cost.argmin(axis=1)
            less = cost[rows, best] < cost[rows, labels[:, p]] - 1e-12
            labels[less, p] = best[less]
            changed = changed or bool(less.any())
        if not changed:
            break
    return labels
