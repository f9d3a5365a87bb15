"""Shortest paths of single requests on arrays, for Arrow tasks."""

from __future__ import annotations

import heapq

import numpy as np

from ..functions import fixed
from ..plans.arch import Arch

FAR = 1 << 60


class Grid:
    """The grid as arrays: where each net leads from each site, and what that costs. Sized by the chip."""

    def __init__(self, arch: Arch, scalar: np.ndarray | None = None, table: np.ndarray | None = None):
        w, h = arch.width, arch.height
        self.width, self.height = w, h
        blocked = np.zeros((h, w), bool)
        for lower, upper, left, right, *_ in arch.block_list:
            blocked[lower : upper + 1, left : right + 1] = True
        self.site = np.full((h, w), -1, np.int64)
        self.site[~blocked] = np.arange((~blocked).sum())
        self.y, self.x = np.nonzero(~blocked)
        pre = []
        for lines, n in ((arch.vertical, w), (arch.horizontal, h)):
            step = np.zeros(n, np.int64)
            for s, d in lines:
                if s + 1 < n:
                    step[s + 1] += d
            pre.append(np.cumsum(step))
        self.px, self.py = pre
        self.to, self.block, self.line = [], [], []
        ranks = {}
        for along_x in (True, False):
            inside = np.zeros((h, w), bool)
            passed = np.zeros((h, w), np.int64)
            for lower, upper, left, right, v, vd, hz, hd in arch.block_list:
                if along_x and hz:
                    inside[lower : upper + 1, left : right + 1] = True
                    passed[lower : upper + 1, left:] += hd
                if not along_x and v:
                    inside[lower : upper + 1, left : right + 1] = True
                    passed[lower:, left : right + 1] += vd
            axis = 1 if along_x else 0
            rank = np.cumsum(~inside, axis=axis) - 1
            n = w if along_x else h
            at = np.full((h if along_x else w, n), -1, np.int64)  # position of each rank in its row or column
            ys, xs = np.nonzero(~inside)
            at[(ys if along_x else xs), rank[ys, xs]] = xs if along_x else ys
            ranks[along_x] = rank, at, passed, n
        for _, _, dx, dy in arch.net_list:
            along_x = dx != 0
            rank, at, passed, n = ranks[along_x]
            d = dx if along_x else dy
            r = rank[self.y, self.x] + d
            ok = (r >= 0) & (r < n)
            land = np.where(ok, at[(self.y if along_x else self.x), np.clip(r, 0, n - 1)], -1)
            tx, ty = (land, self.y) if along_x else (self.x, land)
            ok &= land >= 0
            to = np.where(ok, self.site[np.where(ok, ty, 0), np.where(ok, tx, 0)], -1)
            ok = to >= 0
            p = self.px if along_x else self.py
            here = self.x if along_x else self.y
            self.to.append(to)
            self.block.append(np.where(ok, np.abs(passed[np.where(ok, ty, 0), np.where(ok, tx, 0)] - passed[self.y, self.x]), 0))
            self.line.append(np.where(ok, np.abs(p[np.where(ok, land, 0)] - p[here]), 0))
        self.back = []
        for to in self.to:
            inv = np.full(len(self.x), -1, np.int64)
            ok = np.flatnonzero(to >= 0)
            inv[to[ok]] = ok
            self.back.append(inv)
        self.nets, self.internal, self.n_internal = arch.net_list, arch.internal, len(arch.internal)
        self.ports = [n for n, _ in arch.port_list]
        self.port_of = {i: p for p, i in arch.internal.items()}
        self.arcs_from: dict[int, list[tuple[int, int]]] = {}
        self.arcs_to: dict[int, list[tuple[int, int]]] = {}
        for a, b, d in arch.arc_list:
            self.arcs_from.setdefault(a, []).append((b, d))
            self.arcs_to.setdefault(b, []).append((a, d))
        self.nets_from: dict[int, list[int]] = {}
        for i, (a, _, _, _) in enumerate(self.nets):
            self.nets_from.setdefault(a, []).append(i)
        self.forward: list[list[tuple[int, int, int]]] = [[] for _ in range(self.n_internal)]
        self.backward: list[list[tuple[int, int, int]]] = [[] for _ in range(self.n_internal)]
        for a, i in self.internal.items():
            for b, d in self.arcs_from.get(a, []):
                for n in self.nets_from.get(b, []):
                    j = self.internal[self.nets[n][1]]
                    self.forward[i].append((j, n, d))
                    self.backward[j].append((i, n, d))
        self.scalar, self.table = scalar, table

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_views"}

    def views(self) -> tuple:
        """The arrays as memory views, whose single items are read faster; made where they are used."""
        if "_views" not in self.__dict__:
            gap = [b + n for b, n in zip(self.block, self.line, strict=True)]
            out = [[memoryview(np.ascontiguousarray(a, np.int64)) for a in arrays] for arrays in (self.to, self.back, self.block, gap)]
            self._views = (*out, memoryview(self.x.astype(np.int64)), memoryview(self.y.astype(np.int64)))
        return self._views

    def bounds(self, t: int, tp: int):
        """Lower bounds of the delay left to one target, as a function of site and internal port, remembered by state."""
        if self.table is None:
            return lambda site, i: 0
        *_, xs, ys = self.views()
        tx, ty, known = xs[t], ys[t], {}
        part = [(int(self.scalar[d]) * ux, int(self.scalar[d]) * uy, self.table[d, tp].tolist()) for d, (ux, uy) in enumerate(fixed.DIRECTIONS)]

        def bound(site: int, i: int) -> int:
            if (site, i) not in known:
                dx, dy, best = tx - xs[site], ty - ys[site], 0
                for ax, ay, pot in part:
                    if pot[i] >= 0 and (v := ax * dx + ay * dy + pot[i]) > best:
                        best = v
                known[site, i] = -(-best // fixed.SCALE)
            return known[site, i]

        return bound

    def straight(self, s: int, t: int) -> int:
        """The delay of the lines between two sites."""
        return int(abs(self.px[self.x[s]] - self.px[self.x[t]]) + abs(self.py[self.y[s]] - self.py[self.y[t]]))

    def seeds(self, s: int, sp: int, relative: bool, inside) -> list[tuple[int, int, int, tuple]]:
        """(site, internal, delay, pins) after staying, a net, or an arc and a net."""
        out = [(s, self.internal[sp], 0, ((s, sp),))] if sp in self.internal else []
        ways = [(n, 0, ((s, sp),)) for n in self.nets_from.get(sp, [])]
        ways += [(n, d, ((s, sp), (s, b))) for b, d in self.arcs_from.get(sp, []) for n in self.nets_from.get(b, [])]
        for n, d, pins in ways:
            land = int(self.to[n][s])
            if land >= 0 and inside(land):
                to = self.nets[n][1]
                out.append((land, self.internal[to], d + int(self.block[n][s]) + (0 if relative else int(self.line[n][s])), (*pins, (land, to))))
        return out

    def last_step(self, internal: int, tp: int) -> int | None:
        if self.port_of[internal] == tp:
            return 0
        return min((d for b, d in self.arcs_from.get(self.port_of[internal], []) if b == tp), default=None)

    def box(self, s: int, sp: int, t: int, margin: int | str | None):
        """Whether a site is within ``margin`` of the pins' rectangle; auto: the farthest first hop."""
        if margin is None:
            return lambda site: True
        if margin == "auto":
            far = [max(abs(self.x[c[0]] - self.x[s]), abs(self.y[c[0]] - self.y[s])) for c in self.seeds(s, sp, False, lambda site: True)]
            margin = int(max(far, default=0))
        left, right = min(self.x[s], self.x[t]) - margin, max(self.x[s], self.x[t]) + margin
        low, high = min(self.y[s], self.y[t]) - margin, max(self.y[s], self.y[t]) + margin
        return lambda site: left <= self.x[site] <= right and low <= self.y[site] <= high

    def shortest(self, s: int, sp: int, t: int, tp: int, relative: bool = False, margin: int | str | None = None, guided: bool = True) -> tuple[int | None, list[tuple[int, int]]]:
        """(delay, pins), delay None where the target can't be reached. guided: A* by bound(), else Dijkstra."""
        if s == t and sp == tp:
            return 0, [(s, sp)]
        extra = self.straight(s, t) if relative else 0
        best, end = FAR, None
        if s == t:
            for b, d in self.arcs_from.get(sp, []):
                if b == tp and d < best:
                    best, end = d, "direct"
        inside = self.box(s, sp, t, margin)
        h = self.bounds(t, tp) if guided and not relative else (lambda site, i: 0)
        to, _, block, gap, _, _ = self.views()
        cost = block if relative else gap
        dist: dict[tuple[int, int], int] = {}
        come: dict[tuple[int, int], tuple] = {}
        heap: list[tuple[int, int, int, int]] = []
        for site, i, g, pins in self.seeds(s, sp, relative, inside):
            if g < dist.get((site, i), FAR):
                dist[site, i], come[site, i] = g, ("seed", pins)
                heapq.heappush(heap, (g + h(site, i), g, site, i))
        while heap:
            f, g, site, i = heapq.heappop(heap)
            if f >= best:
                break
            if g > dist[site, i]:
                continue
            if site == t and (last := self.last_step(i, tp)) is not None and g + last < best:
                best, end = g + last, (site, i)
            for j, n, d in self.forward[i]:
                land = to[n][site]
                if land < 0 or not inside(land):
                    continue
                step = g + d + cost[n][site]
                if step < best and step < dist.get((land, j), FAR) and (f := step + h(land, j)) < best:
                    dist[land, j], come[land, j] = step, ((site, i), n)
                    heapq.heappush(heap, (f, step, land, j))
        if end is None:
            return None, []
        if end == "direct":
            return best + extra, [(s, sp), (t, tp)]
        pins: list[tuple[int, int]] = [] if self.port_of[end[1]] == tp else [(t, tp)]
        state = end
        while come[state][0] != "seed":
            before, n = come[state]
            pins = [(before[0], self.nets[n][0]), (state[0], self.nets[n][1]), *pins]
            state = before
        return best + extra, [*come[state][1], *pins]

    def both_ways(self, s: int, sp: int, t: int, tp: int, relative: bool = False, margin: int | str | None = None) -> int | None:
        """The same delay by Dijkstra from both ends at once; the side with the smaller top goes on."""
        if s == t and sp == tp:
            return 0
        extra = self.straight(s, t) if relative else 0
        best = min((d for b, d in self.arcs_from.get(sp, []) if s == t and b == tp), default=FAR)
        inside = self.box(s, sp, t, margin)
        to, back, block, gap, _, _ = self.views()
        cost, moves, edges = (block if relative else gap), (to, back), (self.forward, self.backward)
        dist: list[dict[tuple[int, int], int]] = [{}, {}]
        heaps: list[list[tuple[int, int, int]]] = [[], []]
        first = [(site, i, g) for site, i, g, _ in self.seeds(s, sp, relative, inside)]
        ends = [(t, self.internal[tp], 0)] if tp in self.internal else []
        ends += [(t, self.internal[a], d) for a, d in self.arcs_to.get(tp, []) if a in self.internal]
        for k, starts in enumerate((first, ends)):
            for site, i, g in starts:
                if g < dist[k].get((site, i), FAR):
                    dist[k][site, i] = g
                    heapq.heappush(heaps[k], (g, site, i))
                    best = min(best, g + dist[1 - k].get((site, i), FAR))
        while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] < best:
            k = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
            g, site, i = heapq.heappop(heaps[k])
            if g > dist[k][site, i]:
                continue
            for j, n, d in edges[k][i]:
                land = moves[k][n][site]
                if land < 0 or not inside(land):
                    continue
                step = g + d + cost[n][site if k == 0 else land]
                if step < dist[k].get((land, j), FAR):
                    dist[k][land, j] = step
                    heapq.heappush(heaps[k], (step, land, j))
                    best = min(best, step + dist[1 - k].get((land, j), FAR))
        return None if best >= FAR else best + extra
