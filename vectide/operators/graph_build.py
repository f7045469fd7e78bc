"""Building a layered graph in numpy, a batch of nodes at a time.

A node's candidates are the nearest nodes inserted before it, as many as the beam is wide. In a
graph of PRODUCT_ROWS nodes at most a matrix product finds them, which is what a walk looks for
and takes less time. In a larger one the nodes of a batch walk the graph in step, a step's links
and distances being a few array operations for all of them; what each finds is joined by the
nodes of the batch before it, so a batch sees no fewer candidates than nodes inserted one by one.
Batches grow from one node to BATCH. Links are kept as a matrix a level, -1 where there is none.
Distances that only order candidates are single precision; by l2 they are taken from the middle
of the vectors, so that products don't cancel out.
"""

from __future__ import annotations

import numpy as np

#: Nodes that are inserted in one go, and marks of seen nodes (batch x nodes) that are held at most.
BATCH, MARKS = 256, 1 << 24
#: Nodes of a graph whose candidates are found by matrix products, at most.
PRODUCT_ROWS = 1 << 16
#: Open nodes that each walk expands at a time.
FRONTIER = 8
#: Distances between candidates that are held at a time.
PAIRS = 1 << 23


class Builder:
    """levels[i] is the highest level of node i; links(i) is what the build gives."""

    def __init__(self, vectors: np.ndarray, by: str, m: int, width: int, levels: list[int]):
        if by == "l2" and len(vectors):
            vectors = vectors - vectors.mean(axis=0)
        self.x, self.by, self.m, self.width = np.ascontiguousarray(vectors, np.float32), by, m, width
        self.levels = np.array(levels, np.int64)
        self.n, self.entry, self.top = len(levels), -1, -1
        self.near = [np.full((self.n, m if level else 2 * m), -1, np.int32) for level in range(int(self.levels.max(initial=0)) + 1)]
        self.extra: dict[int, list[int]] = {}
        #: By level its nodes in order, while candidates are found by products.
        self.on = [np.flatnonzero(self.levels >= level) for level in range(len(self.near))] if self.n <= PRODUCT_ROWS else None

    def build(self) -> None:
        at, most = 0, max(1, min(BATCH, MARKS // max(1, self.n)))
        while at < self.n:
            end = min(self.n, at + max(1, min(at, most)))
            self._insert(np.arange(at, end))
            at = end
        if self.n:
            self._connect()

    def links(self, node: int) -> list[list[int]]:
        found = [self.near[level][node] for level in range(int(self.levels[node]) + 1)]
        lists = [f[f >= 0].tolist() for f in found]
        lists[0] += self.extra.get(node, [])
        return lists

    def _far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 1 - np.einsum("ij,ij->i", a, b) if self.by == "ip" else ((a - b) ** 2).sum(axis=1)

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of every row of a[g] to every row of b[g]."""
        d = a @ b.swapaxes(-1, -2)  # worked on in place
        if self.by == "ip":
            return np.subtract(1, d, out=d)
        d *= -2
        d += (a * a).sum(-1)[..., :, None]
        d += (b * b).sum(-1)[..., None, :]
        return np.maximum(d, 0, out=d)

    def _walk(self, nodes: np.ndarray, start: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, distances) that best-first walks of the nodes' vectors keep, a row each, nearest first; -1 and inf fill rows up."""
        queries, links, b = self.x[nodes], self.near[level], len(nodes)
        marks = np.zeros(b * self.n, np.int32)
        held = np.full((b, width), -1, np.int32)
        dist = np.full((b, width), np.inf, np.float32)
        open_ = np.zeros((b, width), bool)
        held[:, 0], dist[:, 0], open_[:, 0] = start, self._far(self.x[start], queries), True
        marks[np.arange(b) * self.n + start] = 1
        take = min(FRONTIER, width)
        while True:
            rows = np.flatnonzero(open_.any(axis=1))
            if not len(rows):
                break
            waiting = np.where(open_[rows], dist[rows], np.inf)
            front = np.argpartition(waiting, take - 1, axis=1)[:, :take] if take < width else np.broadcast_to(np.arange(width), waiting.shape)
            good = np.isfinite(np.take_along_axis(waiting, front, 1))
            r, c = np.nonzero(good)
            r, c = rows[r], front[good]
            open_[r, c] = False
            to = links[held[r, c]]
            some = to >= 0
            of, to = np.repeat(r, some.sum(axis=1)), to[some]
            place = of * self.n + to
            fresh = marks[place] == 0
            of, to, place = of[fresh], to[fresh], place[fresh]
            order = np.arange(1, len(place) + 1, dtype=np.int32)
            marks[place] = order
            once = marks[place] == order  # a node that several of the front link to counts once
            of, to = of[once], to[once]
            d = self._far(self.x[to], queries[of])
            better = d < dist.max(axis=1)[of]
            of, to, d = of[better], to[better], d[better]
            if not len(of):
                continue
            counts = np.bincount(of, minlength=b)
            grown = np.flatnonzero(counts)
            slot = np.arange(len(of)) - (np.cumsum(counts) - counts)[of]
            line = np.zeros(b, np.int64)
            line[grown] = np.arange(len(grown))
            size = width + int(counts.max())
            all_d, all_n, all_o = np.full((len(grown), size), np.inf, np.float32), np.full((len(grown), size), -1, np.int32), np.zeros((len(grown), size), bool)
            all_d[:, :width], all_n[:, :width], all_o[:, :width] = dist[grown], held[grown], open_[grown]
            all_d[line[of], width + slot], all_n[line[of], width + slot], all_o[line[of], width + slot] = d, to, True
            best = np.argpartition(all_d, width - 1, axis=1)[:, :width]
            dist[grown], held[grown], open_[grown] = np.take_along_axis(all_d, best, 1), np.take_along_axis(all_n, best, 1), np.take_along_axis(all_o, best, 1)
        return _sorted(held, dist)

    def _nearest(self, nodes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, distances) of those of a level before each of the nodes (a run of the level's) that are nearest, width of them, nearest first; -1 and inf fill rows up."""
        at = int(np.searchsorted(self.on[level], nodes[0]))
        before = self.on[level][: at + len(nodes)].astype(np.int32)
        dist = self._between(self.x[nodes], self.x[before])
        dist[:, at:][~np.tri(len(nodes), k=-1, dtype=bool)] = np.inf
        if self.width < len(before):
            best = np.argpartition(dist, self.width - 1, axis=1)[:, : self.width]
            found, dist = before[best], np.take_along_axis(dist, best, 1)
        else:
            found = np.broadcast_to(before, dist.shape)
        return _sorted(np.where(np.isfinite(dist), found, -1), dist)

    def _diverse(self, found: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """A row's nodes, nearest first, that none chosen before is nearer to than the centre is, -1 elsewhere; all if there are fewer than most."""
        head = 4 * most
        chosen = self._chosen(found[:, :head], dist[:, :head], most)
        if found.shape[1] > head:  # a row seldom needs more to get most of them
            chosen = np.hstack([chosen, np.zeros((len(found), found.shape[1] - head), bool)])
            late = np.flatnonzero((found[:, head] >= 0) & (chosen.sum(axis=1) < most))
            chosen[late] = self._chosen(found[late], dist[late], most)
        return np.where(chosen, found, -1)

    def _chosen(self, found: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        g, c = found.shape
        chosen = np.zeros((g, c), bool)
        step = max(1, PAIRS // max(1, c * c))
        for a in range(0, g, step):
            nodes, d = found[a : a + step], dist[a : a + step]
            x = self.x[nodes]
            apart = self._between(x, x)
            good = nodes >= 0
            few = good.sum(axis=1) < most
            n, taken = np.zeros(len(nodes), np.int64), chosen[a : a + step]
            for i in range(c):
                now = good[:, i] & (n < most)
                taken[:, i] = now
                n += now
                good[:, i + 1 :] &= (apart[:, i, i + 1 :] >= d[:, i + 1 :]) | (~now | few)[:, None]
                if (n >= most).all():
                    break
        return chosen

    def _insert(self, batch: np.ndarray) -> None:
        if self.entry < 0:
            self.entry, self.top = int(batch[0]), int(self.levels[batch[0]])
            return
        own = self.levels[batch]
        if self.on is not None:
            for level in range(int(own.max()), -1, -1):
                nodes = batch[own >= level]
                self._link(nodes, self._diverse(*self._nearest(nodes, level), self.m), level)
            if own.max() > self.top:
                self.entry, self.top = int(batch[own.argmax()]), int(own.max())
            return
        among = self._between(self.x[batch], self.x[batch])
        at = np.full(len(batch), self.entry)
        for level in range(max(self.top, int(own.max())), -1, -1):
            joins = own >= level
            if level <= self.top and not joins.all():
                at[~joins] = self._walk(batch[~joins], at[~joins], level, 1)[0][:, 0]
            if not joins.any():
                continue
            nodes = batch[joins]
            earlier = np.where(np.tri(len(nodes), k=-1, dtype=bool), among[np.ix_(joins, joins)], np.inf).astype(np.float32)
            mates = np.where(np.isfinite(earlier), nodes[None, :], -1).astype(np.int32)
            if level <= self.top:
                found, dist = self._walk(nodes, at[joins], level, self.width)
                at[joins] = found[:, 0]
                found, dist = np.hstack([found, mates]), np.hstack([dist, earlier])
            else:
                found, dist = mates, earlier
            found, dist = (x[:, : self.width] for x in _sorted(found, dist))
            self._link(nodes, self._diverse(found, dist, self.m), level)
        if own.max() > self.top:
            self.entry, self.top = int(batch[own.argmax()]), int(own.max())

    def _link(self, nodes: np.ndarray, chosen: np.ndarray, level: int) -> None:
        """Links from the nodes to what they chose, and back; links back that are too many are thinned out."""
        near = self.near[level]
        cap = near.shape[1]
        rows, places = np.nonzero(chosen >= 0)
        to, back = chosen[rows, places], nodes[rows]
        near[back, np.arange(len(rows)) - np.searchsorted(rows, rows)] = to
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        others, first, gain = np.unique(to, return_index=True, return_counts=True)
        slot = np.arange(len(to)) - np.repeat(first, gain)
        has = (near[others] >= 0).sum(axis=1)
        fits = has + gain <= cap
        every = np.repeat(fits, gain)
        near[to[every], np.repeat(has, gain)[every] + slot[every]] = back[every]
        full = np.flatnonzero(~fits)
        full = full[np.argsort(gain[full], kind="stable")]
        while len(full):
            n = max(1, min(len(full), PAIRS // (cap + int(gain[full[: PAIRS // (cap * cap)]].max())) ** 2))
            some, full = full[:n], full[n:]
            held = np.full((n, cap + int(gain[some].max())), -1, np.int32)
            held[:, :cap] = near[others[some]]
            line = np.repeat(np.arange(n), gain[some])
            of = np.arange(len(line)) - np.repeat(np.cumsum(gain[some]) - gain[some], gain[some])
            held[line, cap + of] = back[first[some][line] + of]
            centre = self.x[others[some]][:, None, :]
            dist = np.where(held >= 0, self._between(centre, self.x[held])[:, 0, :], np.inf)
            kept = _packed(self._diverse(*_sorted(held, dist), cap))[:, :cap]
            near[others[some], : kept.shape[1]] = kept

    def _reach(self, start: int, seen: np.ndarray) -> None:
        front = np.array([start])
        seen[start] = True
        while len(front):
            to = self.near[0][front]
            to = np.unique(to[to >= 0])
            front = to[~seen[to]]
            seen[front] = True

    def _connect(self) -> None:
        """Links every node that no walk from the entry reaches on level 0 from the nearest one that is reached."""
        seen = np.zeros(self.n, bool)
        self._reach(self.entry, seen)
        while not seen.all():
            node, reached = int(seen.argmin()), np.flatnonzero(seen)
            nearest = int(reached[self._between(self.x[None, node], self.x[reached])[0].argmin()])
            self.extra.setdefault(nearest, []).append(node)
            self._reach(node, seen)


def _sorted(nodes: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by distance; ties go to the smaller node, so that nothing hangs on the order in which nodes were met."""
    order = np.lexsort((nodes, dist), axis=1)
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(dist, order, 1)


def _packed(nodes: np.ndarray) -> np.ndarray:
    """Rows with their -1 at the end."""
    return np.take_along_axis(nodes, np.argsort(nodes < 0, axis=1, kind="stable"), 1)
