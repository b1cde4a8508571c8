"""Hierarchical navigable small-world graphs in NumPy: many nodes are inserted, and many queries searched, in step.

A graph's nodes lie in a random order, of which every layer above the lowest holds a first part, each RATIO times smaller than
the one below. A search goes down from the topmost layer, whose nodes are all compared, as a crowd of near copies may have
few links that lead to it, but has nodes there; and on each layer it widens
a beam of the best nodes seen along the links of those it holds.
"""

from __future__ import annotations

import numpy as np

LINKS, RATIO, TOP, BUILD_BEAM, UPPER_BEAM, STEP, OPEN = 12, 8, 4096, 24, 4, 256, 4


def layer_sizes(n: int) -> list[int]:
    """Nodes of each layer, lowest first; the topmost has TOP at most."""
    sizes = [n]
    while sizes[-1] > TOP:
        sizes.append(-(-sizes[-1] // RATIO))
    return sizes


class Graph:
    """vectors: unit vectors (float32) in the graph's order; layers: each layer's links as a matrix, -1 where there is none."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None):
        self.vectors, self.sizes = vectors, layer_sizes(len(vectors))
        self.layers = self._build() if layers is None else layers

    # building

    def _build(self) -> list[np.ndarray]:
        self.layers = [np.full((n, 2 * LINKS if k == 0 else LINKS), -1, dtype=np.int32) for k, n in enumerate(self.sizes[:-1])]
        for k in range(len(self.sizes) - 2, -1, -1):
            done, n = 0, self.sizes[k]
            while done < n:
                step = min(n - done, max(256, min(done, 1024)))
                self._insert(k, done, done + step)
                done += step
        return self.layers

    def _insert(self, k: int, lo: int, hi: int) -> None:
        """Link nodes lo .. hi - 1 of layer k with each other and with the nodes before them."""
        new = np.arange(lo, hi)
        among = self.vectors[lo:hi] @ self.vectors[lo:hi].T
        np.fill_diagonal(among, -np.inf)
        most = min(BUILD_BEAM, hi - lo - 1)
        ids = np.argpartition(-among, most - 1, axis=1)[:, :most] if most > 0 else np.zeros((hi - lo, 0), dtype=np.int64)
        sims, ids = np.take_along_axis(among, ids, axis=1), ids + lo
        if lo:
            found = self._beams(k, lo, hi)
            ids = np.concatenate([ids, np.concatenate([f[0] for f in found])], axis=1)
            sims = np.concatenate([sims, np.concatenate([f[1] for f in found])], axis=1)
        width = self.layers[k].shape[1]
        for at in range(0, len(new), 128):
            part = slice(at, at + 128)
            self.layers[k][new[part]] = self._choose(ids[part], sims[part], LINKS, width)
        self._link_back(k, new)

    def _beams(self, k: int, lo: int, hi: int) -> list:
        out = []
        for a in range(lo, hi, STEP):
            asked = self.vectors[a : min(a + STEP, hi)]
            out.append(self._beam(k, asked, *self._enter(k, asked, lo), lo, BUILD_BEAM))
        return out

    def _choose(self, ids: np.ndarray, sims: np.ndarray, most: int, width: int) -> np.ndarray:
        """Of each row's candidates the best `most` that are nearer to the row's node than to one chosen before, filled up with
        the best of the others: links lead to several sides, so that a crowd of near copies isn't cut off from the rest."""
        order = np.argsort(-np.where(ids >= 0, sims, -np.inf), axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        rows = np.arange(len(ids))
        between = self.vectors[ids] @ self.vectors[ids].transpose(0, 2, 1)
        free = (ids >= 0) & (sims > -np.inf)
        chosen = np.zeros_like(free)
        out = np.full((len(ids), width), -1, dtype=np.int32)
        for place in range(most):
            pick = free.argmax(axis=1)
            ok = free[rows, pick]
            if not ok.any():
                break
            out[ok, place] = ids[rows, pick][ok]
            chosen[rows[ok], pick[ok]] = True
            free &= ~(ok[:, None] & ((between[rows, pick] > sims) | (np.arange(ids.shape[1]) == pick[:, None])))
        # the rest of the row's room, nearest first
        spare = (ids >= 0) & (sims > -np.inf) & ~chosen
        room = (out >= 0).sum(axis=1)
        place = np.cumsum(spare, axis=1) - 1 + room[:, None]
        r, c = np.nonzero(spare & (place < most))
        out[r, place[r, c]] = ids[r, c]
        return out

    def _link_back(self, k: int, new: np.ndarray) -> None:
        """Links of new nodes hold in the other direction too; a node with too many keeps a choice of them."""
        links, width = self.layers[k], self.layers[k].shape[1]
        a = np.repeat(new, width)
        b = links[new].ravel()
        a, b = a[b >= 0], b[b >= 0]
        sims = np.einsum("ij,ij->i", self.vectors[a], self.vectors[b])
        order = np.lexsort((-sims, b))
        a, b = a[order], b[order]
        to, starts = np.unique(b, return_index=True)
        rank = np.arange(len(b)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(b)]))))
        extra = np.full((len(to), width), -1, dtype=np.int64)
        keep = rank < width
        extra[np.searchsorted(to, b[keep]), rank[keep]] = a[keep]
        for at in range(0, len(to), 128):
            node = to[at : at + 128]
            ids = np.concatenate([links[node], extra[at : at + 128]], axis=1).astype(np.int64)
            ids.sort(axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            few = (ids >= 0).sum(axis=1) <= width
            sims = np.where(ids >= 0, np.einsum("ij,ikj->ik", self.vectors[node], self.vectors[ids]), -np.inf)
            best = self._choose(ids[~few], sims[~few], width, width) if (~few).any() else None
            links[node[few]] = -np.sort(-ids[few], axis=1)[:, :width]
            if best is not None:
                links[node[~few]] = best

    # searching

    def _enter(self, k: int, asked: np.ndarray, below: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nodes to start from on layer k: the best of the layer above (of the nodes before `below`, where given)."""
        top = len(self.sizes) - 1
        n = self.sizes[top] if below is None else min(self.sizes[top], below)
        sims = asked @ self.vectors[:n].T
        most = min(UPPER_BEAM, n)
        ids = np.argpartition(-sims, most - 1, axis=1)[:, :most]
        sims = np.take_along_axis(sims, ids, axis=1)
        for layer in range(top - 1, k, -1):
            if below is None or self.sizes[layer] <= below:
                ids, sims = self._beam(layer, asked, ids, sims, self.sizes[layer], UPPER_BEAM)
        return ids, sims

    def _beam(self, k: int, asked: np.ndarray, ids: np.ndarray, sims: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The best `width` nodes of layer k that a search from the given ones meets, for each query; -1 where there are fewer."""
        links, q = self.layers[k], len(asked)
        best = np.full((q, width), -1, dtype=np.int64)
        score = np.full((q, width), -np.inf, dtype=np.float32)
        unseen = np.ones((q, n), dtype=bool)
        first = min(ids.shape[1], width)
        best[:, :first], score[:, :first] = ids[:, :first], np.where(ids[:, :first] >= 0, sims[:, :first], -np.inf)
        r, c = np.nonzero(best >= 0)
        unseen[r, best[r, c]] = False
        waiting = best >= 0
        stamp = np.zeros((q, n), dtype=np.int32)
        live = np.arange(q)
        while True:
            live = live[waiting[live].any(axis=1)]
            if not len(live):
                return best, score
            rows = np.arange(len(live))[:, None]
            held = np.where(waiting[live], score[live], -np.inf)
            some = min(OPEN, width)
            pick = np.argpartition(-held, some - 1, axis=1)[:, :some]
            real = held[rows, pick] > -np.inf
            waiting[live[:, None], pick] = False
            near = np.where(real[:, :, None], links[best[live[:, None], pick]], -1).reshape(len(live), -1)
            r, c = np.nonzero(near >= 0)
            node = near[r, c]
            own = live[r]
            new = unseen[own, node]
            r, node, own = r[new], node[new], own[new]
            turn = np.arange(len(node), dtype=np.int32)
            stamp[own, node] = turn  # a node that is met twice counts once
            once = stamp[own, node] == turn
            r, node, own = r[once], node[once], own[once]
            if not len(node):
                continue
            unseen[own, node] = False
            sim = np.einsum("ij,ij->i", asked[own], self.vectors[node])
            good = sim > score[own].min(axis=1)
            r, node, sim = r[good], node[good], sim[good]
            if not len(node):
                continue
            place = np.arange(len(r)) - np.searchsorted(r, r)
            room = int(place.max()) + 1
            ids2 = np.full((len(live), width + room), -1, dtype=np.int64)
            sims2 = np.full((len(live), width + room), -np.inf, dtype=np.float32)
            wait2 = np.zeros((len(live), width + room), dtype=bool)
            ids2[:, :width], sims2[:, :width], wait2[:, :width] = best[live], score[live], waiting[live]
            ids2[r, width + place], sims2[r, width + place], wait2[r, width + place] = node, sim, True
            top = np.argpartition(-sims2, width - 1, axis=1)[:, :width]
            best[live], score[live], waiting[live] = ids2[rows, top], sims2[rows, top], wait2[rows, top]

    def search(self, asked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query (float32 unit vectors), `width` nodes with their cosines, in no order; -1 where there are fewer."""
        if len(self.sizes) == 1:
            return np.tile(np.arange(len(self.vectors)), (len(asked), 1)), asked @ self.vectors.T
        return self._beam(0, asked, *self._enter(0, asked), len(self.vectors), width)
