"""A hierarchical navigable small-world graph over the unit vectors of one shard, in numpy.

Nodes are numbered by their level, the highest first, so a layer holds the nodes below a count. Layers
are built from the top; nodes enter a layer in batches that search what is there already and compare
each other outright. Searches run in step for many queries at a time.
"""

from __future__ import annotations

import numpy as np

DEGREE = 16  # links of a node above the ground layer; twice as many there
BUILD_BEAM = 16
BATCH = 512
EXPAND = 4  # beam members opened at a time


def draw_levels(n: int, seed: int = 7) -> np.ndarray:
    """Levels of n nodes, falling: each holds about one in DEGREE of the nodes below it."""
    levels = np.floor(-np.log1p(-np.random.default_rng(seed).random(n)) / np.log(DEGREE)).astype(np.int64)
    return -np.sort(-levels)


class Graph:
    """links[k][i] are the neighbours of node i on layer k, -1 where there is none; layer 0 is the ground."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray]):
        self.vectors, self.links = vectors, links

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        levels = draw_levels(len(vectors))
        counts = [int((levels >= k).sum()) for k in range(int(levels.max(initial=0)) + 1)]
        graph = cls(vectors, [np.empty((0, 0), np.int32)] * len(counts))
        for k in range(len(counts) - 1, -1, -1):
            graph._build_layer(k, counts[k])
        return graph

    def _build_layer(self, k: int, count: int) -> None:
        most = DEGREE * (2 if k == 0 else 1)
        self.links[k] = np.full((count, most), -1, np.int32)
        start = 0
        while start < count:
            # a batch is no larger than what it is compared with, but for the first
            new = np.arange(start, min(start + (BATCH if start >= BATCH or start == 0 else start), count))
            own = self.vectors[new]
            near, sims = self._best_of(own @ own.T, new, min(BUILD_BEAM, len(new) - 1), diagonal=True)
            if start:
                entries = self.descend(own, k)
                found, values, _ = self.beam(own, k, entries, BUILD_BEAM)
                near, sims = np.concatenate([near, found], 1), np.concatenate([sims, values], 1)
            self.links[k][new] = self._choose(near, sims, most)
            self._link_back(k, new, most)
            start = int(new[-1]) + 1

    @staticmethod
    def _best_of(sims: np.ndarray, ids: np.ndarray, size: int, diagonal: bool = False) -> tuple[np.ndarray, np.ndarray]:
        if diagonal:
            np.fill_diagonal(sims, -np.inf)
        at = np.argsort(-sims, axis=1, kind="stable")[:, :size]
        return ids[at].astype(np.int32), np.take_along_axis(sims, at, 1)

    def _choose(self, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Up to `most` of each row's candidates, nearest first, those first that are nearer to the row than to one chosen before."""
        order = np.argsort(-sims, axis=1, kind="stable")
        near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
        near = np.where(np.isfinite(sims), near, -1)
        n, width = near.shape
        if not width:
            return np.full((n, most), -1, np.int32)
        sorted_ids = np.argsort(near, axis=1, kind="stable")
        ranked = np.take_along_axis(near, sorted_ids, 1)
        again = np.zeros((n, width), bool)  # a candidate that came in twice
        np.put_along_axis(again, sorted_ids[:, 1:], ranked[:, 1:] == ranked[:, :-1], 1)
        valid = (near >= 0) & ~again
        inside = np.empty((n, width, width), np.float32)
        for at in range(0, n, 128):
            part = self.vectors[near[at : at + 128]]
            inside[at : at + 128] = part @ part.transpose(0, 2, 1)
        chosen = np.zeros((n, width), bool)
        closest = np.full((n, width), -np.inf, np.float32)  # of each candidate to those chosen so far
        for c in range(width):
            take = valid[:, c] & (sims[:, c] >= closest[:, c]) & (chosen.sum(1) < most)
            chosen[:, c] = take
            closest[take] = np.maximum(closest[take], inside[take, c])
        rank = np.where(chosen, 0, np.where(valid, 1, 2)) * width + np.arange(width)
        kept = np.argsort(rank, axis=1)[:, :most]
        out = np.where(np.take_along_axis(valid, kept, 1), np.take_along_axis(near, kept, 1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1).astype(np.int32)

    def _link_back(self, k: int, new: np.ndarray, most: int) -> None:
        links = self.links[k]
        source, target = np.repeat(new, most), links[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        for at in range(0, len(nodes), BATCH):
            some, begin, n = nodes[at : at + BATCH], first[at : at + BATCH], counts[at : at + BATCH]
            width = int(n.max())
            spot = begin[:, None] + np.minimum(np.arange(width), n[:, None] - 1)
            back = np.where(np.arange(width) < n[:, None], source[spot], -1)
            if width > 4 * most:  # a hub: only its nearest can be chosen
                sims = np.where(back >= 0, np.einsum("nwd,nd->nw", self.vectors[back], self.vectors[some]), -np.inf)
                back = np.take_along_axis(back, np.argsort(-sims, axis=1, kind="stable")[:, : 4 * most], 1)
            near = np.concatenate([links[some], back], 1)
            sims = np.where(near >= 0, np.einsum("nwd,nd->nw", self.vectors[near], self.vectors[some]), -np.inf)
            links[some] = self._choose(near, sims, most)

    def descend(self, queries: np.ndarray, down_to: int) -> np.ndarray:
        """An entry point on layer `down_to` for each query, by greedy steps on the layers above."""
        at = np.zeros(len(queries), np.int64)
        for k in range(len(self.links) - 1, down_to, -1):
            at = self.beam(queries, k, at, 1)[0][:, 0].astype(np.int64)
        return at

    def beam(self, queries: np.ndarray, k: int, entries: np.ndarray, width: int,
             least: float = np.inf) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """The `width` nearest nodes found for each query with their similarities, and all (query, node) of `least` or more.

        Opens the best members of each beam until all have been opened. Those met with `least` or more that
        did not stay in the beam are opened too, so a group larger than the beam is walked to its end.
        """
        links, n = self.links[k], len(self.links[k])
        q = len(queries)
        seen = np.zeros((q, n), bool)
        rows = np.arange(q)
        ids = np.full((q, width), -1, np.int64)
        sims = np.full((q, width), -np.inf, np.float32)
        ids[:, 0], sims[:, 0] = entries, np.einsum("qd,qd->q", queries, self.vectors[entries])
        opened = np.ones((q, width), bool)
        opened[:, 0] = False
        seen[rows, entries] = True
        hits = [(rows[sims[:, 0] >= least], ids[sims[:, 0] >= least, 0])]
        active = rows
        while len(active):
            score = np.where(opened[active], -np.inf, sims[active])
            best = np.argsort(-score, axis=1, kind="stable")[:, : min(EXPAND, width)]
            live = np.take_along_axis(score, best, 1) > -np.inf
            some = live[:, 0]
            active, best, live = active[some], best[some], live[some]
            if not len(active):
                break
            nodes = np.take_along_axis(ids[active], best, 1)
            opened[active[:, None], best] |= live
            near = np.where(live[:, :, None], links[np.where(live, nodes, 0)], -1).reshape(len(active), -1).astype(np.int64)
            fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
            near, row = near[fresh], np.broadcast_to(active[:, None], fresh.shape)[fresh]
            code = np.unique(row * n + near)  # neighbours of several opened nodes
            row, near = code // n, code % n
            seen[row, near] = True
            value = np.einsum("qd,qd->q", queries[row], self.vectors[near])
            strong = value >= least
            hits.append((row[strong], near[strong]))
            place = np.zeros(q, np.int64)
            counts = np.bincount(row, minlength=q)[active]
            place[active] = np.arange(len(active))
            wide = int(counts.max(initial=0))
            column = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            more, more_ids = np.full((len(active), wide), -np.inf, np.float32), np.full((len(active), wide), -1, np.int64)
            more[place[row], column], more_ids[place[row], column] = value, near
            all_sims, all_ids = np.concatenate([sims[active], more], 1), np.concatenate([ids[active], more_ids], 1)
            all_open = np.concatenate([opened[active], more_ids < 0], 1)
            kept = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            sims[active], ids[active], opened[active] = (np.take_along_axis(v, kept, 1) for v in (all_sims, all_ids, all_open))
        row, node = (np.concatenate(h) for h in zip(*hits))
        if np.isfinite(least):
            row, node = self._flood(queries, k, row, node, ids, sims, seen, least)
        return ids, sims, (row, node)

    def _flood(self, queries, k, row, node, ids, sims, seen, least):
        """Opens the hits that fell out of a full beam, and what they lead to."""
        links, n = self.links[k], len(self.links[k])
        full = sims[:, -1] >= least
        in_beam = np.sort((np.arange(len(queries))[:, None] * n + ids)[ids >= 0])
        code = (row * n + node)[full[row]]
        todo = np.setdiff1d(code, in_beam)
        rows, nodes = [row], [node]
        while len(todo):
            found = []
            for at in range(0, len(todo), 1 << 15):
                part = todo[at : at + (1 << 15)]
                near = links[part % n].astype(np.int64)
                owner = np.broadcast_to((part // n)[:, None], near.shape)
                ok = (near >= 0) & ~seen[owner, np.maximum(near, 0)]
                code = np.unique(owner[ok] * n + near[ok])
                if not len(code):
                    continue
                r, v = code // n, code % n
                seen[r, v] = True
                strong = np.einsum("qd,qd->q", queries[r], self.vectors[v]) >= least
                rows.append(r[strong])
                nodes.append(v[strong])
                found.append(code[strong])
            todo = np.concatenate(found) if found else todo[:0]
        return np.concatenate(rows), np.concatenate(nodes)

    def search(self, queries: np.ndarray, width: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all nodes found with a similarity of `least` or more."""
        return self.beam(queries, 0, self.descend(queries, 0), width, least)[2]
