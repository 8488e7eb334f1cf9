"""A hierarchical navigable small-world graph in flat arrays, built and searched in blocks.

levels[l] is an int32 matrix: a row for each node that reaches level l, its columns
the numbers of its neighbours, -1 where there is none. Nodes are numbered by falling
height, so those that reach a level come first, and are inserted in this order. A
node is inserted by searching the graph so far: down the levels that it doesn't reach
by the nearest neighbour alone, and in its own levels with a beam whose result are
the candidates for its links.

Many searches go in step: each step takes the nearest nodes that a search hasn't
looked at, and the distances of all their neighbours at once. Nodes are inserted in
blocks that grow with the graph; those of a block search the graph without the block,
and meet one another directly. Searching costs as many distances as the walk visits,
so inserting n nodes costs about n log n, and no matrix of all pairs exists.

Equal inputs give equal graphs. Distances are squared and of single precision; who
needs them exact takes them again from the vectors.
"""

from __future__ import annotations

import numpy as np

LINKS = 16  #: neighbours of a node on upper levels; twice as many on the lowest
CANDIDATES = 96  #: nodes that a search for a new node's links keeps
BEAM = 256  #: nodes that a search for a query keeps
STEP = 4  #: nodes that a search looks at in one step
BLOCK = 512  #: searches that go in step


def nearest_of(near: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The `keep` smallest of each row, unordered."""
    if near.shape[1] <= keep:
        return near, ids
    at = np.argpartition(near, keep - 1, axis=1)[:, :keep]
    return np.take_along_axis(near, at, 1), np.take_along_axis(ids, at, 1)


def in_order(near: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by distance, ties by number; empty places (-1) last."""
    order = np.lexsort((ids, near), axis=1)
    return np.take_along_axis(near, order, 1), np.take_along_axis(ids, order, 1)


class Graph:
    def __init__(self, vectors: np.ndarray, levels: list[np.ndarray], links: int = LINKS):
        self.vectors, self.levels, self.links = vectors, levels, links
        self.norms = np.einsum("ij,ij->i", vectors, vectors)

    # Distances.

    def far(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of rows of queries to as many nodes."""
        gap = self.vectors[ids]
        gap -= queries
        return np.einsum("ij,ij->i", gap, gap)

    def apart(self, ids: np.ndarray) -> np.ndarray:
        """For rows of nodes, the squared distances among each row's nodes; infinite where there is none."""
        own = self.vectors[ids]
        gaps = np.matmul(own, own.transpose(0, 2, 1))
        norms = self.norms[ids]
        gaps *= -2
        gaps += norms[:, :, None]
        gaps += norms[:, None, :]
        return gaps

    # Search.

    def walk(self, queries: np.ndarray, level: int, starts: np.ndarray, beam: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, nodes), -1 where there is none, of each query's beam on a level, unordered. starts: nodes to begin with, per query."""
        flat, n = self.levels[level], len(queries)
        seen = np.full((n, upto), -1, np.int32)
        rows = np.arange(n)
        ids = np.full((n, beam), -1, np.int64)
        near = np.full((n, beam), np.inf, np.float32)
        open_ = np.zeros((n, beam), bool)
        ids[:, 0], near[:, 0], open_[:, 0] = starts, self.far(queries, starts), True
        seen[rows, starts] = 0
        live = rows
        stamp = 0
        while len(live):
            # The nearest nodes that these searches haven't looked at.
            waiting = np.where(open_[live], near[live], np.inf)
            step = min(STEP, beam)
            at = np.argpartition(waiting, step - 1, axis=1)[:, :step] if step < beam else np.tile(np.arange(beam), (len(live), 1))
            ready = np.isfinite(np.take_along_axis(waiting, at, 1))
            live = live[ready.any(1)]
            if not len(live):
                break
            at, ready = at[ready.any(1)], ready[ready.any(1)]
            open_[live[:, None], at] &= ~ready
            found = flat[np.where(ready, ids[live[:, None], at], 0)]
            found[~ready] = -1
            found = found.reshape(len(live), -1)
            # Each neighbour once for each search.
            r, c = np.nonzero(found >= 0)
            node, who = found[r, c], live[r]
            fresh = seen[who, node] < 0
            r, c, node, who = r[fresh], c[fresh], node[fresh], who[fresh]
            marks = np.arange(stamp, stamp + len(node), dtype=np.int32)
            stamp = 0 if stamp > 1 << 30 else stamp + len(node)
            seen[who, node] = marks
            first = seen[who, node] == marks
            r, c, node, who = r[first], c[first], node[first], who[first]
            d = self.far(queries[who], node)
            # Those that a full beam has no place for are left at once.
            worst = near[live].max(1)
            good = d < worst[r]
            r, c, node, d = r[good], c[good], node[good], d[good]
            if not len(r):
                continue
            place = np.arange(len(r)) - np.searchsorted(r, r)
            width = int(place.max()) + 1
            new_near = np.full((len(live), width), np.inf, np.float32)
            new_ids = np.full((len(live), width), -1, np.int64)
            new_near[r, place], new_ids[r, place] = d, node
            all_near = np.concatenate([near[live], new_near], 1)
            keep = np.argpartition(all_near, beam - 1, axis=1)[:, :beam]
            near[live] = np.take_along_axis(all_near, keep, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], new_ids], 1), keep, 1)
            open_[live] = np.take_along_axis(np.concatenate([open_[live], new_ids >= 0], 1), keep, 1)
        return near, ids

    def descend(self, queries: np.ndarray, to: int, node: np.ndarray, height: int) -> np.ndarray:
        """Each query's nearest node on the levels above `to`, one level after another."""
        for level in range(height, to, -1):
            flat = self.levels[level]
            best, going = self.far(queries, node), np.arange(len(queries))
            while len(going):
                found = flat[node[going]]
                r, c = np.nonzero(found >= 0)
                near = np.full(found.shape, np.inf, np.float32)
                near[r, c] = self.far(queries[going[r]], found[r, c])
                at = near.argmin(1)
                own = near[np.arange(len(going)), at]
                better = own < best[going]
                node[going[better]] = found[np.flatnonzero(better), at[better]]
                best[going[better]] = own[better]
                going = going[better]
        return node

    def search(self, queries: np.ndarray, beam: int = BEAM, block: int = BLOCK) -> np.ndarray:
        """For each query the numbers of the nodes in its beam, -1 where there is none."""
        queries, n = np.ascontiguousarray(queries, np.float32), len(self.vectors)
        block = max(1, min(block, (256 << 20) // (4 * n)))
        out = []
        for a in range(0, len(queries), block):
            own = queries[a : a + block]
            start = self.descend(own, 0, np.zeros(len(own), np.int64), len(self.levels) - 1)
            out.append(self.walk(own, 0, start, min(beam, n), n)[1])
        return np.concatenate(out) if out else np.zeros((0, 1), np.int64)

    # Building.

    @classmethod
    def build(
        cls,
        vectors: np.ndarray,
        links: int = LINKS,
        candidates: int = CANDIDATES,
        seed: int = 7,
    ) -> tuple[Graph, np.ndarray]:
        """The graph of the vectors, and the order in which it numbers them."""
        n = len(vectors)
        height = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(int), 12)
        order = np.argsort(-height, kind="stable")
        height = height[order]
        sizes = [int((height >= level).sum()) for level in range(int(height[0]) + 1)] if n else []
        levels = [np.full((m, links if level else 2 * links), -1, np.int32) for level, m in enumerate(sizes)]
        out = cls(np.ascontiguousarray(vectors[order], np.float32), levels, links)
        a = 0
        while a < n:
            b = min(n, a + max(64, min(BLOCK, a // 4)))
            for top in np.unique(height[a:b])[::-1].tolist():
                x, y = a + int(np.searchsorted(-height[a:b], -top, "left")), a + int(np.searchsorted(-height[a:b], -top, "right"))
                out._insert(x, y, top, int(height[0]), candidates)
            a = b
        return out, order

    def _insert(self, a: int, b: int, top: int, height: int, candidates: int) -> None:
        """Nodes a to b, all of which reach level `top`."""
        own, new = self.vectors[a:b], np.arange(a, b)
        node = self.descend(own, top, np.zeros(b - a, np.int64), height) if a else None
        # Those of the block before each node; of one another they need no search.
        gaps = self.apart(new[None])[0]
        gaps[np.triu_indices(b - a)] = np.inf
        mates = np.broadcast_to(new, gaps.shape)
        for level in range(top, -1, -1):
            most = self.levels[level].shape[1]
            near, ids = nearest_of(gaps, mates, candidates)
            if a:
                d, found = self.walk(own, level, node, min(candidates, a), a)
                node = found[np.arange(b - a), d.argmin(1)]
                near, ids = np.concatenate([near, d], 1), np.concatenate([ids, found], 1)
                near, ids = nearest_of(near, ids, candidates)
            ids = np.where(np.isfinite(near), ids, -1)
            chosen = self.diverse(*in_order(near, ids), most)
            self.levels[level][a:b, : chosen.shape[1]] = chosen
            self._link_back(level, new, chosen)

    def diverse(self, near: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, nearest first, up to `most`: those nearer to the node than to any chosen before,
        and then the nearest others."""
        n, width = ids.shape
        if width <= 1:
            return ids[:, :most]
        gaps = self.apart(np.maximum(ids, 0))
        bar = np.full((n, width), np.inf, np.float32)  # each candidate's distance to the chosen
        chosen, count = np.zeros((n, width), bool), np.zeros(n, int)
        for j in range(width):
            take = (ids[:, j] >= 0) & (near[:, j] < bar[:, j]) & (count < most)
            if take.any():
                chosen[:, j] = take
                count += take
                np.minimum(bar, gaps[:, j], out=bar, where=take[:, None])
        rank = np.where(ids < 0, 2 * width, np.where(chosen, 0, width)) + np.arange(width)
        at = np.argsort(rank, axis=1)[:, :most]
        return np.take_along_axis(ids, at, 1)

    def _link_back(self, level: int, new: np.ndarray, chosen: np.ndarray) -> None:
        """The chosen neighbours get links to the new nodes; who has too many keeps diverse ones."""
        flat = self.levels[level]
        most = flat.shape[1]
        r, c = np.nonzero(chosen >= 0)
        target, source = chosen[r, c], new[r]
        order = np.lexsort((source, target))
        target, source = target[order], source[order]
        who, first, n = np.unique(target, return_index=True, return_counts=True)
        held = (flat[who] >= 0).sum(1)
        place = np.arange(len(target)) - np.repeat(first, n)
        fits = held + n <= most
        simple = np.repeat(fits, n)
        flat[target[simple], (np.repeat(held, n) + place)[simple]] = source[simple]
        # The others in groups of like numbers of new links, so that rows are filled.
        for k in np.unique(np.ceil(np.log2(n[~fits])).astype(int)).tolist() if (~fits).any() else []:
            mine = np.flatnonzero(~fits & (np.ceil(np.log2(n)).astype(int) == k))
            for part in np.array_split(mine, max(1, len(mine) * (most + (1 << k)) ** 2 // 20_000_000)):
                ids = np.full((len(part), most + (1 << k)), -1, np.int64)
                ids[:, :most] = flat[who[part]]
                row = np.repeat(np.arange(len(part)), n[part])
                at = np.concatenate([np.arange(f, f + m) for f, m in zip(first[part], n[part])])
                ids[row, most + place[at]] = source[at]
                near = np.full(ids.shape, np.inf, np.float32)
                x, y = np.nonzero(ids >= 0)
                near[x, y] = self.far(self.vectors[who[part][x]], ids[x, y])
                kept = self.diverse(*in_order(near, ids), most)
                flat[who[part]] = kept

    # Storing.

    def pack(self) -> dict:
        return {"sizes": [len(x) for x in self.levels], "neighbours": b"".join(x.tobytes() for x in self.levels)}

    @classmethod
    def unpack(cls, vectors: np.ndarray, sizes: list[int], neighbours: bytes, links: int) -> Graph:
        flat, at, levels = np.frombuffer(neighbours, np.int32), 0, []
        for level, m in enumerate(sizes):
            most = links if level else 2 * links
            levels.append(flat[at : at + m * most].reshape(m, most))
            at += m * most
        return cls(np.ascontiguousarray(vectors, np.float32), levels, links)
