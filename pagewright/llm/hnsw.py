"""A hierarchical navigable small-world graph over unit vectors in numpy; insertion and search work on batches."""

from __future__ import annotations

import io

import numpy as np

M = 16
BEAM = 48
BATCH = 512
EARLY = 8


class Graph:
    """``links[level][node]`` holds up to 2 M (level 0) or M neighbours, -1 where there are fewer. Nodes are the rows of ``x``."""

    def __init__(self, x: np.ndarray, links: list[np.ndarray], levels: np.ndarray, entry: int):
        self.x, self.links, self.levels, self.entry = x, links, levels, entry

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, levels=self.levels, entry=self.entry, **{f"l{i}": a for i, a in enumerate(self.links)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, x: np.ndarray, raw: bytes) -> Graph:
        z = np.load(io.BytesIO(raw))
        return cls(x, [z[f"l{i}"] for i in range(len(z.files) - 2)], z["levels"], int(z["entry"]))

    # --- search ----------------------------------------------------------------------------------------------

    def _beam(self, level: int, q: np.ndarray, enter: np.ndarray, beam: int, wide: int = 4, least: float = -2.0) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of the best ``beam`` nodes met on a level, best first, -1 where there are fewer.

        After ``EARLY`` steps a search goes on only from nodes with a cosine of at least ``least``.
        """
        links, n = self.links[level], len(q)
        seen = np.zeros((n, len(self.x)), bool)
        nodes, cos = np.full((n, beam), -1), np.full((n, beam), -np.inf, np.float32)
        k = min(enter.shape[1], beam)
        nodes[:, :k] = enter[:, :k]
        cos[:, :k] = np.where(nodes[:, :k] >= 0, np.einsum("qkd,qd->qk", self.x[nodes[:, :k]], q), -np.inf)
        seen[np.arange(n)[:, None], np.maximum(nodes[:, :k], 0)] = True
        done = nodes < 0
        active, steps = np.arange(n), 0
        while len(active):
            open_cos = np.where(done[active] | (cos[active] < (least if steps >= EARLY else -2)), -np.inf, cos[active])
            steps += 1
            pick = np.argpartition(-open_cos, min(wide, beam) - 1, axis=1)[:, :wide]
            live = np.take_along_axis(open_cos, pick, 1) > -np.inf
            going = live.any(axis=1)
            active, pick, live = active[going], pick[going], live[going]
            if not len(active):
                break
            rows = active[:, None]
            done[rows, pick] = True
            near = np.where(live[:, :, None], links[np.where(live, nodes[rows, pick], 0)], -1).reshape(len(active), -1)
            new = (near >= 0) & ~seen[rows, near]
            near = np.where(new, near, -1)
            seen[np.repeat(active, new.sum(axis=1)), near[new]] = True
            near = np.sort(near, axis=1)[:, ::-1]
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near = near[:, : int((near >= 0).sum(axis=1).max(initial=0)) * 2 or 1]
            c = np.where(near >= 0, np.einsum("qkd,qd->qk", self.x[near], q[active]), -np.inf)
            all_nodes, all_cos = np.concatenate([nodes[active], near], axis=1), np.concatenate([cos[active], c], axis=1)
            all_done = np.concatenate([done[active], near < 0], axis=1)
            best = np.argpartition(-all_cos, beam - 1, axis=1)[:, :beam]
            nodes[active], cos[active], done[active] = (np.take_along_axis(a, best, 1) for a in (all_nodes, all_cos, all_done))
        order = np.argsort(-cos, axis=1)
        return np.take_along_axis(np.where(np.isfinite(cos), nodes, -1), order, 1), np.take_along_axis(cos, order, 1)

    def _descend(self, q: np.ndarray, to: int) -> np.ndarray:
        """The nearest nodes met on the levels above ``to``, one for each query."""
        at = np.full((len(q), 1), self.entry)
        for level in range(len(self.links) - 1, to, -1):
            at = self._beam(level, q, at, 4, 1)[0][:, :1]
        return at

    def search(self, q: np.ndarray, beam: int, least: float = -2.0) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, cosines) of the ``beam`` nearest nodes met for each query, best first."""
        step = max(1, min(512, 64_000_000 // max(1, len(self.x))))
        parts = [self._beam(0, q[i : i + step], self._descend(q[i : i + step], 0), beam, least=least) for i in range(0, len(q), step)]
        return np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])


def _spread(x: np.ndarray, q: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
    """For each query up to ``most`` of its nodes (-1: none): near ones first that are nearer to it than to those kept."""
    c = np.where(nodes >= 0, np.einsum("qkd,qd->qk", x[nodes], q), -np.inf)
    order = np.argsort(-c, axis=1)
    nodes, c = np.take_along_axis(nodes, order, 1), np.take_along_axis(c, order, 1)
    nodes[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = -1
    v = x[nodes]
    mutual = v @ v.transpose(0, 2, 1)
    keep, closest, n = np.zeros(nodes.shape, bool), np.full(nodes.shape, -np.inf, np.float32), np.zeros(len(nodes), np.int64)
    for k in range(nodes.shape[1]):
        take = (nodes[:, k] >= 0) & (n < most) & (closest[:, k] < c[:, k])
        keep[:, k], n = take, n + take
        closest = np.where(take[:, None], np.maximum(closest, mutual[:, k]), closest)
    rest = (nodes >= 0) & ~keep  # fill up with the nearest of the others
    room = np.cumsum(rest, axis=1) <= (most - n)[:, None]
    keep |= rest & room
    order = np.argsort(~keep, axis=1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(keep, order, 1), np.take_along_axis(nodes, order, 1), -1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def build(x: np.ndarray, seed: int = 1) -> Graph:
    """The graph of the unit vectors ``x`` (float32), alike for equal input."""
    n = len(x)
    rng = np.random.default_rng(seed)
    levels = np.minimum((-np.log(rng.random(n)) / np.log(M)).astype(np.int64), 6)
    order = np.lexsort((np.arange(n), -levels))
    x, levels_of = np.ascontiguousarray(x, np.float32), levels
    graph = Graph(x, [np.full((n, 2 * M if level == 0 else M), -1) for level in range(int(levels.max(initial=0)) + 1)], levels_of, int(order[0]) if n else -1)
    size = 1
    while size < n:
        batch = order[size : size + min(size, BATCH)]
        q = x[batch]
        at = np.full((len(batch), 1), graph.entry)
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        for level in range(len(graph.links) - 1, -1, -1):
            here = np.flatnonzero(levels[batch] >= level)
            if level > levels[batch].max():
                at = graph._beam(level, q, at, 4, 1)[0][:, :1]
                continue
            found = graph._beam(level, q, at, BEAM)[0]
            at = found[:, :4]
            k = min(BEAM, len(here) - 1)
            peers = batch[here[np.argpartition(-own[np.ix_(here, here)], k - 1, axis=1)[:, :k]]] if k > 0 else np.zeros((len(here), 0), np.int64)
            links, most = graph.links[level], graph.links[level].shape[1]
            chosen = _spread(x, q[here], np.concatenate([found[here], peers], axis=1), M)
            links[batch[here], :M] = chosen
            to, by = chosen.ravel(), np.repeat(batch[here], M)
            by, to = by[to >= 0], to[to >= 0]
            _link_back(x, links, most, to, by)
        size += len(batch)
    return graph


def _link_back(x: np.ndarray, links: np.ndarray, most: int, to: np.ndarray, by: np.ndarray) -> None:
    """Add ``by[i]`` to the links of ``to[i]``; where they are too many, those that spread best of the nearest stay."""
    order = np.lexsort((by, -np.einsum("ij,ij->i", x[to], x[by]), to))
    to, by = to[order], by[order]
    _, first, n = np.unique(to, return_index=True, return_counts=True)
    nearest = np.arange(len(to)) - np.repeat(first, n) < most
    to, by = to[nearest], by[nearest]
    node, first, n = np.unique(to, return_index=True, return_counts=True)
    have = (links[node] >= 0).sum(axis=1)
    for i in range(0, len(node), 1024):
        a = slice(i, i + 1024)
        new = np.full((len(node[a]), int(n[a].max())), -1)
        at = np.arange(first[a][0], first[a][-1] + n[a][-1])
        new[np.repeat(np.arange(len(new)), n[a]), np.arange(len(at)) - np.repeat(first[a] - at[0], n[a])] = by[at]
        both = np.concatenate([links[node[a]], new], axis=1)
        over = have[a] + n[a] > most
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :most]
        if over.any():
            packed[over] = _spread(x, x[node[a][over]], both[over], most)
        links[node[a], : packed.shape[1]] = packed


def probes(x: np.ndarray, floor: float, many: int, seed: int = 2) -> np.ndarray:
    """Queries that have a link in ``x`` for certain: ``many`` of its rows, then the same moved until they are just above the floor."""
    own = x[np.unique(np.linspace(0, len(x) - 1, min(many, len(x))).astype(np.int64))]
    away = np.random.default_rng(seed).normal(size=own.shape)
    away -= (away * own).sum(axis=1, keepdims=True) * own
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-9)
    c = floor + 0.1 * (1 - floor)
    return np.concatenate([own, c * own + np.sqrt(max(0.0, 1 - c * c)) * away]).astype(np.float32)


def near(graph: Graph, q: np.ndarray, floor: float, beam: int = 64, audit: int = 64, recall: float = 0.98) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of all pairs found with a cosine of at least ``floor``.

    A query whose beam holds nothing below the floor is searched again with twice the beam, or over all nodes when that is
    cheaper. Then a sample of queries, and :func:`probes`, are compared with all nodes; where the sample, the nodes or the moved
    nodes are below ``recall``, everything is searched with a wider beam. So the audit has links to find where no query has any.
    """
    n = len(graph.x)
    if not n or not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sample = np.unique(np.linspace(0, len(q) - 1, min(audit, len(q))).astype(np.int64))
    asked, extra = len(q), probes(graph.x, floor, audit)
    q = np.concatenate([q, extra])
    nodes_of, moved = np.split(asked + np.arange(len(extra)), 2)

    def truth(group: np.ndarray) -> np.ndarray:
        i, t = np.nonzero(q[group] @ graph.x.T >= floor)
        return group[i] * n + t

    audits = [truth(group) for group in (sample, nodes_of, moved)]
    least = floor - 0.4
    while True:
        queries, nodes = [], []
        rest, width = np.arange(len(q)), beam
        while len(rest):
            if 4 * width >= n or width > beam and 128 * width >= n:  # all nodes
                for i in range(0, len(rest), max(1, 16_000_000 // n)):
                    some = rest[i : i + max(1, 16_000_000 // n)]
                    a, b = np.nonzero(q[some] @ graph.x.T >= floor)
                    queries.append(some[a])
                    nodes.append(b)
                break
            found, cos = graph.search(q[rest], width, least)
            full = (found[:, -1] >= 0) & (cos[:, -1] >= floor)
            a, b = np.nonzero((cos >= floor) & ~full[:, None])
            queries.append(rest[a])
            nodes.append(found[a, b])
            rest, width = rest[full], 2 * width
        query, node = np.concatenate(queries), np.concatenate(nodes)
        keys = np.sort(query * n + node)
        if 4 * beam >= n or all(np.isin(want, keys, assume_unique=True).sum() >= recall * len(want) for want in audits):
            real = query < asked
            return query[real], node[real]
        beam, least = 2 * beam, -2.0
