"""The end of iterative graph operators: once a count has shown that few edges are left, one task solves them at once.

A round of joins costs jobs whatever its size. LOCAL_EDGES bounds what a task gets; beyond it operators go on by rounds, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

LOCAL_EDGES = 1 << 15


def solve(edges: DataFrame, labels_of: Callable[[int, np.ndarray, np.ndarray], np.ndarray], node: str, label: str) -> DataFrame:
    """(node, label): labels_of(n, src, dst) gives each of n nodes, numbered in their order, the number of its label's node."""
    kind = dict(edges.dtypes)["src"]

    def run(batches):
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        src, dst = (table.column(c).combine_chunks() for c in ("src", "dst"))
        nodes = pc.unique(pa.concat_arrays([src, dst]))
        nodes = nodes.take(pc.sort_indices(nodes))
        at = lambda x: pc.index_in(x, nodes).to_numpy(zero_copy_only=False).astype(np.int64)
        found = labels_of(len(nodes), at(src), at(dst))
        for i in range(0, len(nodes), 50_000):
            yield pa.RecordBatch.from_arrays([nodes[i : i + 50_000], nodes.take(pa.array(found[i : i + 50_000]))], [node, label])

    return edges.select("src", "dst").coalesce(1).mapInArrow(run, f"{node} {kind}, {label} {kind}")


def connected(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The least node of each one's component: least labels go along the edges, and labels of labels are taken, until nothing changes."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[src], label[dst])
        new = label.copy()
        # Roots take the least label of their nodes' neighbours.
        for x in (label[src], label[dst], src, dst):
            np.minimum.at(new, x, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def strong(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The least node of each one's strong component (Tarjan 1972, without recursion)."""
    order = np.argsort(src, kind="stable")
    to, begin = dst[order].tolist(), np.searchsorted(src[order], np.arange(n + 1)).tolist()
    index, low, label, waiting, stack, count = [-1] * n, [0] * n, [-1] * n, [False] * n, [], 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, begin[root])]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        waiting[root] = True
        while work:
            v, at = work.pop()
            end = begin[v + 1]
            while at < end:
                w = to[at]
                at += 1
                if index[w] < 0:
                    work.append((v, at))
                    index[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    waiting[w] = True
                    work.append((w, begin[w]))
                    break
                if waiting[w]:
                    low[v] = min(low[v], index[w])
            else:
                if low[v] == index[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        waiting[w] = False
                        members.append(w)
                        if w == v:
                            break
                    least = min(members)
                    for w in members:
                        label[w] = least
                if work:
                    u = work[-1][0]
                    low[u] = min(low[u], low[v])
    return np.array(label, np.int64)


def dependencies(n: int, src: np.ndarray, dst: np.ndarray, sources: np.ndarray, cells: int = 1 << 18) -> np.ndarray:
    """What the sources add to each node's betweenness (Brandes 2001). Some sources at once, `cells` places (source, node) or one source: a step is a level of all of them, and takes time by its edges alone."""
    order = np.argsort(src, kind="stable")
    to, begin = dst[order], np.searchsorted(src[order], np.arange(n + 1))
    degree, width = np.diff(begin), max(1, cells // max(n, 1))
    total, place = np.zeros(n), np.empty(width * n, np.int64)
    for lo in range(0, len(sources), width):
        own = sources[lo : lo + width]
        start = np.arange(len(own)) * n + own
        seen, paths = np.zeros(len(own) * n, bool), np.zeros(len(own) * n)
        seen[start], paths[start] = True, 1.0
        fronts, ways = [start], []
        while True:
            front = fronts[-1]
            node = front % n
            d = degree[node]
            ends = np.cumsum(d)
            b = to[np.arange(ends[-1]) + np.repeat(begin[node] - ends + d, d)] + np.repeat(front - node, d)
            new = ~seen[b]
            a, b = np.repeat(front, d)[new], b[new]
            if not len(b):
                break
            np.add.at(paths, b, paths[a])
            # Each new place once: the last of those that wrote to it.
            place[b] = np.arange(len(b))
            fronts.append(b[place[b] == np.arange(len(b))])
            seen[fronts[-1]] = True
            ways.append((a, b))
        dep, share = np.zeros(len(own) * n), np.zeros(len(own) * n)
        for (a, b), front, ahead in zip(reversed(ways), reversed(fronts[:-1]), reversed(fronts)):
            share[ahead] = (1 + dep[ahead]) / paths[ahead]
            np.add.at(dep, a, share[b])
            dep[front] *= paths[front]
        dep[start] = 0.0
        total += dep.reshape(len(own), n).sum(axis=0)
    return total


def _places(cursor: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Of each key the next free place in its range, which begins at cursor[key]; cursor moves on."""
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    run = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    size, out = np.diff(np.r_[run, len(own)]), np.empty(len(own), np.int64)
    out[order] = cursor[own] + np.arange(len(own)) - np.repeat(run, size)
    cursor[own[run]] += size
    return out


class Adjacent:
    """Links of n nodes by either end: those from v are ahead[1][ahead[0][v] : ahead[0][v + 1]], those to it the same of back. With values, each link's are there in the order of ahead, and
    place tells where a link of back stands ahead. pieces: (src, dst, values), used up on the way, so that links are held once and a half."""

    def __init__(self, n: int, pieces: list, values: int = 0):
        self.n, links = n, sum(len(x[0]) for x in pieces)
        begins = [np.zeros(n + 1, np.int64) for _ in range(2)]
        for piece in pieces:
            for begin, keys in zip(begins, piece):
                np.add.at(begin, keys + 1, 1)
        begins = [np.cumsum(x) for x in begins]
        cursors = [x.copy() for x in begins]
        ends = [np.empty(links, np.int32) for _ in range(2)]
        self.values = [np.empty(links, np.int64) for _ in range(values)]
        self.place = np.empty(links, np.int32) if values else None
        while pieces:
            src, dst, *own = pieces.pop()
            if len(src):
                there, here = _places(cursors[0], src), _places(cursors[1], dst)
                ends[0][there], ends[1][here] = dst, src
                for whole, x in zip(self.values, own):
                    whole[there] = x
                if values:
                    self.place[here] = there
        self.ahead, self.back = ((x, y) for x, y in zip(begins, ends))


def _grown(side: tuple, nodes: list, places: list, hops: int, fit, cells: int):
    """Paths that go on over so many links, in parts of about `cells` rows: (nodes, places, row, at, node), the last hop being kept apart as (row of nodes, place of the link, node)."""
    begin, ends = side
    last = nodes[-1]
    degree = begin[last + 1] - begin[last]
    upto, lo = np.cumsum(degree), 0
    while lo < len(last):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + cells, "right")))
        own, links, d = [x[lo:hi] for x in nodes], [x[lo:hi] for x in places], degree[lo:hi]
        row = np.repeat(np.arange(hi - lo), d)
        at = np.arange(len(row)) + np.repeat(begin[own[-1]] - np.cumsum(d) + d, d)
        node = ends[at]
        keep = fit(own, row, node)
        if hops > 1:
            for x in own[1:-1]:
                keep &= node != x[row]
        row, at, node = row[keep], at[keep], node[keep]
        if hops == 1:
            yield own, links, row, at, node
        else:
            yield from _grown(side, [x[row] for x in own] + [node], [x[row] for x in links] + [at], hops - 1, fit, cells)
        lo = hi


def _marked(own: np.ndarray, others: np.ndarray, bits: int = 22) -> np.ndarray:
    """Whether a key is, by its hash, among the others; none that is there is missed."""
    spread = lambda x: (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    mark = np.zeros(1 << bits, bool)
    mark[spread(others)] = True
    return mark[spread(own)]


def closed(g: Adjacent, k: int, firsts: np.ndarray, monotone: bool = False, cells: int = 1 << 19):
    """(nodes, places): the simple cycles of k nodes whose least is one of firsts, in parts: k columns of nodes from the least on, and k of their links' places ahead (none if g holds no values).
    monotone: only those that ascend up to the closing link.

    Paths of k // 2 hops from a first node meet those of the other hops that lead back to it, over nodes above it alone. First nodes are taken so many at a time that their ways back are about
    `cells` rows; where one node has more, its ways on are made again for each part of them. So memory is bounded, and rows of halves are never kept."""
    h, n, at, width = k // 2, g.n, 0, 16
    if monotone:
        on, home = (lambda own, row, node: node > own[-1][row]), (lambda own, row, node: (node > own[0][row]) & (node < own[-1][row]) if len(own) > 1 else node > own[0][row])
    else:
        on = home = lambda own, row, node: node > own[0][row]
    while at < len(firsts):
        some = firsts[at : at + width]
        at += len(some)
        most = 0
        for nodes2, links2, row2, at2, node2 in _grown(g.back, [some], [], k - h, home, cells):
            most += len(row2)
            key2 = nodes2[0][row2] * n + node2
            for nodes, links, row, there, node in _grown(g.ahead, [nodes2[0][np.r_[True, nodes2[0][1:] != nodes2[0][:-1]]]] if len(nodes2[0]) else [some[:0]], [], h, on, cells):
                key = nodes[0][row] * n + node
                x = np.flatnonzero(_marked(key, key2))
                y = np.flatnonzero(_marked(key2, key[x]))
                y = y[np.argsort(key2[y], kind="stable")]
                low, high = (np.searchsorted(key2[y], key[x], side) for side in ("left", "right"))
                times = high - low
                x, y = np.repeat(x, times), y[np.arange(times.sum()) + np.repeat(low - np.cumsum(times) + times, times)]
                r, r2 = row[x], row2[y]
                cycle = [c[r] for c in nodes] + [node[x]] + [c[r2] for c in reversed(nodes2[1:])]
                good = np.ones(len(x), bool)
                for i in range(1, k):
                    for j in range(i + 1, k):
                        good &= cycle[i] != cycle[j]
                if good.any():
                    places = []
                    if g.place is not None:
                        places = [c[r][good] for c in links] + [there[x][good]] + [g.place[c[good]] for c in (at2[y], *[c[r2] for c in reversed(links2)])]
                    yield [c[good] for c in cycle], places
        width = int(max(1, min(2 * width, width * 0.6 * cells // max(1, most), 1 << 16)))
