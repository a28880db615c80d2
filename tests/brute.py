"""Plain searches in small graphs, against which the tables are held."""

from __future__ import annotations

import heapq


def cheapest(arcs, source):
    """node -> (cost, hops), and node -> the smallest node before it on a cheapest path; arcs (src, dst, cost)."""
    best = {source: (0, 0)}
    for _ in range(len({a for arc in arcs for a in arc[:2]}) + 1):
        for a, b, c in arcs:
            if a in best and (b not in best or (best[a][0] + c, best[a][1] + 1) < best[b]):
                best[b] = (best[a][0] + c, best[a][1] + 1)
    before = {}
    for a, b, c in arcs:
        if a in best and b != source and best[a][0] + c == best[b][0] and (c > 0 or best[a][1] < best[b][1]):
            before[b] = min(before.get(b, a), a)
    return best, before


def front(vectors):
    return sorted(c for c in set(vectors) if not any(o != c and all(x <= y for x, y in zip(o, c, strict=True)) for o in vectors))


def fronts(graph, source):
    """node -> all non-dominated cost vectors; graph: node -> [(head, costs)]."""
    dims = len(next((c for arcs in graph.values() for _, c in arcs), (0,)))
    done, heap = {}, [((0,) * dims, repr(source), source)]
    while heap:
        cost, _, node = heapq.heappop(heap)
        if any(all(x <= y for x, y in zip(o, cost, strict=True)) for o in done.get(node, ())):
            continue
        done.setdefault(node, []).append(cost)
        for head, c in graph.get(node, ()):
            heapq.heappush(heap, (tuple(x + y for x, y in zip(cost, c, strict=True)), repr(head), head))
    return done
