"""Canonical form of one small labelled multigraph: equal for two graphs exactly if one is the other with its nets renamed."""
import sys
from collections import Counter

Edge = tuple[str, bool, object, object]  # label, polar, first net, second net


def _refined(near: dict, colour: dict) -> dict:
    """Coarsest stable colouring below `colour`; colours are ranks of what is seen, so they don't depend on names."""
    while True:
        seen = {n: (colour[n], tuple(sorted((lab, side, colour[o]) for lab, side, o in near[n]))) for n in colour}
        rank = {s: k for k, s in enumerate(sorted(set(seen.values())))}
        if len(rank) == len(set(colour.values())) or len(rank) == len(colour):
            return {n: rank[s] for n, s in seen.items()}
        colour = {n: rank[s] for n, s in seen.items()}


def _listed(edges: list[Edge], at: dict) -> list:
    return sorted((lab, polar, at[u], at[v]) if polar else (lab, polar, *sorted((at[u], at[v]))) for lab, polar, u, v in edges)


def _interchangeable(near: dict, a, b) -> bool:
    """Whether the graph stays what it is when a and b change places."""
    swap = {a: b, b: a}
    return all(Counter((lab, side, swap.get(o, o)) for lab, side, o in near[x]) == Counter(near[swap[x]]) for x in (a, b))


def _least(edges: list[Edge], near: dict, colour: dict) -> tuple[list, dict, list[dict]]:
    """Least edge list over all ways to tell tied nets apart, its numbering, and automorphisms found on the way. While nets are tied, each net of the smallest tied
    colour is marked in turn and colours are refined again; nets that an automorphism under this colouring takes to one already tried give nothing new."""
    sizes = Counter(colour.values())
    tied = sorted((n, c) for c, n in sizes.items() if n > 1)
    if not tied:
        return _listed(edges, colour), colour, []
    c = tied[0][1]
    members = [n for n in colour if colour[n] == c]
    if all(_interchangeable(near, members[0], m) for m in members[1:]):
        # any order of them will do
        k = len(members) + 1
        marked = {n: x * k for n, x in colour.items()} | {m: c * k + i for i, m in enumerate(members)}
        return _least(edges, near, _refined(near, marked))
    orbit = {m: m for m in members}

    def root(m):
        while orbit[m] != m:
            m = orbit[m]
        return m

    def merge(auto):
        for m in members:
            a, b = root(m), root(auto[m])
            if a != b:
                orbit[max(a, b, key=members.index)] = min(a, b, key=members.index)
    best, tried, autos = None, [], []
    for m in members:
        if any(root(m) == root(t) for t in tried):
            continue
        got, numbers, more = _least(edges, near, _refined(near, {n: 2 * x for n, x in colour.items()} | {m: 2 * c - 1}))
        tried.append(m)
        if best is not None and got == best[0]:
            back = {k: n for n, k in best[1].items()}
            more = [*more, {n: back[k] for n, k in numbers.items()}]
        elif best is None or got < best[0]:
            best = got, numbers
        for auto in more:
            merge(auto)
        autos += more
    return *best, autos


def canonical_form(edges: list[Edge], colours: dict | None = None) -> str:
    """Text that two graphs share exactly if they are equal up to the names of their nets. Connected parts are treated one by one, so that equal parts need
    no choice between them. `colours` may give numbers that tell nets apart already, the same for equal graphs."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))
    near: dict = {}
    for lab, polar, u, v in edges:
        near.setdefault(u, []).append((lab, "a" if polar else "", v))
        near.setdefault(v, []).append((lab, "b" if polar else "", u))
    part: dict = {}
    for n in near:
        if n not in part:
            part[n], todo = n, [n]
            while todo:
                for _, _, o in near[todo.pop()]:
                    if o not in part:
                        part[o] = n
                        todo.append(o)
    by_part: dict = {}
    for e in edges:
        by_part.setdefault(part[e[2]], []).append(e)
    forms = []
    for p, own in by_part.items():
        mine = {n: near[n] for n in near if part[n] == p} if len(by_part) > 1 else near
        start = {n: colours[n] if colours else 0 for n in mine}
        forms.append(repr(_least(own, mine, _refined(mine, start))[0]))
    return "\n".join(sorted(forms))
