"""Incidence of the n-cube as Python lists, for literals of expressions and for the search kernel."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

from . import cells


class Incidence:
    """Indices are those of operators/cells.py."""

    def __init__(self, n: int):
        cells.check_dimension(n)
        every = list(product(range(3), repeat=n))
        by_dim = [[c for c in every if c.count(2) == d] for d in range(3)]
        index = [{c: i for i, c in enumerate(x)} for x in by_dim]
        cut = lambda c: [c[:k] + (b,) + c[k + 1 :] for k in range(n) if c[k] == 2 for b in (0, 1)]
        self.n, self.squares, self.square_index = n, by_dim[2], index[2]
        self.edges_of = [[index[1][f] for f in cut(s)] for s in by_dim[2]]
        self.ends = [[index[0][f] for f in cut(e)] for e in by_dim[1]]
        self.vertices_of = [sorted({v for e in es for v in self.ends[e]}) for es in self.edges_of]
        self.squares_on = self._inverse(self.edges_of, len(by_dim[1]))
        self.squares_at = self._inverse(self.vertices_of, len(by_dim[0]))
        self.edges_at = self._inverse(self.ends, len(by_dim[0]))
        self.vertices = by_dim[0]
        self.near = [[index[0][v[:k] + (1 - v[k],) + v[k + 1 :]] for k in range(n)] for v in by_dim[0]]
        self.cycles = [self._cycles(v) for v in range(len(self.vertices))]

    @staticmethod
    def _inverse(lists: list[list[int]], size: int) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in range(size)]
        for i, xs in enumerate(lists):
            for x in xs:
                out[x].append(i)
        return out

    def _cycles(self, v: int) -> dict[int, list[tuple[int, ...]]]:
        """By length, the squares of each closed walk of squares around a vertex: each direction is met by none or two of them."""
        around = [(s, sum(1 << k for k in range(self.n) if self.squares[s][k] == 2)) for s in self.squares_at[v]]
        layer = [((s,), d, i) for i, (s, d) in enumerate(around)]
        found: dict[int, list[tuple[int, ...]]] = {}
        for length in range(2, 6 if self.n >= 7 else 5):
            layer = [((*m, around[j][0]), d ^ around[j][1], j) for m, d, i in layer for j in range(i + 1, len(around))]
            if length >= 3:
                found[length] = [m for m, d, _ in layer if not d]
        return found


@lru_cache
def incidence(n: int) -> Incidence:
    return Incidence(n)
