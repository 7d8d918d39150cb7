"""A hierarchical navigable small-world graph over the vectors of one partition."""

from __future__ import annotations

import heapq
import math

import numpy as np


class LayeredGraph:
    def __init__(self, x: np.ndarray, m: int = 16, ef: int = 200, seed: int = 42):
        self.x, self.m, self.ef = x, m, ef
        rng = np.random.default_rng(seed)
        self.levels = np.floor(-np.log(1.0 - rng.random(len(x))) / math.log(m)).astype(int)
        self.links: list[dict[int, list[int]]] = [dict() for _ in range(int(self.levels.max()) + 1)]
        self.entry, self.gone = 0, set()
        for i in range(len(x)):
            self._add(i)

    def _far(self, q: np.ndarray, ids: list[int]) -> np.ndarray:
        return np.sqrt(((self.x[ids] - q) ** 2).sum(axis=1))

    def _layer(self, q: np.ndarray, start: list[int], ef: int, level: int) -> list[tuple[float, int]]:
        d = self._far(q, start)
        seen, todo = set(start), [(float(a), i) for a, i in zip(d, start, strict=True)]
        best = [(-a, i) for a, i in todo]
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            a, i = heapq.heappop(todo)
            if len(best) >= ef and a > -best[0][0]:
                break
            near = [j for j in self.links[level].get(i, ()) if j not in seen]
            if not near:
                continue
            seen.update(near)
            for b, j in zip(self._far(q, near).tolist(), near, strict=True):
                if len(best) < ef or b < -best[0][0]:
                    heapq.heappush(todo, (b, j))
                    heapq.heappush(best, (-b, j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-a, i) for a, i in best)

    def _select(self, found: list[tuple[float, int]], limit: int) -> list[int]:
        """Near and diverse: a candidate closer to a chosen one than to the base waits for free places."""
        chosen, rest = [], []
        for d, i in found:
            if len(chosen) >= limit:
                break
            (chosen if not chosen or d <= self._far(self.x[i], chosen).min() else rest).append(i)
        return (chosen + rest)[:limit]

    def _add(self, i: int) -> None:
        top, level = int(self.levels[self.entry]), int(self.levels[i])
        if i == 0:
            for lv in range(level + 1):
                self.links[lv][0] = []
            return
        at = [self.entry]
        for lv in range(top, level, -1):
            at = [self._layer(self.x[i], at, 1, lv)[0][1]]
        for lv in range(min(top, level), -1, -1):
            found = self._layer(self.x[i], at, self.ef, lv)
            limit = self.m * 2 if lv == 0 else self.m
            self.links[lv][i] = self._select(found, self.m)
            for j in self.links[lv][i]:
                other = self.links[lv].setdefault(j, [])
                other.append(i)
                if len(other) > limit:
                    d = self._far(self.x[j], other)
                    self.links[lv][j] = self._select(sorted(zip(d.tolist(), other, strict=True)), limit)
            at = [j for _, j in found]
        for lv in range(top + 1, level + 1):
            self.links[lv][i] = []
        if level > top:
            self.entry = i

    def delete(self, i: int) -> bool:
        known = i < len(self.x) and i not in self.gone
        self.gone.add(i)
        return known

    def search(self, q: np.ndarray, k: int, ef: int, keep=None) -> list[tuple[float, int]]:
        at = [self.entry]
        for lv in range(int(self.levels[self.entry]), 0, -1):
            at = [self._layer(q, at, 1, lv)[0][1]]
        found = [(d, i) for d, i in self._layer(q, at, max(ef, k), 0) if i not in self.gone and (keep is None or keep(i))]
        return found[:k]
