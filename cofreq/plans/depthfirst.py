"""Depth-first mining of one prefix group in bounded memory.

A group is a list of items with their tid lists, in the order of the search.
Extensions of a set are kept as tid lists or as diffsets (the tids of the set
that the extension lacks), whichever are smaller; below diffsets everything is
a diffset.  One list of extensions is held for each depth.  Where the next one
would pass the byte budget, the subtree is searched with the tid list of the
current set alone, against the group's own lists: the lists on one path add up
to no more than the group's lists do, so the peak is about twice the group plus
the budget, whatever the group."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

DEFAULT_BUDGET = 64 << 20


@dataclass
class _Extensions:
    """Frequent extensions of one set; ``own`` is its support (None: the group's
    prefix).  ``form``: 't' tid lists, 'd' diffsets, 'p' none kept, but the tids
    of the set itself in ``values``."""

    chosen: list[int]
    own: int | None
    form: str
    at: np.ndarray  # numbers of the items in the group
    support: np.ndarray
    values: np.ndarray
    ends: np.ndarray  # of the lists in ``values``
    next: int = 0
    stopped: bool = False

    @property
    def nbytes(self) -> int:
        return self.values.nbytes

    def list(self, i: int) -> np.ndarray:
        return self.values[self.ends[i]:self.ends[i + 1]]


class DepthFirst:
    """The frequent sets of a group: all of them, or (``closed``) those that the
    forward-closed search reports, which skips later siblings where an extension
    has the support of its set.  ``grown`` counts the sets visited and ``peak``
    the bytes held beside the group's own lists."""

    def __init__(self, items: list[int], tid_lists: list[np.ndarray], min_sup: int, max_items: int = 1 << 30,
                 closed: bool = False, budget: int = DEFAULT_BUDGET):
        self.items, self.min_sup, self.max_items, self.closed, self.budget = items, min_sup, max_items, closed, budget
        universe = np.unique(np.concatenate(tid_lists)) if tid_lists else np.zeros(0, np.int64)
        self.lists = [np.searchsorted(universe, np.sort(t)).astype(np.int32) for t in tid_lists]
        self.mark = np.zeros(len(universe), bool)
        self.held = self.peak = self.grown = 0

    def sets(self) -> Iterator[tuple[list[int], int]]:
        """(items in the order of the search, support)"""
        support = np.array([len(t) for t in self.lists], np.int64)
        often = np.flatnonzero(support >= self.min_sup)
        if not len(often):
            return
        ends = np.concatenate([[0], np.cumsum(support[often])])
        stack = [_Extensions([], None, "t", often, support[often], np.concatenate([self.lists[i] for i in often]), ends)]
        while stack:
            top = stack[-1]
            if top.stopped or top.next >= len(top.at):
                if stack.pop().chosen:
                    self.held -= top.nbytes
                continue
            i, top.next = top.next, top.next + 1
            support, chosen = int(top.support[i]), [*top.chosen, int(top.at[i])]
            self.grown += 1
            room = len(chosen) < self.max_items
            if self.closed and room and support == top.own:
                top.stopped = True  # what later siblings reach is inside larger sets of equal support
            below = self._extend(top, i, chosen, support) if room and i + 1 < len(top.at) else None
            if not (self.closed and below is not None and (below.support == support).any()):
                yield [self.items[x] for x in chosen], support
            if below is not None:
                self.held += below.nbytes
                self.peak = max(self.peak, self.held)
                stack.append(below)

    def _extend(self, top: _Extensions, i: int, chosen: list[int], support: int) -> _Extensions | None:
        later = top.at[i + 1:]
        if top.form == "p":
            return self._on_path(chosen, support, later, self._common(top.values, self.lists[top.at[i]]))
        mine, rest = top.list(i), top.values[top.ends[i + 1]:]
        starts = top.ends[i + 1:-1] - top.ends[i + 1]
        self.mark[mine] = True
        inside = self.mark[rest]
        self.mark[mine] = False
        sizes = np.diff(top.ends[i + 1:])
        hit = np.diff(np.concatenate([[0], np.cumsum(inside)])[np.append(starts, len(rest))])
        total = hit if top.form == "t" else support - (sizes - hit)
        often = np.flatnonzero(total >= self.min_sup)
        if not len(often):
            return None
        diff = top.form == "d" or int((support - total[often]).sum()) < int(total[often].sum())
        size = (support - total if diff else total)[often]
        if self.held + 4 * int(size.sum()) > self.budget:
            tids = self.lists[chosen[0]]
            for x in chosen[1:]:
                tids = self._common(tids, self.lists[x])
            return self._on_path(chosen, support, later, tids)
        if diff == (top.form == "d"):  # lists of the same form: those outside, or inside, of the chosen one's
            keep = (~inside if diff else inside) & np.repeat(total >= self.min_sup, sizes)
            values = rest[keep]
        else:
            parts = []
            for j in often:
                lacks = np.ones(len(mine), bool)
                a = starts[j]
                lacks[np.searchsorted(mine, rest[a:a + sizes[j]][inside[a:a + sizes[j]]])] = False
                parts.append(mine[lacks])
            values = np.concatenate(parts)
        return _Extensions(chosen, support, "d" if diff else "t", later[often], total[often], values,
                           np.concatenate([[0], np.cumsum(size)]))

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        self.mark[b] = True
        both = a[self.mark[a]]
        self.mark[b] = False
        return both

    def _on_path(self, chosen: list[int], support: int, later: np.ndarray, tids: np.ndarray) -> _Extensions | None:
        self.mark[tids] = True
        total = np.array([np.count_nonzero(self.mark[self.lists[x]]) for x in later], np.int64)
        self.mark[tids] = False
        often = total >= self.min_sup
        if not often.any():
            return None
        return _Extensions(chosen, support, "p", later[often], total[often], tids, np.zeros(1, np.int64))
