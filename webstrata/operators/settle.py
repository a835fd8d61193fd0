"""One-to-one matches in order of arrival, within one stretch of time that a task holds."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Hashable, Iterable, Iterator
from math import isqrt

#: Up to so many kinds every header counts as frequent.
FEW_KINDS = 16
Score = Callable[[Hashable, Hashable], int | None]
Parts = Callable[[Hashable], Iterable[tuple[Hashable, Hashable]]]


class _Free:
    """Records in order of time; those that are taken are stepped over by paths that are halved.

    ``twin`` has, for each record, the other list that it stands in and its place there.
    """

    __slots__ = ("at", "id", "ahead", "back", "twin")

    def __init__(self, records: list[tuple]):
        self.at, self.id = [r[0] for r in records], [r[1] for r in records]
        self.ahead, self.back = list(range(len(records) + 1)), list(range(len(records) + 1))  # back is one off: 0 is before all
        self.twin: list[tuple[_Free, int] | None] | None = None

    @staticmethod
    def _end(path: list[int], k: int) -> int:
        while path[k] != k:
            path[k] = path[path[k]]
            k = path[k]
        return k

    def nearest(self, at: int, within: int) -> tuple | None:
        """(gap, id, place) of the nearest free record, of equally near ones that with the smallest id."""
        times, found = self.at, None
        here = bisect_left(times, at)
        k = self._end(self.ahead, here)
        if k < len(times) and times[k] - at <= within:
            found = (times[k] - at, self.id[k], k)
        k = self._end(self.back, here) - 1
        if k >= 0 and at - times[k] <= within and (found is None or at - times[k] <= found[0]):
            k = self._end(self.ahead, bisect_left(times, times[k]))  # the first free one of that time
            found = min(found, (at - times[k], self.id[k], k)) if found else (at - times[k], self.id[k], k)
        return found

    def _leave(self, k: int) -> None:
        self.ahead[k] = k + 1
        self.back[k + 1] = k

    def take(self, k: int) -> None:
        self._leave(k)
        if self.twin and self.twin[k]:
            other, place = self.twin[k]
            other._leave(place)


class _Ours:
    """Records of one side by their headers, so that those with the best score are found without asking all kinds.

    A header that few kinds have (the root of their number) leads to these kinds. All others are searched together, by
    class: the names that they have and their frequent headers. A kind with a shared rare header does not score less than the rest of
    its class. So where the class's turn comes, none of these is left within reach, or all that are score alike.
    """

    def __init__(self, ours: Iterable[tuple], score: Score, parts: Parts):
        by_kind: dict[Hashable, list] = {}
        for at, one, kind in ours:
            by_kind.setdefault(kind, []).append((at, one))
        self.score, self.parts, self.kinds = score, parts, list(by_kind)
        headers = [frozenset(parts(kind)) for kind in by_kind]
        having: dict[tuple, list[int]] = {}
        for k, held in enumerate(headers):
            for header in held:
                having.setdefault(header, []).append(k)
        few = isqrt(len(headers)) if len(headers) > FEW_KINDS else 0
        self.rare = {header: kinds for header, kinds in having.items() if len(kinds) <= few}
        grouped: dict[tuple, list[int]] = {}
        for k, held in enumerate(headers):
            grouped.setdefault((frozenset(name for name, _ in held), frozenset(header for header in held if header not in self.rare)), []).append(k)
        self.classes: list[tuple[list[int], _Free]] = []
        self.apart: dict[int, _Free] = {}
        for (_, frequent), kinds in grouped.items():
            records = sorted((at, one, k) for k in kinds for at, one in by_kind[self.kinds[k]])
            whole = _Free(records)
            self.classes.append((kinds, whole))
            if any(len(frequent) < len(headers[k]) for k in kinds):
                self._set_apart(whole, records)

    def _set_apart(self, whole: _Free, records: list[tuple]) -> None:
        places: dict[int, list[int]] = {}
        for place, (_, _, k) in enumerate(records):
            places.setdefault(k, []).append(place)
        whole.twin = [None] * len(records)
        for k, own in places.items():
            part = self.apart[k] = _Free([records[place] for place in own])
            part.twin = [(whole, place) for place in own]
            for j, place in enumerate(own):
                whole.twin[place] = (part, j)

    def levels(self, kind: Hashable) -> list[tuple[int | None, list[_Free]]]:
        """Lists of records by their score with ``kind``, the best first."""
        shared = {k for header in self.parts(kind) for k in self.rare.get(header, ())}
        found: dict[int | None, list[_Free]] = {}
        for k in shared:
            found.setdefault(self.score(self.kinds[k], kind), []).append(self.apart[k])
        for kinds, whole in self.classes:
            other = next((k for k in kinds if k not in shared), None)
            if other is not None:
                found.setdefault(self.score(self.kinds[other], kind), []).append(whole)
        return sorted(found.items(), key=lambda x: -(x[0] or 0))


def _settle_one(theirs: Iterable[tuple], our_at: int, our: Hashable, our_kind: Hashable, score: Score, within: int) -> Iterator[tuple]:
    """``settle`` with a single record of ours: the first that is near takes it."""
    free = True
    for at, one, kind in theirs:
        if free and abs(our_at - at) <= within:
            free = False
            yield one, our, score(our_kind, kind), our_at
        else:
            yield one, None, None, None


def settle(theirs: Iterable[tuple], ours: Iterable[tuple], score: Score, within: int, parts: Parts) -> Iterator[tuple]:
    """(their id, our id, score, time of ours) for each of ``theirs``, in their order; nulls for those that get none.

    Records are (at, id, kind). Each takes the best of ``ours`` that is still free and at most ``within`` away: by
    the score of their kinds (ours, theirs), then the nearest in time, then the smallest id. ``parts`` are the headers
    of a kind, as (name, value). The score has to follow from which of their headers ours has alike and
    which of their names it has, and a header alike must not lower it.

    No pairs are made: a record looks once at each class of ours and at the kinds that share a rare header with it, so
    its cost grows neither with the window's rows nor with kinds that differ by rare headers.
    """
    ours = list(ours)
    if len(ours) == 1:
        yield from _settle_one(theirs, *ours[0], score, within)
        return
    free = _Ours(ours, score, parts)
    orders: dict[Hashable, list] = {}
    for at, one, kind in theirs:
        if kind not in orders:
            orders[kind] = free.levels(kind)
        for value, group in orders[kind]:
            best = None
            for records in group:
                found = records.nearest(at, within)
                if found is not None and (best is None or found[:2] < best[0][:2]):
                    best = found, records
            if best is not None:
                (_, our, k), records = best
                records.take(k)
                yield one, our, value, records.at[k]
                break
        else:
            yield one, None, None, None
