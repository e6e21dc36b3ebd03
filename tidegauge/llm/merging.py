"""Byte-pair merging with a heap of candidate pairs over a linked list of symbols."""

from __future__ import annotations

from heapq import heapify, heappop, heappush
from itertools import pairwise

#: A pair of symbol ids as one number; ids stay below 2**20.
SHIFT = 20
#: Position bits in a heap entry, whose upper bits are the rank: lowest rank first, then leftmost.
PLACE = 40
AT = (1 << PLACE) - 1


def merge(ids: list[int], pairs: dict[int, int], made: list[int], want_ids: bool) -> tuple[int, list[int]]:
    """Merge ``ids`` in place until no adjacent pair has a rank.

    ``pairs`` maps a pair to its rank, ``made`` a rank to the id of the merged symbol. Returns the
    number of merges and, if ``want_ids``, the symbols that are left. A heap entry is stale if its
    left symbol is gone or its pair has another rank by now; stale entries are skipped, so the work
    is O(n log n) for a run of n symbols.
    """
    n = len(ids)
    get = pairs.get
    ranks = list(map(get, [a << SHIFT | b for a, b in pairwise(ids)]))  # of the pair that begins at each symbol
    heap = [r << PLACE | i for i, r in enumerate(ranks) if r is not None]
    if not heap:
        return 0, ids
    if len(heap) > 1:
        heapify(heap)
    ranks.append(None)
    after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
    while heap:
        top = heappop(heap)
        i, rank = top & AT, top >> PLACE
        if ranks[i] != rank:
            continue
        j = after[i]
        new = ids[i] = made[rank]
        ids[j], ranks[j] = -1, None
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            r = ranks[i] = get(new << SHIFT | ids[k])
            if r is not None:
                heappush(heap, r << PLACE | i)
        else:
            ranks[i] = None
        b = before[i]
        if b >= 0:
            r = ranks[b] = get(ids[b] << SHIFT | new)
            if r is not None:
                heappush(heap, r << PLACE | b)
    return merges, [x for x in ids if x >= 0] if want_ids else ids
