"""Byte-pair merging over a linked list with a heap, shared by the encoder and the counter."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

#: Bits for the place in the text in a heap entry; the rank stands above them.
PLACE = 40
MASK = (1 << PLACE) - 1
#: Bits for the right symbol in a pair's key.
RIGHT = 20


def pair(left: int, right: int) -> int:
    return left << RIGHT | right


def ranked(pairs: dict[int, int], rank: list[int]) -> dict[int, int]:
    """For each pair its rank as it stands in a heap entry, above the place."""
    return {key: rank[joined] + 1 << PLACE for key, joined in pairs.items()}


def merge(symbols: list[int], pairs: dict[int, int], order: dict[int, int]) -> int:
    """Merge adjacent symbols in place, the lowest rank first and the leftmost among equals; returns the merges made.

    ``pairs`` maps :func:`pair` of two symbols to the merged symbol, ``order``
    is its :func:`ranked`. A merged symbol stands at its first place, the other
    places hold -1. ``due`` has what each place waits for, so heap entries that
    no longer hold are told by one comparison and passed over.
    """
    n = len(symbols)
    rank = order.get
    due = [rank(a << RIGHT | b, 0) for a, b in zip(symbols, symbols[1:])]  # noqa: B905
    due.append(0)
    heap = [w | i for i, w in enumerate(due) if w]
    if not heap:
        return 0
    heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n))
    merges = 0
    while heap:
        entry = heappop(heap)
        i = entry & MASK
        if due[i] != entry ^ i:
            continue
        merges += 1
        j = after[i]
        joined = symbols[i] = pairs[symbols[i] << RIGHT | symbols[j]]
        symbols[j] = -1
        due[j] = 0
        k = after[i] = after[j]
        before[k] = i
        if k < n:
            w = due[i] = rank(joined << RIGHT | symbols[k], 0)
            if w:
                heappush(heap, w | i)
        else:
            due[i] = 0
        h = before[i]
        if h >= 0:
            w = due[h] = rank(symbols[h] << RIGHT | joined, 0)
            if w:
                heappush(heap, w | h)
    return merges
