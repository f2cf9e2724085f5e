"""Which runs to merge: neighbours in age whose sizes are alike."""

from __future__ import annotations

MOST_MERGED = 32


def pick(sizes: list[int], min_runs: int, most: int = MOST_MERGED) -> tuple[int, int] | None:
    """[start, end) of the newest group to merge, or None; sizes are newest first.

    A group grows while the next size is at least half and at most twice the mean so far, both in whole numbers.
    Only neighbours are merged: a merge that skipped a run could put old versions before newer ones.
    """
    for start in range(len(sizes)):
        group = [sizes[start]]
        for size in sizes[start + 1 : start + most]:
            mean = sum(group) // len(group)
            if not mean // 2 <= size <= 2 * mean:
                break
            group.append(size)
        if len(group) >= min_runs:
            return start, start + len(group)
    return None
