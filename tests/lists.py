"""Small random list data and dense-matrix answers to check against."""

import random
from collections import Counter, defaultdict


def random_interactions(n_lists=40, n_tracks=30, seed=3):
    """(pid, pos, track) with repeats inside lists and one list far longer than the others."""
    rng = random.Random(seed)
    rows = []
    for pid in range(n_lists):
        size = 60 if pid == 0 else rng.randint(1, 9)
        rows += [(pid, pos, min(int(rng.expovariate(0.12)), n_tracks - 1)) for pos in range(size)]
    return rows


def lists_of(rows):
    out = defaultdict(Counter)
    for pid, _, track in rows:
        out[pid][track] += 1
    return out


def cf_by_hand(seeds, rows, a=0.1, q=0.5):
    """{(pid, track): score} by looking at every track for every seed row."""
    lists = lists_of(rows)
    holders = defaultdict(set)
    for pid, tracks in lists.items():
        for t in tracks:
            holders[t].add(pid)
    by_list = defaultdict(list)
    for pid, track in seeds:
        by_list[pid].append(track)
    out = {}
    for pid, own in by_list.items():
        for t, ht in holders.items():
            total = 0.0
            for s in own:
                c = len(ht & holders.get(s, set()))
                if c:
                    total += (c / (len(ht) ** a * len(holders[s]) ** (1 - a))) ** q
            if total:
                out[pid, t] = total / len(own)
    return out
