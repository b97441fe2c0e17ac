"""Per-read programs that are sequential by nature: chaining, mapping quality, path, alignment.

Pure numpy and Python, without Spark; catena.operators.mapper runs them on
Arrow batches of one read's rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class ChainOptions:
    """Largest distance and gap of two seeds, largest share of length difference, least seeds of a chain, seed length."""

    distance: int = 400
    gap: int = 30
    ddf: float = 0.25
    least: int = 2
    k: int = 15
    most: int = 10_000


def chain(s: np.ndarray, q: np.ndarray, opt: ChainOptions = ChainOptions()) -> list[list[int]]:
    """Chains of seeds of one contig and strand, given by last bases in order of (s, q): indices from first to last.

    A seed joins the chain that becomes longest; one that overlaps it without
    a shift is taken at once, one that overlaps with a shift never. Chains end
    in seeds that nothing follows and are given by falling length; they may
    share their beginnings.
    """
    n = len(s)
    length, back, followed = [1] * n, [-1] * n, [False] * n
    for i in range(n):
        for j in range(i - 1, -1, -1):
            sd = int(s[i] - s[j])
            if sd > opt.distance:
                break
            qd = int(q[i] - q[j])
            if not sd or qd <= 0 or qd > opt.distance:
                continue
            shift = abs(qd - sd)
            if qd < opt.k and not shift:
                length[i], back[i] = length[j] + 1, j
                break
            if shift and (min(qd, sd) < opt.k or shift > opt.gap or shift > opt.ddf * sd):
                continue
            if length[j] + 1 > length[i]:
                length[i], back[i] = length[j] + 1, j
        if back[i] >= 0:
            followed[back[i]] = True
    heads = sorted((i for i in range(n) if not followed[i] and length[i] >= opt.least), key=lambda i: (-length[i], i))
    out = []
    for i in heads[: opt.most]:
        path = []
        while i >= 0:
            path.append(i)
            i = back[i]
        out.append(path[::-1])
    return out


def mapping_quality(b: np.ndarray, e: np.ndarray, rank_score: np.ndarray, chain_score: np.ndarray, factor: float, share: float = 0.8) -> np.ndarray:
    """Qualities 0 to 60 of a read's hits by one score.

    From the best hit down, a hit that overlaps an earlier one by share of its
    own length is that one's child and has 0; a hit without relatives has 60;
    a parent's falls with its best child's score and the number of its equals.
    """
    n = len(b)
    order = sorted(range(n), key=lambda i: (-rank_score[i], i))
    parent = {i: i for i in order}
    related: set[int] = set()
    for at in range(1, n):
        i = order[at]
        best, most = -1, 0
        for j in reversed(order[:at]):
            o = min(e[i], e[j]) - max(b[i], b[j])
            if o > most:
                best, most = j, o
        if best >= 0 and most >= share * (e[i] - b[i]):
            parent[i] = parent[best]
            related |= {i, best, parent[best]}
    out = np.zeros(n, int)
    for i in order:
        if parent[i] != i:
            continue
        if i not in related:
            out[i] = 60
            continue
        kids = [rank_score[j] for j in order if j != i and parent[j] == i]
        top = max(kids, default=0)
        equal = sum(k >= rank_score[i] for k in kids)
        value = int(factor * (1 - top / rank_score[i]) * math.log(max(chain_score[i], 1))) - int(4.343 * math.log(equal + 1) + 0.499)
        value = max(value, 0)
        out[i] = min(60, max(value, 1) if rank_score[i] > top else value)
    return out


def best_quality(b: np.ndarray, e: np.ndarray, chain_score: np.ndarray, align_score: np.ndarray) -> np.ndarray:
    """The larger quality of the pass by seeds (factor 160) and that by alignment (20)."""
    return np.maximum(mapping_quality(b, e, chain_score, chain_score, 160), mapping_quality(b, e, align_score, chain_score, 20))


def cover(b: np.ndarray, e: np.ndarray, score: np.ndarray, size: int, least: int = 50) -> list[int]:
    """The cheapest path over hits in order of (b, e): gaps of g bases cost 4 + 2 g, scores pay."""
    gap = lambda g: 0 if g == 0 else 4 + 2 * g
    order = sorted(range(len(b)), key=lambda i: (b[i], e[i], i))
    cost: dict[int, int] = {}
    back: dict[int, int] = {}
    for at, i in enumerate(order):
        cost[i], back[i] = gap(int(b[i])) - int(score[i]), -1
        for j in order[:at]:
            if b[i] - b[j] >= least and e[i] - e[j] >= least:
                c = cost[j] + gap(abs(int(b[i] - e[j]))) - int(score[i])
                if c < cost[i]:
                    cost[i], back[i] = c, j
    i = min(order, key=lambda k: (cost[k] + gap(size - int(e[k])), order.index(k)), default=-1)
    path = []
    while i >= 0:
        path.append(i)
        i = back[i]
    return path[::-1]


def align(query: str, subject: str, free_end: bool = False) -> tuple[int, str]:
    """Edit distance and CIGAR (=XID) of two strings, by rows; with free_end the subject's end is free, the first best one taken."""
    a, b = np.frombuffer(query.encode(), np.uint8), np.frombuffer(subject.encode(), np.uint8)
    n, m = len(a), len(b)
    table = np.empty((n + 1, m + 1), np.int32)
    table[0] = np.arange(m + 1)
    steps = np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        row = np.empty(m + 1, np.int32)
        row[0] = i
        row[1:] = np.minimum(table[i - 1, :-1] + (b != a[i - 1]), table[i - 1, 1:] + 1)
        table[i] = np.minimum.accumulate(row - steps) + steps
    j = int(table[n].argmin()) if free_end else m
    distance, i, ops = int(table[n, j]), n, []
    while i or j:
        if i and j and table[i, j] == table[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            ops.append("=" if a[i - 1] == b[j - 1] else "X")
            i, j = i - 1, j - 1
        elif i and table[i, j] == table[i - 1, j] + 1:
            ops.append("I")
            i -= 1
        else:
            ops.append("D")
            j -= 1
    return distance, run_lengths("".join(reversed(ops)))


def run_lengths(ops: str) -> str:
    """== = X as 3=1X."""
    out, k = [], 0
    while k < len(ops):
        end = k
        while end < len(ops) and ops[end] == ops[k]:
            end += 1
        out.append(f"{end - k}{ops[k]}")
        k = end
    return "".join(out)


def trim_ends(cigar: list[tuple[int, str]], anchor: int = 8) -> tuple[list[tuple[int, str]], tuple[int, int], tuple[int, int]]:
    """CIGAR without what lies before the first and behind the last match of anchor bases, and the (query, subject) bases cut on either side."""
    good = [k for k, (n, op) in enumerate(cigar) if op == "=" and n >= anchor]
    span = lambda part: (sum(n for n, op in part if op in "=XI"), sum(n for n, op in part if op in "=XD"))
    if not good:
        return [], span(cigar), (0, 0)
    a, b = good[0], good[-1] + 1
    return cigar[a:b], span(cigar[:a]), span(cigar[b:])
