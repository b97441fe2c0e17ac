"""Overlap trimming of a read's fragments, on the query and then on the subject.

Where two fragments overlap, the end that lies on a restriction site stays and
the other is cut along its alignment; without a difference the longer fragment
stays whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

#: Fragments shorter than this are dropped; so are those below GARBAGE with no end within NEAR of a site.
LEAST, GARBAGE, NEAR = 50, 200, 20


@dataclass(frozen=True)
class Fragment:
    """qb, qe on the read and sb, se on the contig's strand; ops: alignment columns as (count, =XID); sites: nearest ones of qb, qe, sb, se."""

    qb: int
    qe: int
    sid: int
    strand: int
    sb: int
    se: int
    ops: tuple[tuple[int, str], ...]
    sites: tuple[int, int, int, int] = field(default=(-1, -1, -1, -1))

    def on_site(self, k: int) -> bool:
        return (self.qb, self.qe, self.sb, self.se)[k] == self.sites[k]


def cut_start(f: Fragment, q: int | None = None, s: int | None = None) -> Fragment | None:
    """f from the first column that begins at or behind query place q or subject place s; None if nothing is left."""
    qb, sb = f.qb, f.sb
    ops = list(f.ops)
    while ops and ((q is not None and qb < q) or (s is not None and sb < s)):
        n, op = ops[0]
        want = q - qb if q is not None else s - sb
        step = min(n, want) if op in ("=XI" if q is not None else "=XD") else n
        qb += step * (op in "=XI")
        sb += step * (op in "=XD")
        ops[0] = (n - step, op)
        if n == step:
            ops.pop(0)
    while ops and ops[0][1] in "ID":
        n, op = ops.pop(0)
        qb += n * (op == "I")
        sb += n * (op == "D")
    return replace(f, qb=qb, sb=sb, ops=tuple(ops)) if ops else None


def cut_end(f: Fragment, q: int | None = None, s: int | None = None) -> Fragment | None:
    """f up to the last column that ends at or before query place q or subject place s."""
    back = replace(f, qb=-f.qe, qe=-f.qb, sb=-f.se, se=-f.sb, ops=f.ops[::-1])
    got = cut_start(back, None if q is None else -q, None if s is None else -s)
    return got and replace(got, qb=-got.qe, qe=-got.qb, sb=-got.se, se=-got.sb, ops=got.ops[::-1])


def _inside(a: Fragment, b: Fragment) -> bool:
    """Whether a lies in b on the query, or on the subject of the same strand."""
    return b.qb <= a.qb and a.qe <= b.qe or (a.sid, a.strand) == (b.sid, b.strand) and b.sb <= a.sb and a.se <= b.se


def _loser(left: Fragment, right: Fragment, subject: bool) -> str:
    """Whose end is cut, by the sites under the left one's end and the right one's start."""
    a, b, c, d = left.on_site(1), left.on_site(3), right.on_site(0), right.on_site(2)
    size = (lambda f: f.se - f.sb) if subject else (lambda f: f.qe - f.qb)
    longer = "right" if size(left) > size(right) else "left"
    if a and b and c and d:
        return ("left" if size(left) < size(right) else "right") if subject else longer
    if a and b:
        return "right"
    if c and d:
        return "left"
    none_right = not c and d if subject else not c and not d  # the subject pass asks for another combination here
    if (a or b) and none_right:
        return "right"
    if not a and not b and (c or d):
        return "left"
    return longer


def trim_query(frags: list[Fragment]) -> list[Fragment]:
    """No two left fragments overlap on the read; none is shorter than LEAST."""
    out = sorted(frags, key=lambda f: (f.qb, f.qe, f.sid, f.strand, f.sb))
    k = 0
    while k + 1 < len(out):
        left, right = out[k], out[k + 1]
        if left.qe <= right.qb:
            k += 1
            continue
        if _inside(left, right):
            out.pop(k)
            k = max(0, k - 1)
            continue
        if _inside(right, left):
            out.pop(k + 1)
            continue
        if _loser(left, right, False) == "left":
            cut = cut_end(left, q=right.qb)
            out[k : k + 1] = [cut] if cut and cut.qb < cut.qe else []
        else:
            cut = cut_start(right, q=left.qe)
            out[k + 1 : k + 2] = [cut] if cut and cut.qb < cut.qe else []
        k = max(0, k - 1)
    return [f for f in out if f.qe - f.qb >= LEAST]


def trim_subject(frags: list[Fragment]) -> list[Fragment]:
    """The same on contigs, for every two fragments of one contig and strand of which one begins first; one that it holds whole goes if it is the one to be cut."""
    out: list[Fragment | None] = list(frags)
    for i in range(len(out)):
        for j in range(len(out)):
            a, b = out[i], out[j]
            if i == j or a is None or b is None or (a.sid, a.strand) != (b.sid, b.strand) or not a.sb < b.sb < a.se:
                continue
            if _loser(a, b, True) == "left":
                out[i] = cut_end(a, s=b.sb)
            else:
                out[j] = cut_start(b, s=a.se) if a.se < b.se else None
    return [f for f in out if f is not None and f.qe - f.qb >= LEAST]


def garbage(f: Fragment) -> bool:
    places = (f.qb, f.qe, f.sb, f.se)
    return f.qe - f.qb < GARBAGE and all(abs(p - s) > NEAR for p, s in zip(places, f.sites))


def trim(frags: list[Fragment]) -> list[Fragment]:
    return sorted(trim_subject(trim_query([f for f in frags if not garbage(f)])), key=lambda f: f.qb)
