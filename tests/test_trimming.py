import random

from catena.operators.trimming import LEAST, Fragment, cut_end, cut_start, trim, trim_query


def spans(f):
    return sum(n for n, o in f.ops if o in "=XI"), sum(n for n, o in f.ops if o in "=XD")


def make(rng):
    ops = tuple((rng.randrange(1, 60), rng.choice("=XID")) for _ in range(rng.randrange(1, 12))) + ((rng.randrange(60, 200), "="),)
    q, s = sum(n for n, o in ops if o in "=XI"), sum(n for n, o in ops if o in "=XD")
    qb, sb = rng.randrange(600), rng.randrange(600)
    places = (qb, qb + q, sb, sb + s)
    return Fragment(qb, qb + q, rng.randrange(2), rng.randrange(2), sb, sb + s, ops, tuple(p if rng.random() < 0.5 else p + 7 for p in places))


def test_cuts_reach_their_place():
    f = Fragment(10, 40, 0, 0, 100, 128, ((10, "="), (5, "I"), (3, "D"), (15, "=")))
    assert cut_start(f, q=15) == Fragment(15, 40, 0, 0, 105, 128, ((5, "="), (5, "I"), (3, "D"), (15, "=")))
    assert (cut_start(f, q=22).qb, cut_start(f, q=22).sb) == (25, 113)
    assert (cut_end(f, q=38).qe, cut_end(f, q=38).se) == (38, 126)
    assert cut_start(f, q=40) is None and cut_end(f, s=111).se == 110


def test_no_overlap_is_left():
    rng = random.Random(3)
    for _ in range(300):
        got = trim_query([make(rng) for _ in range(rng.randrange(1, 7))])
        assert all(a.qe <= b.qb for a, b in zip(got, got[1:]))
        for f in [*got, *trim([make(rng) for _ in range(5)])]:
            assert f.qe - f.qb >= LEAST and spans(f) == (f.qe - f.qb, f.se - f.sb)


def test_the_end_on_a_site_stays():
    left = Fragment(0, 100, 0, 0, 0, 100, ((100, "="),), (0, 100, 0, 100))
    right = Fragment(80, 200, 1, 0, 0, 120, ((120, "="),), (85, 200, 5, 120))
    assert [(f.qb, f.qe) for f in trim_query([right, left])] == [(0, 100), (100, 200)]
