import numpy as np
from catena.llm.embedding_dedup import close_pairs, near_vectors, principal_axes

SCHEMA = "vec_id long, embedding array<float>, label int, weight int"


def brute(rows, threshold=0.98):
    good = {}
    for i, v, l in rows:
        if v is not None and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.float32(v).astype(float)
            good[i] = (l, x, np.linalg.norm(x))
    label = {i: i for i, _, _ in rows}
    near = {i: [j for j, b in good.items() if j != i and b[0] == a[0] and len(b[1]) == len(a[1]) and a[1] @ b[1] / (a[2] * b[2]) >= threshold] for i, a in good.items()}
    changed = True
    while changed:
        changed = False
        for i, js in near.items():
            for j in js:
                if label[j] < label[i]:
                    label[i], changed = label[j], True
    return {i: (len(near.get(i, [])), label[i], label[i] == i) for i, _, _ in rows}


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 12))
    rows = [(int(k), (base[k % 60] * rng.uniform(0.5, 2) + rng.normal(size=12) * rng.choice([0, 0.02, 0.05, 0.09])).tolist(), int(k % 3 if k % 7 else 1)) for k in rng.permutation(400)]
    hot = rng.normal(size=12)
    rows += [(1000 + k, hot.tolist(), 1) for k in range(40)] + [(2000 + k, (hot + rng.normal(size=12) * 0.04).tolist(), 1) for k in range(150)]
    rows += [(3000, None, 1), (3001, [0.0] * 12, 1), (3002, [1.0, None] * 6, 1), (3003, [float("nan")] * 12, 1), (3004, [float("inf")] * 12, 1), (3005, hot.tolist(), None), (3006, [], 1)]
    rows += [(3010, [1.0], 1), (3011, [2.0], 1), (3012, [-1.0], 1), (3013, [3.0, 4.0], 1), (3014, [3.0, 4.0], 1)]
    df = spark.createDataFrame([(*r, 3) for r in rows], SCHEMA)
    for tile in (512, 20):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, tile=tile).collect()}
        assert got == brute(rows)


def test_empty_repeats_null_id(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    got = near_vectors(spark.createDataFrame([(1, [1.0, 0.0], 0, 1), (1, [1.0, 0.0], 0, 1), (None, [1.0, 0.0], 0, 1)], SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True)]


def test_bounds_drop_no_pair():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(200, 64)) * np.linspace(2, 0.1, 64)
    b = np.concatenate((a[:50] + rng.normal(size=(50, 64)) * 0.05, rng.normal(size=(100, 64))))
    cosine = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    for t in (0.5, 0.9, 0.98):
        i, j = close_pairs(a, b, principal_axes(a), t)
        assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(cosine >= t))))
