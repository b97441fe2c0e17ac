import random

import xxhash
from catena.llm.components import connected_components
from catena.llm.simhash import near_links, simhash_components
from pyspark.sql import functions as F


def brute_fp(text, k=3):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(points, linked):
    label = {i: i for i, _ in points}
    changed = True
    while changed:
        changed = False
        for i, x in points:
            for j, y in points:
                if linked(x, y) and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def near(x, y):
    return (x ^ y).bit_count() <= 2


def test_documents(spark):
    rng = random.Random(3)
    vocab = [f"Wö{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choices(vocab, k=60))) for k in range(20)]
    rows += [(100 + k, rows[k % 5][1].replace("Wö1 ", f"Wö1{' ' * (k % 3 + 1)}\t").replace("Wö2", "wö2") + (" extra" if k % 2 else "")) for k in range(20)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, "ONE"), (205, "one two"), (206, "x y z " * 30_000)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, fp int, key string")
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash_components(df).collect()}
    points = [(i, brute_fp(t)) for i, t in rows]
    label = brute_components(points, near)
    assert got == {i: (x, label[i]) for i, x in points}


def test_empty_and_null_id(spark):
    schema = "doc_id long, text string"
    assert simhash_components(spark.createDataFrame([], schema)).count() == 0
    got = simhash_components(spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (3, "d")], schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (3, 3), (7, 7), (7, 7)]


def test_hot_buckets_lose_no_link(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    points = [(k, x) for k, x in enumerate(sorted(fps))]
    df = spark.createDataFrame([(k, x - (1 << 64) if x >> 63 else x) for k, x in points], "rep long, fp long")
    label = brute_components(points, near)
    for small in (4, 10_000):
        links = near_links(df, 2, small)
        pairs = [(r.a, r.b) for r in links.collect()]
        assert all(near(points[a][1], points[b][1]) for a, b in pairs)
        found = {r.node: r.component for r in connected_components(links).collect()}
        assert {k: found.get(k, k) for k, _ in points} == label
    every = {(a, b) for a, x in points for b, y in points if a < b and near(x, y)}
    assert set(pairs) == every


def test_components_of_a_long_path(spark):
    links = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(links).collect()} == {1}
    none = spark.createDataFrame([(1, 1), (2, None)], "a long, b long")
    assert connected_components(none).count() == 0


def test_near_duplicates(spark):
    from catena.llm.simhash import drop_near_duplicates, near_duplicates

    rng = random.Random(9)
    vocab = [f"v{k}" for k in range(5000)]
    docs = {k: rng.choices(vocab, k=rng.choice([120, 300, 700])) for k in range(60)}
    n = 100
    for k in range(30):
        for _ in range(3 if k else 150):
            w = list(docs[k])
            for _ in range(max(1, len(w) // 90)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs[n] = w
            n += 1
    rows = [(k, " ".join(w)) for k, w in docs.items()] + [(9000, None), (9001, ""), (9002, "a b"), (9003, "A  b"), (9004, None)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, node int, bucket int")
    shingles = {k: {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in docs.items()}
    label = {r.node: r.component for r in near_duplicates(df).collect()}
    jac = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    pairs = [(a, b) for a in docs for b in docs if a < b and jac(a, b) >= 0.8]
    assert len(pairs) > 500 and all(label.get(a, a) == label.get(b, b) for a, b in pairs)
    for a in docs:
        if a != label.get(a, a):
            assert max(jac(a, b) for b in docs if b != a and label.get(b, b) == label[a]) >= 0.8
    assert label[9003] == 9002 and 9000 not in label and 9001 not in label
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _ in rows if label.get(k, k) == k)
    assert drop_near_duplicates(df.limit(0)).count() == 0


def test_near_copies_of_one_original_meet_it(spark):
    from catena.llm.simhash import near_duplicates

    rng = random.Random(17)
    original = [f"o{k}" for k in range(300)]
    docs = {1000: original}
    for k in range(400):
        w = list(original)
        for at in rng.sample(range(2, 298, 5), 6):
            w[at] = f"new{k}x{at}"
        docs[k] = w
    rows = [(k, " ".join(w)) for k, w in docs.items()]
    got = {r.node: r.component for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shingles = {k: {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in docs.items()}
    jac = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    close = [k for k in range(400) if jac(k, 1000) >= 0.8]
    assert len(close) == 400
    assert {got.get(k) for k in docs} == {0}


def test_every_unconnected_pair_of_a_bucket(spark):
    from catena.llm.simhash import unconnected_pairs

    members = [(b, d, 100) for b in (1, 2) for d in range(40 * b)]
    component = {d: d % 7 if d < 30 else d for d in range(80)}
    found = spark.createDataFrame([(d, c) for d, c in component.items() if d < 30], "node long, component long")
    got = unconnected_pairs(spark.createDataFrame(members, "bucket long, doc_id long, size int"), found, 8).collect()
    assert {(r.a, r.b) for r in got} == {(a, b) for b in range(80) for a in range(b) if component[a] != component[b]}


def test_similarity_of_long_texts_is_exact(spark):
    from catena.llm.simhash import alike, shingle_set

    rng = random.Random(23)
    rows, want = [], []
    for changed in (38, 40, 42, 43, 44, 45, 46, 48, 50, 52):
        a = [f"w{k}" for k in range(2000)]
        b = list(a)
        for at in rng.sample(range(2, 1998, 5), changed):
            b[at] = f"new{at}"
        x, y = ({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        want.append(len(x & y) / len(x | y) >= 0.8)
        rows.append((changed, *(shingle_set(" ".join(w).encode()).view("int64").tolist() for w in (a, b))))
    got = spark.createDataFrame(rows, "k int, x array<long>, y array<long>").select("k", alike(F.col("x"), F.col("y")).alias("near")).orderBy("k").collect()
    assert [r.near for r in got] == want and len(set(want)) == 2


def test_pigeonring_passes_all_within_the_budget(spark):
    from catena.llm.simhash import chain_within

    rng = random.Random(31)
    diffs = []
    for n in [*range(0, 33)] * 12:
        x = sum(1 << k for k in (rng.sample(range(64), n) if rng.random() < 0.5 else [(j + 7 * n) % 64 for j in range(n)]))
        diffs.append((x.bit_count(), x - (1 << 64) if x >> 63 else x))
    df = spark.createDataFrame(diffs, "n int, d long")
    for budget, segments, chain in ((28, 8, 4), (2, 5, 5), (9, 10, 3)):
        got = df.select("n", chain_within(F.col("d"), budget, segments, chain).alias("ok")).collect()
        assert all(r.ok for r in got if r.n <= budget)
        assert budget == 28 or not all(r.ok for r in got)


def test_every_near_pair_is_found(spark):
    from catena.llm.simhash import near_duplicates

    rng = random.Random(29)
    docs, notice = {}, [f"notice{k}" for k in range(40)]
    for k in range(400):
        n = rng.choice([5, 9, 30, 150, 400])
        w = [f"d{k}x{i}" for i in range(n)] + notice * (k % 3 == 0)
        docs[k] = list(w)
        lost = (len(w) - 4) // 9  # shingles that may differ on each side
        for at in rng.sample(range(2, len(w), 5), min(len(range(2, len(w), 5)), lost // 5 + rng.randrange(2))):
            w[at] = f"e{k}x{at}"
        docs[1000 + k] = w + [f"tail{k}"] * (lost % 5 > 2)
    rows = [(k, " ".join(w)) for k, w in docs.items()]
    got = {r.node: r.component for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shingles = {k: {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in docs.items()}
    close = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) >= 0.8
    ends = list(docs)
    pairs = [(a, b) for i, a in enumerate(ends) for b in ends[i + 1 :] if close(a, b)]
    assert 200 < len(pairs) < 400
    assert got == {x: min(p) for p in pairs for x in p}


def test_wide_fingerprints(spark):
    import numpy as np

    from catena.llm.simhash import NEAR_LEAST, WIDE, WIDE_BITS, wide_apart, wide_fingerprint

    def mixed(h, j):
        x, cut = h + (j + 1) * 0x9E3779B97F4A7C15, (1 << 64) - 1
        x = ((x & cut) ^ (x & cut) >> 30) * 0xBF58476D1CE4E5B9 & cut
        x = (x ^ x >> 27) * 0x94D049BB133111EB & cut
        return x ^ x >> 31

    rng = random.Random(37)
    for n in (0, 1, 2, 65):
        own = [rng.getrandbits(64) for _ in range(n)]
        want = [sum(1 << b for b in range(64) if 2 * sum(mixed(h, j) >> b & 1 for h in own) > n) for j in range(WIDE)]
        assert [x % (1 << 64) for x in wide_fingerprint(np.array(own, np.uint64)).tolist()] == want
    whole = np.array([rng.getrandbits(64) for _ in range(9000)], np.uint64)
    assert (wide_fingerprint(whole) == wide_fingerprint(whole[::-1])).all()  # more than one block

    rows, want = [], []
    for k in range(300):
        n = rng.choice([NEAR_LEAST, NEAR_LEAST + 1, 200])
        same = -(-8 * n // 9)  # of both, for a similarity of 0.8
        far = rng.random() < 0.3
        draw = np.array([rng.getrandbits(64) for _ in range(2 * n - (n // 4 if far else same))], np.uint64)
        a, b = wide_fingerprint(draw[:n]), wide_fingerprint(draw[-n:])
        rows.append((far, a.tolist(), b.tolist()))
        want.append(int(np.bitwise_count((a ^ b).view(np.uint64)).sum()))
    got = spark.createDataFrame(rows, "far boolean, a array<long>, b array<long>").select("far", wide_apart(F.col("a"), F.col("b")).alias("d")).collect()
    assert sorted(r.d for r in got) == sorted(want)
    assert all((r.d > WIDE_BITS) == r.far for r in got)


def test_components_of_few_links_in_one_task(spark):
    rng = random.Random(41)
    links = [(k, k + 1) for k in range(1, 60)] + [(1000, k) for k in range(900, 960)] + [(2000 + rng.randrange(80), 2000 + rng.randrange(80)) for _ in range(50)]
    links += [(3, 3), (7, None), (2, 1), (-5, -9), (1 << 62, -(1 << 62))]
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    want = {(r.node, r.component) for r in connected_components(df).collect()}
    for at_once in (1, 20, 10_000):
        got = connected_components(df, at_once=at_once).collect()
        assert len(got) == len(want) and {(r.node, r.component) for r in got} == want
    assert connected_components(df.limit(0), at_once=10_000).count() == 0


def test_near_duplicates_of_few_links_take_few_stages(spark):
    from catena.llm.simhash import near_duplicates

    chain = [f"c{k}" for k in range(200)]
    rows = []
    for k in range(24):  # each near the next one only
        chain = [f"n{k}x{at}" if at in (8 * k, 8 * k + 4) else w for at, w in enumerate(chain)]
        rows.append((k, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sc = spark.sparkContext
    sc.setJobGroup("near", "")
    try:
        got = near_duplicates(df)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert {(r.node, r.component) for r in got.collect()} == {(k, 0) for k in range(24)}
    assert len(sc.statusTracker().getJobIdsForGroup("near")) < 120


def test_pairs_with_centres_carry_sizes_and_fingerprints(spark):
    from catena.llm.simhash import hot_pairs

    rng = random.Random(43)
    marks = {k: (rng.getrandbits(63), rng.randrange(5, 90)) for k in range(100)}
    hot = spark.createDataFrame([(1 + (k > 59), k, 60 if k < 60 else 40) for k in marks], "bucket long, doc_id long, n long")
    got = hot_pairs(hot, spark.createDataFrame([(k, *x) for k, x in marks.items()], "doc_id long, fp long, size int")).collect()
    assert {x for r in got for x in (r.a, r.b)} == set(marks) and len(got) >= 4 * 96
    for r in got:
        assert r.a < r.b and (r.a < 60) == (r.b < 60)
        assert (r.na, r.nb, r.diff) == (marks[r.a][1], marks[r.b][1], marks[r.a][0] ^ marks[r.b][0])
