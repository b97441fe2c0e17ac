import random

import numpy as np
from catena.llm import substring_dedup as S
from catena.llm.words import Words, spark_xxhash64
from pyspark.sql import functions as F


def brute(rows, size=20):
    seen, gone = {}, {i: set() for i, _ in rows}
    words = {i: (t or "").encode().split() for i, t in sorted(rows, key=lambda r: r[0])}
    for i, w in words.items():
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            if key in seen:
                gone[i].update(range(k, k + size))
            else:
                seen[key] = (i, k)
    return {i: (len(w), len(gone[i]), b" ".join(x for k, x in enumerate(w) if k not in gone[i]).decode()) for i, w in words.items()}


def check(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, bucket int").repartition(3)
    got = {r.id: (r.n_words, r.n_removed, r.kept) for r in S.removals(df).collect()}
    assert got == brute(rows)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(2000)] + ["é", "a", "b"]
    passages = [" ".join(rng.choices(vocab, k=n)) for n in (19, 20, 21, 33, 60, 200)]
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choices(vocab, k=rng.randrange(40)))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages).split()
            a = rng.randrange(len(p))
            parts += [" ".join(p[a:] if rng.random() < 0.3 else p), " ".join(rng.choices(vocab, k=rng.randrange(30)))]
        rows.append((1000 - i * 7 if i % 2 else -i, "\n ".join(parts)))
    rows += [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "x " * 500), (5004, "x " * 30), (5005, "a b " * 3000)]
    check(spark, rows)


def test_small_blocks_and_copies(spark):
    text = " ".join(f"k{j}" for j in range(45))
    check(spark, [(k, text if k % 3 else text + " tail") for k in range(60)])


def test_nulls_repeats_empty(spark):
    schema = "doc_id long, text string"
    assert S.removals(spark.createDataFrame([], schema)).count() == 0
    text = " ".join(map(str, range(25)))
    got = sorted((r.id or -9, r.n_removed) for r in S.removals(spark.createDataFrame([(None, text), (4, text), (4, text)], schema)).collect())
    assert got == [(-9, 0), (4, 25), (4, 25)]
    got = [(r.id, r.n_removed) for r in S.removals(spark.createDataFrame([(4, text), (4, text)], schema)).collect()]
    assert got == [(4, 0), (4, 0)]


def test_cover_and_packing():
    for a in range(S.PERIOD):
        for b in range(S.PERIOD):
            assert any((a + k) % S.PERIOD in S.COVER and (b + k) % S.PERIOD in S.COVER for k in range(S.PERIOD))
    doc, pos = np.array([5, 5, -3, 1 << 62], np.int64), np.arange(4, dtype=np.uint32)
    back = S._unpack(S._pack(doc, pos), "u4")
    assert (back[0] == doc).all() and (back[1] == pos).all()
    words = Words([b"a bb\tccc", b"", b" bb ccc "])
    assert words.count.tolist() == [3, 0, 2] and words.hash[1] == words.hash[3] and words.hash[2] == words.hash[4]
    at = np.array([1, 3])
    assert len(set(words.windows(at, 2).tolist())) == 1


def test_hash_is_sparks(spark):
    x = [0, 1, -1, 123456789012, -(1 << 63)]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "v long").select(F.xxhash64("v")).collect()]
    assert spark_xxhash64(np.array(x, np.int64)).tolist() == want


def test_remove_passages_keeps_columns(spark):
    text = " ".join(map(str, range(25)))
    rows = [(1, "a\n" + text, "en", 7, 1.5), (2, text + " z", None, 8, None), (3, "two\n words", "x", 9, 2.0), (4, None, "x", 9, 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket string, n_chars int, rest double")
    out = S.remove_passages(df)
    assert out.schema == df.schema
    got = sorted(map(tuple, out.collect()))
    assert got == [(1, "a\n" + text, "en", len(text) + 2, 1.5), (2, "z", None, 1, None), (3, "two\n words", "x", 10, 2.0), (4, "", "x", 0, 2.0)]


def test_words_that_a_polynomial_hash_confuses(spark):
    from catena.llm.words import Words

    a = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    assert len(set(Words([f"{a} {b} {a[:200]} {b[:200]} x\0 x {'y' * 8} {'y' * 9}".encode()]).hash.tolist())) == 8
    words = [f"w{k}" for k in range(19)]
    rows = [(1, " ".join([a, *words])), (2, " ".join([b, *words])), (3, " ".join([b, *words, "end"]))]
    got = {r.id: (r.n_words, r.n_removed) for r in S.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (20, 0), 2: (20, 0), 3: (21, 20)}
