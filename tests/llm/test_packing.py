import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from catena.llm.packing import CAPACITY, Plan, cut_lengths, pack, pack_documents, token_pieces
from catena.llm.pieces import library_encoder
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

BPE = public_tokenizers.path("byte_bpe_50k.json")


def least(items, capacity):
    """The least number of sequences, by trying all."""

    @lru_cache(None)
    def go(rest):
        if not rest:
            return 0
        head, rest = rest[0], rest[1:]
        best = len(rest) + 1

        def fill(room, k, chosen):
            nonlocal best
            best = min(best, 1 + go(tuple(x for j, x in enumerate(rest) if j not in chosen)))
            for j in range(k, len(rest)):
                if rest[j] <= room and not (j > k and rest[j] == rest[j - 1]):
                    fill(room - rest[j], j + 1, chosen | {j})

        fill(capacity - head, 0, frozenset())
        return best

    return go(tuple(sorted(items, reverse=True)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_fixed_sets_are_part_of_an_optimum(items):
    counts = {k: items.count(k) for k in items}
    plan = Plan(counts, 20)
    placed = [k for bin_, n in plan.bins for _ in range(n) for k, c in bin_ for _ in range(c)]
    assert sorted(placed) == sorted(items)
    assert all(sum(k * c for k, c in bin_) <= 20 for bin_, _ in plan.bins)
    first = {k: 0 for k in counts}
    seen = 0
    for bin_, n in plan.bins:
        if seen >= plan.fixed:
            break
        for k, c in bin_:
            first[k] += c * n
        seen += n
    left = [k for k, n in counts.items() for _ in range(n - first[k])]
    assert plan.fixed + least(left, 20) == least(items, 20)


def test_many_alike_at_once():
    rng = random.Random(4)
    counts = {rng.randint(1, CAPACITY): rng.randint(1, 10**9) for _ in range(800)}
    plan = Plan(counts)
    total = sum(k * n for k, n in counts.items())
    bound = max(-(-total // CAPACITY), sum(n for k, n in counts.items() if 2 * k > CAPACITY))
    assert bound <= plan.sequences <= 1.03 * bound + 800
    assert len(plan.runs()) < 50_000


def test_cut():
    assert cut_lengths(5000, 2048) == [904, 2048, 2048] and cut_lengths(4096, 2048) == [2048, 2048] and cut_lengths(1) == [1] and cut_lengths(0) == []


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_documents(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(["the", "tion", "é", "<|endoftext|>", "\n", "x  y"], k=rng.choice([3, 40, 900, 3000])))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "a"), (102, "a"), (None, "null id"), (103, "z" * 30_000)]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, offset string, length int")
    got = pack_documents(df, BPE).collect()
    tok = Tokenizer.from_file(BPE)
    want = []
    for i, t in rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for k, n in enumerate(cut_lengths(len(ids))):
            want.append((-1 if i is None else i, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at += n
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    n = check_places(got, CAPACITY)
    # 33 full pieces, 22 over half a sequence that nothing large joins, 14 of which two fit: 62 is the optimum.
    assert n == 62
    assert pack_documents(df.limit(0), BPE).count() == 0
    assert [len(r.ids) == r.length for r in token_pieces(df.limit(5), BPE, ids=True).collect()].count(False) == 0


def test_one_hot_length_and_bad_lengths(spark):
    df = spark.range(5000).selectExpr("id doc_id", "0 piece", "if(id % 3 = 0, 700, id % 50 + 1) length")
    rows = pack(df, 1000).collect()
    assert len(rows) == 5000 and check_places(rows, 1000) == 1667  # one for each of 700
    for bad in ("0", "1001", "null"):
        with pytest.raises(ValueError):
            pack(df.selectExpr("doc_id", "piece", f"cast({bad} as int) length"), 1000)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB \u0131\u0130\u201c\u201d\u2019,.<\u0301\u0307\u00df\u00c9 \n\u00bd\u2167\u01c5"), max_size=24))
@example("\u201cMAL\u0130, \u0130DAR\u0130\u201d dedi \u0130.")
@example("Stra\u00dfe \u01c5abc \u00bd. \u0130, x\u0301, o'clock's end<|endoftext|>." + "a" * 100)
def test_marks_behind_letters(text):
    test_pieces_are_the_librarys.hypothesis.inner_test(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab  \n\t \x1c\x85́é'sΣ1!<|endoftext|>"), max_size=30) | st.text(max_size=20))
def test_pieces_are_the_librarys(text):
    for name, lead in (("byte_bpe_50k.json", " "), ("word_bpe_49k.json", "")):
        path = public_tokenizers.path(name)
        if name not in ENCODERS:
            ENCODERS[name] = library_encoder(path, lead), Tokenizer.from_file(path)
        mine, tok = ENCODERS[name]
        assert np.frombuffer(mine(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


ENCODERS: dict = {}
