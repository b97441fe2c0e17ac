import numpy as np
import public_tokenizers
import pytest
from catena.llm.bpe import Automaton, ByteLevelBPE, bpe_round_trip
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return ByteLevelBPE(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="abehtinos  \n'sléÉ1.!-=<|endoftext|>", max_size=60))
def test_same_as_library(both, text):
    mine, library = both
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(mine.encode(text), "<u4").tolist() == ids
    assert mine.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_runs_of_one_letter_and_the_vocabulary(both):
    mine, library = both
    for text in ["a" * n for n in range(1, 40)] + [" " * n + "x" for n in range(1, 40)] + ["=" * n for n in range(1, 70)] + list(library.get_vocab())[::50]:
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.randoms(use_true_random=False), st.text(alphabet="abc", min_size=1, max_size=14))
def test_any_merges(rng, word):
    """Against merging step by step, for random merge lists."""
    labels = {k: bytes([97 + k]) for k in range(3)}
    merges: list[tuple[int, int, int]] = []
    for _ in range(8):
        u, v = rng.choice(list(labels)), rng.choice(list(labels))
        label = labels[u] + labels[v]
        if label not in labels.values():
            merges.append((u, v, len(labels)))
            labels[len(labels)] = label
    ids = [b - 97 for b in word.encode()]
    for u, v, w in merges:
        k, out = 0, []
        while k < len(ids):
            if ids[k : k + 2] == [u, v]:
                out.append(w)
                k += 2
            else:
                out.append(ids[k])
                k += 1
        ids = out
    auto = Automaton(labels, merges)
    assert auto.encode(word.encode()) == ids and auto.decode(ids) == word.encode()
    assert all(auto.follows(a, b) for a, b in zip(ids, ids[1:]))


def test_documents(spark, both):
    mine, library = both
    texts = [None, "", "a", "a", "the  end\n", "<|endoftext|>x", "ö" * 20_000, " ".join(f"w{k}" for k in range(20_000))]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: (r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in bpe_round_trip(df, PATH, keep=True).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[k] == (len(ids), ids, t or "")
    assert bpe_round_trip(df.limit(0), PATH).count() == 0
