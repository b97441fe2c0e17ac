"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens. It begins with one state and an arc to itself for
each byte; the merges then apply a gadget each, in order. The gadget of
(u, v) -> w copies the state that u leads to, takes the arc v from the copy and
makes it the target of u, and gives every state that still has the arc u an arc
w to where v led before. What it accepts in the end are exactly the token
sequences that merging yields, one for each string.

By this construction a token leads to one state whatever comes before it, so a
state is named by its token, and the gadgets between the birth of two tokens
and the end can be followed backwards to tell whether an arc exists: a later
token's state began as that of its right part, before its own gadget; a later
token's arc was given where the arc of its left part was, after its gadget.
Arcs are looked up so the first time and then kept in a transition table,
instead of the 50,000 by 50,000 that the whole table would have.

Encoding a word follows the arcs that read it to its end; decoding emits the
arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catena.llm.common import worker_cache
from catena.llm.pieces import PieceEncoder, byte_letters

#: The byte-level pre-splitting pattern of the vocabulary's family.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the transition table before it begins anew.
ARCS = 1_000_000


class Automaton:
    """Of merges: label gives a token's bytes, born its rank (bytes: -1), parts what it was merged from."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.label = labels
        self.token = {}
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.gadget: dict[tuple[int, int], int] = {}
        for rank, (u, v, w) in enumerate(merges):
            self.gadget.setdefault((u, v), rank)
            if w not in self.born:
                self.born[w], self.parts[w] = rank, (u, v)
        for t, b in labels.items():
            if len(b) == 1 and t not in self.born:
                self.born[t] = -1
                self.token[b] = t
        for rank, (u, v, w) in enumerate(merges):
            # Its gadget gave no arc w if the state of u had no arc v at that time.
            if self.born[w] == rank and all(self.token.get(labels[t]) == t for t in (u, v)) and self._arc(u, v, rank - 1):
                self.token[labels[w]] = w
        #: By the first two bytes, the length of the longest token.
        self.longest: dict[bytes, int] = {}
        for b in self.token:
            self.longest[b[:2]] = max(len(b), self.longest.get(b[:2], 1))
        self.last = len(merges)
        self.arcs: dict[int, bool] = {}

    def _arc(self, a: int, x: int, when: int) -> bool:
        """Whether the state of a has the arc x after the gadgets up to when."""
        while True:
            gone = self.gadget.get((a, x))
            if gone is not None and gone <= when:
                return False
            ra, rx = self.born[a], self.born[x]
            if ra < 0 and rx < 0:
                return True
            if ra > rx:
                a, when = self.parts[a][1], ra - 1
            elif rx > ra:
                x, when = self.parts[x][0], rx
            else:  # one token twice: its second's left part was judged when its own state was young
                x, when = self.parts[x][0], rx

    def follows(self, a: int, x: int) -> bool:
        """Whether x may come next after a: one look into the transition table."""
        got = self.arcs.get(a << 32 | x)
        if got is None:
            if len(self.arcs) >= ARCS:
                self.arcs.clear()
            got = self.arcs[a << 32 | x] = self._arc(a, x, self.last)
        return got

    def encode(self, word: bytes) -> list[int]:
        """The one path that reads word: along the longest arc that exists, back where there is none.

        A place is left for good once no arc leads on from it, so that a word
        takes at most its length times that of the longest token.
        """
        token, longest, follows = self.token, self.longest, self.follows
        whole = token.get(word)
        if whole is not None:
            return [whole]
        size = len(word)
        path: list[int] = []
        ends: list[int] = []
        dead: set[tuple[int, int]] = set()
        begin, end = 0, min(size, longest.get(word[:2], 1))
        last = -1
        while begin < size:
            while end > begin:
                t = token.get(word[begin:end])
                if t is not None and (last < 0 or follows(last, t)) and (end, t) not in dead:
                    break
                end -= 1
            else:
                if not path:
                    raise ValueError("a byte without a token")
                dead.add((begin, path.pop()))
                end = ends.pop() - 1
                begin = ends[-1] if ends else 0
                last = path[-1] if path else -1
                continue
            path.append(t)
            ends.append(end)
            begin, last = end, t
            end = min(size, begin + longest.get(word[begin : begin + 2], 1))
        return path

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.label.__getitem__, ids))


class ByteLevelBPE:
    """Encoder and decoder of a byte-level tokenizers file without normalizer, prefix space or truncation."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        self._expect(spec, model)
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {s: i for s, i in model["vocab"].items() if s not in self.special}
        labels = {i: raw(s) for s, i in vocab.items()}
        merges = [(vocab[u], vocab[v], vocab[u + v]) for u, v in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        self.automaton = Automaton(labels, merges)
        self.label = labels | {i: s.encode() for s, i in self.special.items()}
        self.words = regex.compile(WORDS)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = PieceEncoder(lambda p: np.array(self.piece(p), "<u4").tobytes(), " ")

    @staticmethod
    def _expect(spec: dict, model: dict) -> None:
        pre = spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("not a plain byte-level BPE file")

    def piece(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for word in self.words.findall(part):
                    out += self.automaton.encode(word.encode())
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        return self.pieces(text)

    def decode(self, ids: bytes) -> str:
        got = b"".join(map(self.label.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return got.decode("utf-8", "replace")


@worker_cache
@lru_cache(maxsize=2)
def byte_level(path: str) -> ByteLevelBPE:
    """One automaton for each worker process and file."""
    return ByteLevelBPE(path)


def bpe_round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Encode each whole text and decode it again: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    With keep also ids (little-endian unsigned 32-bit) and decoded. Null texts
    count as empty, which have no tokens. Repeated rows and null ids come out
    as they came in; an empty table gives an empty one; other columns are not
    read.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_level(tokenizer)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            rows = []
            for ids in map(model.pieces, (t.as_py() for t in batch.column(1))):
                decoded = model.decode(ids)
                rows.append((len(ids) // 4, sha(ids), sha(decoded.encode()), *((ids, decoded) if keep else ())))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
            columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)
