"""Language ID by bitmask n-gram filters.

Each language has a Bloom filter of the n-grams that make up most of its
text. The filters are bit-sliced: they share their positions, and a position
holds one bit for each language, so one look for each hash and one AND return
all the languages that contain an n-gram. A text's popcounts by language,
corrected for each filter's false positives, decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catena.llm.common import Scratch, lean_worker

#: Bytes of an n-gram.
N = 4
#: Positions of the filters, 2^20, and hashes of an n-gram.
BITS = 20
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77)
#: Share of a language's n-grams, by frequency, that its filter has to cover.
COVER = 0.95
#: The bound of the training sample: documents of each language, of any length.
SAMPLE_DOCS = 1200
UNDETERMINED = "und"
#: Letters, and other numbers, which Python counts as word characters.
_WORD = re.compile(r"[^\W\d_]+")
_PAD = b" " * N


def _normal(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def has_letter(text: str) -> bool:
    """Whether a character is of a category L."""
    return any(any(map(str.isalpha, m.group())) for m in _WORD.finditer(text))


def _grams(data: bytes) -> np.ndarray:
    d = np.frombuffer(data, np.uint8).astype(np.uint32)
    out = d[: -N + 1].copy()
    for k in range(1, N):
        out |= d[k : len(d) - N + 1 + k] << np.uint32(8 * k)
    return out


class Counts:
    """Texts counted one by one: how many, and their distinct n-grams with counts, which are all that is held."""

    def __init__(self) -> None:
        self.texts, self.grams, self.counts = 0, np.empty(0, np.uint32), np.empty(0, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        self.texts += 1
        self.held.append(_grams(_PAD + _normal(text) + _PAD))
        self.size += len(self.held[-1])
        if self.size > 1 << 22:
            self.merge()

    def merge(self) -> None:
        if self.held:
            own, often = np.unique(np.concatenate(self.held), return_counts=True)
            both, where = np.unique(np.concatenate((self.grams, own)), return_inverse=True)
            self.counts = np.bincount(where, np.concatenate((self.counts, often)), len(both)).astype(np.int64)
            self.grams, self.held, self.size = both, [], 0


@dataclass
class Model:
    """languages, the most frequent in training first; masks[w][p] holds 64 languages' bits of position p; fp, false-positive rates."""

    languages: list[str]
    masks: np.ndarray
    fp: np.ndarray

    @classmethod
    def train(cls, texts: Iterable[tuple[str, str]]) -> Model:
        """Of (language, text), read once."""
        seen: dict[str, Counts] = {}
        for language, text in texts:
            seen.setdefault(language, Counts()).add(text)
        for own in seen.values():
            own.merge()
        filters = {}
        for language, own in seen.items():
            order = np.argsort(-own.counts, kind="stable")
            need = np.searchsorted(np.cumsum(own.counts[order]), COVER * own.counts.sum()) + 1
            filters[language] = np.zeros(1 << BITS, bool)
            for m in MULTIPLIERS:
                filters[language][(own.grams[order[:need]] * np.uint32(m)) >> np.uint32(32 - BITS)] = True
        return cls.of({k: own.texts for k, own in seen.items()}, filters)

    @classmethod
    def of(cls, texts: dict[str, int], filters: dict[str, np.ndarray]) -> Model:
        """Of the number of texts and the filter, a boolean for each position, of each language."""
        languages = sorted(texts, key=lambda k: (-texts[k], k))
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        masks = np.zeros((max(1, -(-len(languages) // 64)), 1 << BITS), kind)
        fill = np.zeros(len(languages))
        for k, language in enumerate(languages):
            bit = kind(1 << k % 64)
            masks[k // 64, filters[language]] |= bit
            fill[k] = np.count_nonzero(masks[k // 64] & bit) / (1 << BITS)
        return cls(languages, masks, fill ** len(MULTIPLIERS))

    def counts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each normal text, its n-grams, and how many of them each language contains."""
        data = b"".join(t + _PAD for t in texts) + _PAD
        grams = _grams(data)
        # The n-grams that begin in a text or right behind it; later ones would reach into the next text.
        sizes = np.array([len(t) + 1 for t in texts])
        own = np.zeros(len(data), bool)
        begins = np.cumsum(sizes + N - 1) - (sizes + N - 1)
        owner = np.repeat(np.arange(len(texts)), sizes)
        own[np.arange(len(owner)) + (begins - np.cumsum(sizes) + sizes)[owner]] = True
        grams = grams[own[: len(grams)]]
        at = [(grams * np.uint32(m)) >> np.uint32(32 - BITS) for m in MULTIPLIERS]
        total, out = sizes, np.zeros((len(texts), len(self.languages)))
        for w, masks in enumerate(self.masks):
            found = masks[at[0]]
            for p in at[1:]:
                found &= masks[p]
            names = self.languages[64 * w : 64 * w + 64]
            for b in range(0, len(names), 8):
                # Eight languages' bits at a time: how often each of the 256 patterns comes, then its popcounts.
                pattern = (found >> found.dtype.type(b)).astype(np.uint8)
                seen = np.bincount(owner * 256 + pattern, minlength=256 * len(texts)).reshape(-1, 256)
                bits = (np.arange(256)[:, None] >> np.arange(min(8, len(names) - b))) & 1
                out[:, 64 * w + b : 64 * w + b + bits.shape[1]] = seen @ bits
        return total, out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        if not self.languages:
            return out
        some = [k for k, t in enumerate(texts) if t and has_letter(t)]
        a = 0
        while a < len(some):
            part, size = [], 0
            b = a
            while b < len(some) and (not size or size < 1 << 20):
                part.append(_normal(texts[some[b]]))
                size += len(part[-1])
                b += 1
            total, seen = self.counts(part)
            true = np.clip((seen - total[:, None] * self.fp) / (1 - self.fp), 0, None)
            best = true.argmax(axis=1)
            share = true.max(axis=1) / np.maximum(true.sum(axis=1), 1e-9)
            for k, which, score in zip(some[a:b], best, share):
                out[k] = (self.languages[which], float(min(1.0, score)))
            a = b
        return out


#: Distinct n-grams of one language that a task holds before it passes their counts on.
HELD_GRAMS = 1 << 20


def _fit_whole(rows: DataFrame, texts: dict[str, int]) -> Model:
    """Model.train of all rows (l, t), counted where they are; what the driver gets follows the languages."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counts] = {}

        def given(language: str) -> pa.RecordBatch:
            own = seen.pop(language)
            own.merge()
            return pa.RecordBatch.from_arrays([pa.array([language] * len(own.grams), pa.string()), pa.array(own.grams.astype(np.int64)), pa.array(own.counts)], ["l", "gram", "n"])

        for batch in batches:
            for language, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = seen.setdefault(language, Counts())
                own.add(text)
                if len(own.grams) > HELD_GRAMS:
                    yield given(language)
        for language in list(seen):
            yield given(language)

    with Scratch(rows.sparkSession) as own:
        grams = own.saved(rows.select("l", "t").mapInArrow(counted, "l string, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n")))
        # The most frequent n-grams up to COVER; of equally frequent ones the smaller first. Sums run over distinct counts, not over n-grams.
        by = grams.groupBy("l", "n").agg(F.count(F.lit(1)).alias("k"))
        upto = by.withColumn("sum", F.sum(F.col("n") * F.col("k")).over(Window.partitionBy("l").orderBy(F.desc("n")))).withColumn("all", F.sum(F.col("n") * F.col("k")).over(Window.partitionBy("l")))
        last = upto.where(F.col("sum") >= COVER * F.col("all")).groupBy("l").agg(F.max_by(F.struct("n", "k", "sum", "all"), "n").alias("x")).select("l", "x.*").collect()
        need = {r["l"]: -int(-(COVER * r["all"] - (r["sum"] - r["n"] * r["k"])) // r["n"]) for r in last}
        least = rows.sparkSession.createDataFrame([(r["l"], r["n"]) for r in last], "l string, least long")
        tied = grams.join(F.broadcast(least), "l").where("n = least")
        top = F.shiftright("gram", 16)
        upper: dict[str, int] = {}
        for r in sorted(tied.groupBy("l", top.alias("top")).count().collect(), key=lambda r: (r["l"], r["top"])):
            if r["l"] not in upper:
                if need[r["l"]] <= r["count"]:
                    upper[r["l"]] = r["top"]
                else:
                    need[r["l"]] -= r["count"]
        tops = rows.sparkSession.createDataFrame(list(upper.items()), "l string, top long")
        lower: dict[str, list[int]] = {}
        for r in tied.join(F.broadcast(tops), "l").where(top == F.col("top")).select("l", "gram").collect():  # 65,536 of a language at most
            lower.setdefault(r["l"], []).append(r["gram"])
        ends = rows.sparkSession.createDataFrame([(r["l"], r["n"], sorted(lower[r["l"]])[max(1, need[r["l"]]) - 1]) for r in last], "l string, least long, upto long")
        chosen = grams.join(F.broadcast(ends), "l").where("n > least or n = least and gram <= upto")
        low, high = F.col("gram").bitwiseAND(0xFFFF), F.shiftright("gram", 16)
        # The low 32 bits of a product, without a larger one than a long holds.
        product = lambda m: (F.shiftleft((high * F.lit(m).cast("long")).bitwiseAND(0xFFFF), 16) + low * F.lit(m).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
        at = chosen.select("l", F.explode(F.array(*[F.shiftright(product(m), 32 - BITS) for m in MULTIPLIERS])).alias("at"))
        bits = at.groupBy("l", F.shiftright("at", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND((1 << 15) - 1)).alias("bits"))
        filters = {k: np.zeros(1 << BITS, bool) for k in texts}
        for r in bits.collect():
            filters[r["l"]][r["bucket"] << 15 : r["bucket"] + 1 << 15] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
    return Model.of(texts, filters)


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample: int | None = SAMPLE_DOCS) -> Model:
    """Train on about sample documents of each label, drawn by a hash of the id from the rows where learn holds; on all of them if sample is None."""
    rows = docs.where(learn & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("l"))
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    if not counts:
        return Model.train([])
    if sample is None:
        return _fit_whole(rows, counts)
    draw = F.pmod(F.xxhash64("i", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(sample / n))])
    taken = dict.fromkeys(counts, 0)

    def drawn() -> Iterator[tuple[str, str]]:
        # About sample rows of a label are expected; of labels with many alike hashes (one id again and again) no more than twice as many are taken.
        for r in rows.where(draw < rate[F.col("l")]).select("l", "t").toLocalIterator():
            taken[r["l"]] += 1
            if taken[r["l"]] <= 2 * sample:
                yield r["l"], r["t"]

    return Model.train(drawn())


def identify(docs: DataFrame, model: Model, text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score.

    und and 0 for a null text or one without a letter, or if nothing was
    learned; else a learned language, the most frequent one in ties. The score
    is the language's share of all languages' corrected popcounts. Whole texts
    are read. Columns of docs named as in into are replaced; others pass
    through, in any number and of any name. Repeated rows are scored alike; an
    empty table gives an empty one.
    """
    docs = docs.drop(*into)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: 2^20 positions

    @F.pandas_udf("lang string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with lean_worker():
            for texts in batches:
                yield pd.DataFrame(shared.value.predict([None if t is None or t != t else t for t in texts.tolist()]), columns=["lang", "score"])

    found = docs.withColumn("_lid", scored(F.col(text_col).cast("string")))
    return found.withColumn(into[0], F.col("_lid.lang")).withColumn(into[1], F.col("_lid.score")).drop("_lid")


def train_rows(id_col: str = "doc_id") -> Column:
    """Rows that may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string")) % 3 != 1
