"""Substring dedup with difference-cover anchors.

Of a window of words (20) every word goes if the same window starts earlier.
Positions of a document modulo a period v (13) are anchors where the residue
is in a difference cover (0, 1, 3, 9): for any two positions there is a shift
below v that puts both on anchors. So two equal windows share equal anchor
windows of 20 - 12 = 8 words at the same place in both, and only these, at 4 in
13 positions, are hashed to find what repeats. From repeated anchors the
search extends to whole windows: those that hold one are hashed in full, and
the earliest of each hash is found.

Both rounds are one exchange each way. Scanning tasks dedupe their own hashes,
so that a passage in a third of all documents reaches its bucket once for each
block of a task, and send what is left in compressed blobs by hash bucket.
Buckets answer by document bucket, where the answers meet the texts again.
Anchor hashes may collide (a window too many is then hashed in full); whole
windows are told apart by 96 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catena.llm.common import free_worker_caches, lean_worker, saved, shuffle_partitions
from catena.llm.words import Words, chunks, spark_xxhash64

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Words of an anchor window.
ANCHOR = WINDOW - PERIOD + 1
#: Hashes that a task gathers before it sends them.
BLOCK = 600_000
_NO_ID = -(1 << 63)
_U = np.uint64


def _plane(a: np.ndarray) -> bytes:
    """An array's bytes, all first bytes first, which zstd compresses better."""
    return a.view(np.uint8).reshape(len(a), -1).T.tobytes()


def _unplane(raw: bytes, kind: str, n: int, at: int) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    got = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
    return np.ascontiguousarray(got).view(kind).reshape(n), at + n * size


def _pack(doc: np.ndarray, *arrays: np.ndarray) -> bytes:
    """Columns in one blob; doc as differences modulo 2^64."""
    step = np.diff(doc.view(_U), prepend=_U(0))
    raw = b"".join([len(doc).to_bytes(4, "little"), _plane(step), *map(_plane, arrays)])
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:4], "little"), 4, []
    for kind in ("u8", *kinds):
        a, at = _unplane(raw, kind, n, at)
        out.append(a)
    out[0] = np.cumsum(out[0], dtype=_U).view(np.int64)
    return out


def _rows(buckets: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _split(bucket: np.ndarray, doc: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
        at = order[a:b]
        yield int(bucket[a]), _pack(doc[at], *(x[at] for x in arrays))


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def _replies(doc: np.ndarray, pos: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order]
    yield from _split(np.mod(spark_xxhash64(doc), buckets), doc, pos)


def _anchor_blocks(hash_: np.ndarray, doc: np.ndarray, pos: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """One entry for each hash: whether its place has to be told, or the block knows already that it repeats."""
    if not len(hash_):
        return
    _, first, inverse, count = np.unique(hash_, return_index=True, return_inverse=True, return_counts=True)
    known = count[inverse] > 1
    at = np.sort(first)
    h = hash_[at]
    out = list(_split((h >> _U(40)).astype(np.int64) % buckets, doc[at], pos[at], known[at].astype(np.uint8), (h & _U(0xFFFFFFFF)).astype(np.uint32), (h >> _U(32) & _U(0xFF)).astype(np.uint8)))
    out += _known(doc[known], pos[known], buckets)
    yield _rows([b for b, _ in out], [x for _, x in out])


def _known(doc: np.ndarray, pos: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """Answers that need no bucket's look; they travel as replies do, and are marked by a negative bucket."""
    return [(-1 - b, blob) for b, blob in _replies(doc, pos, buckets)] if len(doc) else []


def _gather(blocks: Iterator[tuple[np.ndarray, ...]], send: Callable[..., Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    n = 0

    def taken() -> list[np.ndarray]:
        whole = [np.concatenate(x) for x in zip(*held)]
        held.clear()
        return whole

    for block in blocks:
        held.append(block)
        n += len(block[0])
        del block
        if n >= BLOCK:
            yield from send(*taken())
            n = 0
    if held:
        yield from send(*taken())


def _anchors(words: Words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text = words.of_text()
    pos = np.arange(len(text)) - words.first[text]
    cover = np.isin(np.arange(PERIOD), COVER)
    at = np.flatnonzero(cover[pos % PERIOD] & (pos + ANCHOR <= words.count[text]) & (words.count[text] >= WINDOW))
    return words.windows(at, ANCHOR), ids[text[at]], pos[at].astype(np.uint32)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Blobs of one bucket at a time; rows are sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append(blob)
    if held:
        yield now, held


def _exchange(rows: DataFrame, answer: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], buckets: int) -> DataFrame:
    """Send blobs to their buckets; each bucket's answer (doc, pos) comes back as blobs by document bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_caches()
        docs, places = [], []
        for bucket, blobs in _by_bucket(batches):
            if bucket < 0:
                yield _rows([-1 - bucket] * len(blobs), blobs)
                continue
            doc, pos = answer(blobs)
            docs.append(doc)
            places.append(pos)
            if sum(map(len, docs)) >= BLOCK:
                out = list(_replies(np.concatenate(docs), np.concatenate(places), buckets))
                yield _rows([b for b, _ in out], [x for _, x in out])
                docs, places = [], []
        if docs and (n := sum(map(len, docs))):
            out = list(_replies(np.concatenate(docs), np.concatenate(places), buckets))
            yield _rows([b for b, _ in out], [x for _, x in out])

    n = shuffle_partitions(rows.sparkSession)
    return saved(rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, blob binary"))


def _repeated_anchors(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    doc, pos, again, low, high = (np.concatenate(x) for x in zip(*(_unpack(b, "u4", "u1", "u4", "u1") for b in blobs)))
    _, inverse, count = np.unique(low | high.astype(_U) << _U(32), return_inverse=True, return_counts=True)
    tell = (count[inverse] > 1) & (again == 0)
    return doc[tell], pos[tell]


def _not_first(key: np.ndarray, low: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (key, low, doc, pos), and whether each place of it comes after its key's first (doc, pos)."""
    order = np.lexsort((pos, doc, low, key))
    key, low, doc, pos = key[order], low[order], doc[order], pos[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else np.empty(0, np.int64)
    return order, (doc != doc[at]) | (pos != pos[at])


def _later_windows(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    doc, pos, key, low = (np.concatenate(x) for x in zip(*(_unpack(b, "u4", "u8", "u4") for b in blobs)))
    order, later = _not_first(key, low, doc, pos)
    return doc[order][later], pos[order][later]


def _window_blocks(key: np.ndarray, low: np.ndarray, doc: np.ndarray, pos: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    if not len(key):
        return
    order, later = _not_first(key, low, doc, pos)
    key, low, doc, pos = key[order], low[order], doc[order], pos[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1])
    at = np.flatnonzero(keep)
    at = at[np.lexsort((pos[at], doc[at]))]
    out = list(_split((key[at] >> _U(20)).astype(np.int64) % buckets, doc[at], pos[at], key[at], low[at]))
    out += _known(doc[later], pos[later], buckets)
    yield _rows([b for b, _ in out], [x for _, x in out])


class _Marks:
    """Sorted places of the documents of one document bucket."""

    def __init__(self, blobs: list[bytes]):
        got = [_unpack(b, "u4") for b in blobs]
        doc = np.concatenate([g[0] for g in got]) if got else np.empty(0, np.int64)
        pos = np.concatenate([g[1] for g in got]) if got else np.empty(0, np.uint32)
        order = np.lexsort((pos, doc))
        self.doc, self.pos = doc[order], pos[order].astype(np.int64)

    def of(self, ids: np.ndarray) -> list[np.ndarray]:
        a, b = np.searchsorted(self.doc, ids), np.searchsorted(self.doc, ids, "right")
        return [self.pos[x:y] for x, y in zip(a, b)]


def _meet(docs: DataFrame, marks: DataFrame, buckets: int) -> DataFrame:
    """Documents and blobs of marks side by side: sorted by document bucket, blobs first. A column rest of docs is kept."""
    rest = [f for f in docs.schema.fields if f.name == "rest"]
    rows = docs.select(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(1).alias("kind"), "id", F.col("text").cast("binary").alias("blob"), *[f.name for f in rest])
    blobs = marks.select("bucket", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), "blob", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rest])
    return rows.unionByName(blobs).repartition(shuffle_partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "kind")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes], list[np.ndarray], list[pa.Array]]]:
    """(ids, texts, places of each, columns behind them) as rows of _meet come in."""
    now, held, marks = None, [], None
    for batch in batches:
        bucket, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(bucket, prepend=bucket[0] - 1) != 0) | (np.diff(kind, prepend=kind[0]) != 0)) if len(bucket) else []
        for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
            if bucket[a] != now:
                now, held, marks = bucket[a], [], None
            blobs = [x or b"" for x in batch.column(3).slice(a, b - a).to_pylist()]
            if kind[a] == 0:
                held += blobs
                continue
            marks = marks or _Marks(held)
            ids = batch.column(2).slice(a, b - a).to_numpy()
            yield ids, blobs, marks.of(ids), [c.slice(a, b - a) for c in batch.columns[4:]]


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept): the words that stay, joined by one space.

    A word stays unless it lies in a window of 20 consecutive words that also
    starts earlier: in a document of smaller id, or earlier in its own. All is
    judged on the input. Null, empty and short texts lose nothing. An id that
    is null is smaller than any other and comes back as null. Rows that share
    an id are one document for this: equal rows are treated alike and the first
    copy of a passage stays in all of them; of different texts a word goes
    where a window of either goes. An empty table gives an empty one. Other
    columns are not read; with carry all columns but the text are in a column
    rest, and a text that loses nothing is as it was.
    """
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest")] if carry else []
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *rest)
    buckets = shuffle_partitions(docs.sparkSession)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for a, words in chunks(_texts(batch, "text")):
                    yield _anchors(words, ids[a : a + len(words.count)])

        with lean_worker():
            yield from _gather(blocks(), lambda *x: _anchor_blocks(*x, buckets))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple[np.ndarray, ...]]:
            for ids, texts, marks, _ in _met(batches):
                some = [k for k, m in enumerate(marks) if len(m)]
                for a, words in chunks([texts[k] for k in some]):
                    starts = []
                    for j in range(len(words.count)):
                        near = np.zeros(max(0, int(words.count[j]) - WINDOW + 1) + 1, np.int32)
                        if len(near) > 1:
                            p = marks[some[a + j]]
                            np.add.at(near, np.clip(p - PERIOD + 1, 0, len(near) - 1), 1)
                            np.add.at(near, np.clip(p + 1, 0, len(near) - 1), -1)
                        starts.append(np.flatnonzero(np.cumsum(near[:-1]) > 0))
                    text = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
                    pos = np.concatenate(starts)
                    at = words.first[text] + pos
                    yield words.windows(at, WINDOW), (words.windows(at, WINDOW, 0x5851F42D4C957F2D) >> _U(32)).astype(np.uint32), ids[some][a:][text], pos.astype(np.uint32)

        with lean_worker():
            yield from _gather(blocks(), lambda *x: _window_blocks(*x, buckets))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker_caches()
        for ids, texts, marks, rest in _met(batches):
            n, removed, kept = [], [], []
            for text, places in zip(texts, marks):
                split = text.split()
                n.append(len(split))
                gone = 0
                if len(places):
                    edge = np.zeros(len(split) + 1, np.int32)
                    places = places[places < len(split)]
                    np.add.at(edge, places, 1)
                    np.add.at(edge, np.minimum(places + WINDOW, len(split)), -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    split = [split[k] for k in np.flatnonzero(stay)]
                    gone = n[-1] - len(split)
                removed.append(gone)
                kept.append(text if carry and not gone else b" ".join(split))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *rest], ["id", "n_words", "n_removed", "kept", "rest"][: 4 + len(rest)])

    plain = docs.select("id", "text")
    places = _exchange(plain.mapInArrow(anchors, "bucket int, blob binary"), _repeated_anchors, buckets)
    later = _exchange(_meet(plain, places, buckets).mapInArrow(windows, "bucket int, blob binary"), _later_windows, buckets)
    out = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    out = _meet(docs, later, buckets).mapInArrow(cut, T.StructType([*out.fields, *(docs.schema.fields[2:])]))
    return out.withColumn("id", F.when(F.col("id") != _NO_ID, F.col("id")))


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text that stays, in the columns of docs; a column n_chars follows the text. See removals for the cases.

    Texts that lose nothing are as they were, null ones empty.
    """
    found = removals(docs, id_col, text_col, carry=True)
    value = {c: F.col(f"rest.`{c}`") for c in docs.columns if c != text_col} | {text_col: F.col("kept")}
    if "n_chars" in value:
        value["n_chars"] = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    return found.select(*[value[c].alias(c) for c in docs.columns])
