import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from catena.llm.token_table import checksums, read_tokens, write_tokens
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip(spark, tmp_path):
    texts = [None, "", "Hello  World", "É é İ ß Σς", "a" * 5000, " ".join(f"Wort{k % 900}" for k in range(9000)), "<|endoftext|> x", "same", "same"]
    rows = [((k * 37) % 101 - 20, t, 1) for k, t in enumerate(texts * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, file int").repartition(5)
    path = f"file://{tmp_path}/t"
    write_tokens(df, path, PATH, 1)
    tok = Tokenizer.from_file(PATH)
    want, start = [], 0
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, ids))
        start += len(ids)
    got = sorted(read_tokens(spark, path).collect())
    assert [(r.doc_id, r.start, r.ids) for r in got] == want
    sums = sorted(checksums(spark, path).collect())
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in sums] == [(i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, s, x in want]
    files = sorted((tmp_path / "t/tokens").glob("*.parquet"))
    column = pq.ParquetFile(files[0]).metadata.row_group(0).column(4)
    assert column.has_offset_index and column.has_column_index
    assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(column.encodings)
    assert "ids" not in read_tokens(spark, path, ids=False).columns


def test_repeats_nulls_empty(spark, tmp_path):
    schema = "doc_id long, text string"
    write_tokens(spark.createDataFrame([], schema), f"file://{tmp_path}/e", PATH, 1)
    assert checksums(spark, f"file://{tmp_path}/e").count() == 0
    write_tokens(spark.createDataFrame([(2, "a"), (2, "a"), (None, "b c")], schema), f"file://{tmp_path}/r", PATH, 1)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.start, len(r.ids)) for r in read_tokens(spark, f"file://{tmp_path}/r").collect())
    assert got == [(-1, 0, 3), (2, 3, 2), (2, 5, 2)]
