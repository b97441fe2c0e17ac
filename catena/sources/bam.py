"""BAM records: BGZF blocks and the binary record layout of the public SAM specification."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: CIGAR operations and base codes in the order of their numbers, and the empty block that ends a file.
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
SCHEMA = "qname string, flag int, rname string, pos int, mapq int, cigar string, seq string, qual string, tags map<string,bigint>"
_INT = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I"}
_WIDTH = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}


def inflate(data: bytes) -> bytes:
    """The content of all gzip members, one after the other."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        data = d.unused_data
    return b"".join(out)


def deflate(raw: bytes, size: int = 65_280) -> bytes:
    """BGZF: gzip members of at most size bytes of content, each with its own length in an extra field, and the end."""
    out = []
    for a in range(0, len(raw), size):
        part = raw[a : a + size]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out.append(struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out) + EOF


def _tags(raw: bytes) -> dict[str, int]:
    """Integer tags; others are skipped."""
    at, out = 0, {}
    while at < len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in _INT:
            out[name] = struct.unpack_from("<" + _INT[kind], raw, at)[0]
        if kind in "ZH":
            at = raw.index(0, at) + 1
        elif kind == "B":
            at += 5 + _WIDTH[chr(raw[at])] * struct.unpack_from("<I", raw, at + 1)[0]
        else:
            at += _WIDTH[kind]
    return out


def records(data: bytes) -> Iterator[tuple]:
    """Records of a BAM file as tuples of SCHEMA; positions count from 1."""
    raw = inflate(data)
    if raw[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", raw, 4)[0]
    n, names = struct.unpack_from("<i", raw, at)[0], []
    at += 4
    for _ in range(n):
        size = struct.unpack_from("<i", raw, at)[0]
        names.append(raw[at + 4 : at + 3 + size].decode())
        at += 8 + size
    while at < len(raw):
        size, ref, pos, name, mapq, _, ops, flag, length = struct.unpack_from("<iiiBBHHHi", raw, at)
        end, p = at + 4 + size, at + 36
        qname = raw[p : p + name - 1].decode()
        p += name
        cigar = "".join(f"{c >> 4}{OPS[c & 15]}" for c in struct.unpack_from(f"<{ops}I", raw, p)) or "*"
        p += 4 * ops
        seq = "".join(BASES[raw[p + k // 2] >> (0 if k % 2 else 4) & 15] for k in range(length)) or "*"
        p += (length + 1) // 2
        qual = raw[p : p + length]
        yield qname, flag, names[ref] if ref >= 0 else "*", pos + 1, mapq, cigar, seq, "*" if not qual or qual[0] == 255 else bytes(q + 33 for q in qual).decode(), _tags(raw[p + length : end])
        at = end


def bam_bytes(header: str, contigs: list[tuple[str, int]], rows: Iterable[tuple]) -> bytes:
    """A BAM file of rows as records gives them."""
    import re

    text = header.encode()
    out = [b"BAM\1", struct.pack("<i", len(text)), text, struct.pack("<i", len(contigs))]
    number = {"*": -1}
    for k, (name, length) in enumerate(contigs):
        number[name] = k
        out.append(struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length))
    for qname, flag, rname, pos, mapq, cigar, seq, qual, tags in rows:
        ops = [(int(n), op) for n, op in re.findall(r"(\d+)(\D)", "" if cigar == "*" else cigar)]
        span = sum(n for n, op in ops if op in "MDN=X") or 1
        bases = "" if seq == "*" else seq
        codes = [BASES.index(c) if c in BASES else 15 for c in bases.upper()] + [0] * (len(bases) % 2)
        body = struct.pack("<iiBBHHHiiii", number[rname], pos - 1, len(qname) + 1, mapq, _bin(pos - 1, pos - 1 + span), len(ops), flag, len(bases), -1, -1, 0)
        body += qname.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *(n << 4 | OPS.index(op) for n, op in ops))
        body += bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2])) + (b"\xff" * len(bases) if qual == "*" else bytes(ord(c) - 33 for c in qual))
        body += b"".join(t.encode() + b"i" + struct.pack("<i", v) for t, v in (tags or {}).items())
        out.append(struct.pack("<i", len(body)) + body)
    return deflate(b"".join(out))


def _bin(begin: int, end: int) -> int:
    """The smallest bin of the standard index that holds [begin, end)."""
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == (end - 1) >> shift:
            return first + (begin >> shift)
    return 0


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Records of BAM files, a file to a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            for content in pdf["content"]:
                rows = list(records(content))
                for a in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[a : a + 10_000], columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)
