"""Column expressions over DNA: coding, complement, k-mers, sites, CIGARs, fragment ids."""

from __future__ import annotations

import re
import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FORWARD, REVERSE = 0, 1
#: IUPAC codes and their complements.
IUPAC, IUPAC_COMPLEMENT = "ACGTUMRWSYKVHDBN", "TGCAAKYWSRMBDHVN"
#: Restriction enzymes by name; ^ marks the cut.
ENZYMES = {"DpnII": "^GATC", "HindIII": "A^AGCTT", "NcoI": "C^CATGG", "NlaIII": "CATG^"}
_LETTERS = string.ascii_uppercase + string.ascii_lowercase
_FOLD = "".join("ACGT"[k % 26 % 4] for k in range(52))


def fold_text(text: Column) -> Column:
    """DNA from any text: letters alone, the i-th letter of the alphabet as ACGT[i mod 4]."""
    return F.translate(F.regexp_replace(text, "[^A-Za-z]", ""), _LETTERS, _FOLD)


def fold_sql(text: str) -> str:
    """fold_text in DuckDB's SQL."""
    return f"translate(regexp_replace({text}, '[^A-Za-z]', '', 'g'), '{_LETTERS}', '{_FOLD}')"


def encode(seq: Column) -> Column:
    """2-bit codes as digits: A 0, C 1, G 2, T 3, other bases 4, a gap 5."""
    return F.translate(F.regexp_replace(F.upper(seq), "[^ACGT-]", "N"), "ACGTN-", "012345")


def decode(codes: Column) -> Column:
    return F.translate(codes, "012345", "ACGTN-")


def reverse_complement(seq: Column) -> Column:
    """IUPAC-aware; U pairs as T."""
    return F.reverse(F.translate(F.upper(seq), IUPAC, IUPAC_COMPLEMENT))


def read_reverse_complement(seq: Column) -> Column:
    """Of a read, in which ambiguous bases count as A first."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "A"), "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement, null for one that is its own."""
    back = F.reverse(F.translate(kmer, "ACGT", "TGCA"))
    return F.when(kmer != back, F.least(kmer, back))


def kmer_hash(kmer: Column) -> Column:
    """The 2-bit number of a k-mer of up to 31 bases."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def parse_enzyme(spec: str) -> tuple[str, int]:
    """(motif, cut) of a specification such as C^CATGG; a palindrome of ACGT up to 6 bases with one cut mark."""
    spec = ENZYMES.get(spec, spec).upper()
    if spec.count("^") != 1:
        raise ValueError(f"{spec}: one ^ must mark the cut")
    motif = spec.replace("^", "")
    if not re.fullmatch("[ACGT]{1,6}", motif):
        raise ValueError(f"{spec}: 1 to 6 of A, C, G, T are asked for")
    if motif != motif[::-1].translate(str.maketrans("ACGT", "TGCA")):
        raise ValueError(f"{spec}: the motif isn't its own reverse complement")
    return motif, spec.index("^")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, even where body uses it for each element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def site_array(seq: Column, motif: str) -> Column:
    """0, each index of motif from 1 on (overlaps too), the length and the length plus 1."""
    m, word = len(motif), F.lit(motif.encode())

    def scan(raw: Column) -> Column:
        n = F.length(raw)
        hits = F.filter(F.sequence(F.lit(1), n - m), lambda i: F.substring(raw, i + 1, F.lit(m)) == word)
        return F.concat(F.array(F.lit(0)), F.when(n > m, hits).otherwise(F.array().cast("array<int>")), F.array(n, n + 1))

    return bound(seq.cast("binary"), scan)


def nearest_in(sites: Column, pos: Column) -> Column:
    """The site nearest to pos, the left one if two are; the last two entries are one interval."""
    left = F.array_max(F.filter(sites, lambda s: s <= pos))
    right = F.array_min(F.filter(sites, lambda s: s > pos))
    return F.when(right.isNull() | (pos - left <= right - pos), left).otherwise(right)


def nearby_in(sites: Column, pos: Column, low: Column, high: Column, within: int = 50) -> Column:
    """Sites within so many bases of pos and in [low, high]."""
    return F.filter(sites, lambda s: (F.abs(s - pos) <= within) & (s >= low) & (s <= high))


def cigar_ops(cigar: Column) -> Column:
    """array<struct<len:int,op:string>> of a CIGAR string."""
    lens = F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1)), lambda x: x.cast("int"))
    return F.arrays_zip(lens.alias("len"), F.regexp_extract_all(cigar, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1)).alias("op"))


def cigar_span(cigar: Column, ops: str) -> Column:
    """Bases under the named operations: MDN=X of the subject, MI=X of the query, SMI=X of the read in the record."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{ops}]"), F.lit(1)), F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))


def cigar_score(cigar: Column, match: int = 2, mismatch: int = 5, gap: int = 4) -> Column:
    """Matches less mismatches and gap bases; opening a gap is free."""
    return match * cigar_span(cigar, "=") - mismatch * cigar_span(cigar, "X") - gap * cigar_span(cigar, "ID")


def cigar_identity(cigar: Column, longest_gap: int | None = None) -> Column:
    """Matches in a hundred columns; gaps over longest_gap bases left out, if given. 0 for no columns."""
    columns = cigar_span(cigar, "=XID")
    if longest_gap is not None:
        every = F.regexp_extract_all(cigar, F.lit(r"(\d+)[ID]"), F.lit(1))
        columns = columns - F.aggregate(every, F.lit(0).cast("long"), lambda s, x: s + F.when(x.cast("long") > longest_gap, x.cast("long")).otherwise(0))
    return F.when(columns > 0, 100.0 * cigar_span(cigar, "=") / columns).otherwise(0.0)


def effective_identity(cigar: Column, longest_gap: int = 7, least: int = 50) -> Column:
    """cigar_identity without gaps of over longest_gap bases; 0 for fewer than least columns."""
    left_out = F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[ID]"), F.lit(1)), F.lit(0).cast("long"), lambda s, x: s + F.when(x.cast("long") > longest_gap, x.cast("long")).otherwise(0))
    return F.when(cigar_span(cigar, "=XID") - left_out < least, 0.0).otherwise(cigar_identity(cigar, longest_gap))


def gapped(cigar: Column, query: Column, subject: Column) -> Column:
    """struct<query, subject>: the aligned parts with a dash for each base that the other has alone; clips are not part of query."""
    side = lambda ops, seq: F.aggregate(
        cigar_ops(cigar),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.when(x["op"].isin("S", "H", "P"), acc).otherwise(
            F.struct(
                (acc["at"] + F.when(x["op"].isin(*ops), x["len"]).otherwise(0)).alias("at"),
                F.concat(acc["out"], F.when(x["op"].isin(*ops), F.substring(seq, acc["at"] + 1, x["len"])).otherwise(F.repeat(F.lit("-"), x["len"]))).alias("out"),
            )
        ),
        lambda acc: acc["out"],
    )
    return F.struct(side("MI=X", query).alias("query"), side("MDN=X", subject).alias("subject"))


def cigar_valid(cigar: Column, length: Column) -> Column:
    """Whether the operations on the query add up to the length of the read."""
    return cigar_span(cigar, "SMI=X") == length


def gap_penalty(gap: Column) -> Column:
    return F.when(gap == 0, 0).otherwise(4 + 2 * gap)


def overlap(b1: Column, e1: Column, b2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(b1, b2))


def flip(b: Column, e: Column, length: Column) -> tuple[Column, Column]:
    """An interval as seen from the other strand."""
    return length - e, length - b


def forward_start(flag: Column, cigar: Column, length: Column) -> Column:
    """Where a record's aligned part begins on the forward read: the left clip, or the right one if it is reversed."""
    clip = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(cigar, pattern, 1), F.lit("")).cast("int"), F.lit(0))
    return F.when(flag.bitwiseAND(16) > 0, clip(r"(\d+)[SH]$")).otherwise(clip(r"^(\d+)[SH]"))


def pad10(x: Column) -> Column:
    """Ten digits at least; longer numbers stay whole."""
    return F.lpad(x.cast("string"), F.greatest(F.lit(10), F.length(x.cast("string"))), F.lit("0"))


def fragment_id(read_id: Column, frag_id: Column, sid: Column, soff: Column) -> Column:
    return F.concat_ws(":", pad10(read_id), pad10(frag_id), pad10(sid), pad10(soff))


def parse_fragment_id(name: Column) -> Column:
    """struct of read name, read_id, frag_id, sid, soff from <read>_<id>."""
    part = lambda k: F.regexp_extract(name, r"^(.*)_(\d+):(\d+):(\d+):(\d+)$", k)
    return F.struct(part(1).alias("read"), *[part(k).cast("long").alias(n) for k, n in ((2, "read_id"), (3, "frag_id"), (4, "sid"), (5, "soff"))])


def split_collapsed(c: Column, sep: str) -> Column:
    """Parts between separators, empty ones left out."""
    return F.filter(F.split(c, re.escape(sep)), lambda x: x != "")


def unplaced(name: Column) -> Column:
    """Whether a contig's name says that it is unplaced, random or alternative."""
    return F.upper(name).rlike("UN|RANDOM|ALT")


#: Size suffixes; decimal ones, and binary ones with i.
_SUFFIX = {s: (1000**k, 1024**k) for k, s in enumerate(["", "K", "M", "G", "T", "P", "E"])}


def parse_size(text: str) -> int:
    """Bytes of 10g, 1.5M, 1KiB; decimal unless the suffix has an i."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d*)?)\s*([KMGTPE]?)(I?)B?\s*", text.upper())
    if not m or (m[3] and not m[2]):
        raise ValueError(f"{text!r} isn't a data size")
    return int(float(m[1]) * _SUFFIX[m[2]][bool(m[3])]) if "." in m[1] else int(m[1]) * _SUFFIX[m[2]][bool(m[3])]


def format_size(n: int) -> str:
    """Three digits and a decimal suffix."""
    for s, (unit, _) in reversed(_SUFFIX.items()):
        if n >= unit:
            return f"{n / unit:.3g}{s}B" if s else f"{n}B"
    return f"{n}B"
