"""Nucleotide expressions as columns."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the IUPAC letters and their complements
IUPAC = "ABCDGHKMNRSTUVWYabcdghkmnrstuvwy"
COMPLEMENT = "TVGHCDMKNYSAABWRtvghcdmknysaabwr"


def upper(seq: Column) -> Column:
    """a-z as A-Z; other letters stay."""
    return F.translate(seq, string.ascii_lowercase, string.ascii_uppercase)


def complement(seq: Column) -> Column:
    return F.translate(seq, IUPAC, COMPLEMENT)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def code(base: Column) -> Column:
    """A, C, G and T or U as 0 to 3, in either case; all else 4."""
    at = F.instr(F.lit("ACGTU"), F.upper(base))
    return F.when(F.length(base) != 1, F.lit(4)).when(at == 0, F.lit(4)).otherwise(F.least(at - 1, F.lit(3)))


def as_dna(text: Column) -> Column:
    """Any text as bases: ACGT by the code point of each character modulo 4."""
    one = F.array_join(F.transform(F.split(text, ""), lambda c: F.substring(F.lit("ACGT"), (F.ascii(c) % 4 + 1).cast("int"), F.lit(1))), "")
    # nearly all texts hold characters of a table only; the empty one is a single A as ever
    table = [chr(c) for c in range(1, 0x800)]
    known = F.translate(text, "".join(table), "".join("ACGT"[ord(c) % 4] for c in table))
    return F.when((text == "") | text.rlike(r"[^\x{1}-\x{7FF}]"), one).otherwise(known)


def hash_bits(key: Column, bits: int) -> Column:
    """An invertible mix of an integer of `bits` bits (56 at most), without overflow."""
    mask = F.lit((1 << bits) - 1)

    def up(x: Column, n: int) -> Column:  # masked before the shift, so nothing runs over
        return F.shiftleft(x.bitwiseAND(F.lit(((1 << bits) - 1) >> n)), n)

    def plus(*terms: Column) -> Column:
        total = terms[0]
        for t in terms[1:]:
            total = (total + t).bitwiseAND(mask)
        return total

    x = key.cast("long").bitwiseAND(mask)
    x = plus(mask - x, up(x, 21))
    x = x.bitwiseXOR(F.shiftright(x, 24))
    x = plus(x, up(x, 3), up(x, 8))
    x = x.bitwiseXOR(F.shiftright(x, 14))
    x = plus(x, up(x, 2), up(x, 4))
    x = x.bitwiseXOR(F.shiftright(x, 28))
    return plus(x, up(x, 31)) if bits > 31 else plus(x)


def name_stem(name: Column) -> Column:
    """A read name without the number of its mate."""
    return F.regexp_replace(name, "/[0-9]$", "")


M32 = (1 << 32) - 1


def hash32(key: Column) -> Column:
    """A mix of 32-bit integers, as a number from 0 to 2**32 - 1. The shifts are fixed values."""
    mask = F.lit(M32)
    # each step is bound to a variable: written out, its uses of the step before would double with every step
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    inverse = lambda y, n: mask - F.shiftleft(y, n).bitwiseAND(mask)
    x = key.cast("long").bitwiseAND(mask)
    x = bound(x, lambda y: (y + inverse(y, 15)).bitwiseAND(mask))
    x = bound(x, lambda y: y.bitwiseXOR(F.shiftright(y, 10)))
    x = bound(x, lambda y: (y + F.shiftleft(y, 3)).bitwiseAND(mask))
    x = bound(x, lambda y: y.bitwiseXOR(F.shiftright(y, 6)))
    x = bound(x, lambda y: (y + inverse(y, 11)).bitwiseAND(mask))
    return bound(x, lambda y: y.bitwiseXOR(F.shiftright(y, 16)))


def hash_text(text: Column) -> Column:
    """The polynomial hash of a text's UTF-8 bytes (base 31, bytes over 127 as negative), modulo 2**32."""
    digits = F.hex(text.cast("binary"))
    at = F.sequence(F.lit(1), F.greatest(F.length(digits) / 2, F.lit(1)).cast("int"))
    byte = lambda i: F.coalesce(F.conv(F.substr(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("long"), F.lit(0))
    return F.aggregate(at, F.lit(0).cast("long"), lambda h, i: (h * 31 + byte(i) - F.when(byte(i) > 127, 256).otherwise(0)).bitwiseAND(F.lit(M32)))


def query_seed(name: Column, length: Column, seed: int) -> Column:
    """The seed of a query's tie-breaking hashes, from its name (null: none) and length."""
    own = F.coalesce(hash_text(name), F.lit(0))
    return hash32(own.bitwiseXOR((hash32(length) + hash32(F.lit(seed))).bitwiseAND(F.lit(M32))))


def divergence(n_minimizers: Column, n_anchors: Column, span: Column) -> Column:
    """Estimated divergence of a chain: the log of minimizers to anchors by the k-mer's length; a chain with more
    anchors than minimizers counts by the inverse ratio."""
    return F.abs(F.ln(n_minimizers / n_anchors)) / span
