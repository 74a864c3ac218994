"""Scalar expressions on bases, k-mers, counts and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
COMPLEMENT = "TGCA"
LARGEST = (1 << 32) - 1
COLOURS = {0: "gray", 1: "blue", 2: "red"}


def complement(base: Column) -> Column:
    return F.translate(base, BASES, COMPLEMENT)


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(complement(sequence))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, reverse_complement(kmer))


def is_canonical(kmer: Column) -> Column:
    return kmer <= reverse_complement(kmer)


def encode_base(base: Column) -> Column:
    """A, C, G, T in any case as 0 to 3; anything else is null."""
    at = F.instr(F.lit(BASES), F.upper(base)) - 1
    return F.when((F.length(base) == 1) & (at >= 0), at)


def decode_base(code: Column) -> Column:
    return F.when(code.between(0, 3), F.substring(F.lit(BASES), code + 1, F.lit(1)))


def successor(kmer: Column, base: Column) -> Column:
    return F.concat(F.substring(kmer, 2, 1 << 30), base)


def predecessor(kmer: Column, base: Column) -> Column:
    return F.concat(base, F.left(kmer, F.length(kmer) - 1))


def saturated(count: Column) -> Column:
    """Counts stop at the largest unsigned 32-bit number."""
    return F.least(count, F.lit(LARGEST))


def edge_bits(forward: list[Column], backward: list[Column]) -> Column:
    """The eight edge flags of a node in one byte; forward A is the highest bit."""
    flags = [F.when(c > 0, 1 << (7 - i)).otherwise(0) for i, c in enumerate([*forward, *backward])]
    return sum(flags[1:], flags[0])


def edge_flag(bits: Column, edge: int) -> Column:
    return F.shiftright(bits, 7 - edge).bitwiseAND(F.lit(1))


def error_rate(missing: Column, total: Column, k: int) -> Column:
    """Per-base error from the share of k-mers that are missing; NaN without k-mers."""
    share = missing.cast("double") / F.when(total > 0, total.cast("double"))
    return F.coalesce(F.lit(1.0) - F.pow(F.lit(1.0) - share, F.lit(1.0 / k)), F.lit(float("nan")))


def quality_value(error: Column) -> Column:
    """Phred scale; infinite where the error is zero."""
    return F.when(F.isnan(error), error).when(error <= 0, F.lit(float("inf"))).otherwise(F.lit(-10.0) * F.log10(error))


def colour_name(colour: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, name in COLOURS.items():
        out = F.when(colour == code, F.lit(name)).otherwise(out)
    return out


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LETTER_BASES = 2 * (BASES * 7)[:26]


def text_as_bases(text: Column) -> Column:
    """Letters become bases by a fixed table, blanks vanish, anything else is N."""
    return F.translate(F.regexp_replace(F.replace(text, F.lit(" "), F.lit("")), "[^A-Za-z]", "#"), LETTERS + "#", LETTER_BASES + "N")


def letters_as_bases(text: Column) -> Column:
    """Letters become bases by the same table; everything else vanishes, so a text is one run."""
    return F.translate(F.regexp_replace(text, "[^A-Za-z]", ""), LETTERS, LETTER_BASES)


def substituted(sequence: Column, first: int, step: int) -> Column:
    """The base at ``first`` (from 0), and every ``step`` bases after it, becomes the next one in A, C, G, T, A."""
    rest = F.substring(sequence, first + 1, 1 << 30)
    pieces = F.transform(
        F.sequence(F.lit(0), F.length(rest) - 1, F.lit(step)), lambda at: F.concat(F.translate(F.substring(rest, at + 1, F.lit(1)), BASES, BASES[1:] + BASES[0]), F.substring(rest, at + 2, F.lit(step - 1)))
    )
    return F.when(F.length(rest) > 0, F.concat(F.left(sequence, F.lit(first)), F.array_join(pieces, ""))).otherwise(sequence)
