"""Vector and sign-code column expressions (all JVM-side, no Python per row).

Code layout: a sign code of a ``dim``-dimensional vector is an
``array<bigint>`` of ``ceil(dim / 32)`` words. Each word holds 32 bits,
most significant bit first; a partial last word holds its bits in the low
positions, again most significant first. Bit = 1 unless the component is
negative, so zero, negative zero and NaN give 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BITS = 32


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def binarize(vec) -> Column:
    """H6: 0 for negative components, 1 otherwise (NaN is not < 0 in Spark)."""
    return F.transform(_c(vec), lambda x: F.when(x < 0, F.lit(0)).otherwise(F.lit(1)))


def pack_bits(bits) -> Column:
    """H7: pack a 0/1 array into 32-bit words, MSB first."""
    b = _c(bits)
    n_words = F.ceil(F.size(b) / F.lit(WORD_BITS)).cast("int")
    return F.when(F.size(b) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), n_words - 1),
            lambda w: F.aggregate(
                F.slice(b, w * WORD_BITS + 1, WORD_BITS),
                F.lit(0).cast("bigint"),
                lambda acc, x: acc * 2 + x.cast("bigint"),
            ),
        )
    )


def sign_code(vec) -> Column:
    """H6 + H7 in one pass: float vector -> packed sign code."""
    v = _c(vec)
    n_words = F.ceil(F.size(v) / F.lit(WORD_BITS)).cast("int")
    return F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), n_words - 1),
            lambda w: F.aggregate(
                F.slice(v, w * WORD_BITS + 1, WORD_BITS),
                F.lit(0).cast("bigint"),
                lambda acc, x: acc * 2 + F.when(x < 0, F.lit(0)).otherwise(F.lit(1)).cast("bigint"),
            ),
        )
    )


def unpack_signs(code, dim: int) -> Column:
    """H8: packed code -> array<double> of +1/-1 (bit 1 -> +1)."""
    c = _c(code)

    def bit(i):
        w = (i / WORD_BITS).cast("int")
        width = F.least(F.lit(WORD_BITS), F.lit(dim) - w * WORD_BITS)
        shift = width - 1 - (i - w * WORD_BITS)
        mask = F.pow(F.lit(2), shift).cast("bigint")
        return F.when(F.element_at(c, w + 1).bitwiseAND(mask) != 0, F.lit(1.0)).otherwise(F.lit(-1.0))

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), bit)


def inner_product(a, b) -> Column:
    """H9: sum of element-wise products, in double."""
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"),
        lambda acc, x: acc + x,
    )


def hamming(a, b) -> Column:
    """Number of differing bits between two packed codes."""
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")),
        F.lit(0).cast("bigint"),
        lambda acc, x: acc + x,
    )


def plus_minus_one(vec) -> Column:
    """Evaluation-mode sign code as floats: -1 for negative, +1 otherwise."""
    return F.transform(_c(vec), lambda x: F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0)))


def code_words(dim: int) -> int:
    if dim <= 0 or dim % 8:
        raise ValueError(f"vector dimension must be a positive multiple of 8, got {dim}")
    return (dim + WORD_BITS - 1) // WORD_BITS
