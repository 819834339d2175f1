"""Column functions that the built-in ones lack."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32, U64 = 1 << 32, 1 << 64


def affine_wrapping(x: Column, a: int, b: int, times: int = 1) -> Column:
    """x -> a * x + b modulo 2**64, applied `times` times, as DECIMAL(20, 0).

    A chain of affine maps is one affine map, whose two constants are known before the job starts, so a row costs the same
    whatever `times` is. x is any integer: of a negative one its residue counts, as in two's complement. The halves of x
    are multiplied one by one, so that every product fits in 38 digits.
    """
    scale, shift = 1, 0
    for _ in range(times):
        scale, shift = scale * a % U64, (shift * a + b) % U64
    number = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    residue = F.pmod(x.cast("decimal(38,0)"), number(U64)).cast("decimal(20,0)")
    high, low = F.floor(residue / number(U32)).cast("decimal(10,0)"), F.pmod(residue, number(U32)).cast("decimal(10,0)")
    carried = F.pmod(high * number(scale), number(U32)).cast("decimal(10,0)") * number(U32)
    return F.pmod(carried + low * number(scale) + number(shift), number(U64)).cast("decimal(20,0)")


def failure(kind: str | Column, msg: str | Column) -> Column:
    """An error value of a fallible chain."""
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(column(kind).cast("string").alias("kind"), column(msg).cast("string").alias("msg"))
