"""Arithmetic of arrays as Spark columns: wrapping integers, IEEE 754 floats, NumPy's NaN rules.

A column never holds null as a value. Spark's ANSI mode raises on overflow and division by zero, and
its NaN equals itself and exceeds infinity; the functions here give what NumPy gives, inside
whole-stage code generation.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..meta import spark_type

NAN, INF = float("nan"), float("inf")


def as_type(c: Column, dtype) -> Column:
    return c.cast(spark_type(dtype))


def literal(value, dtype) -> Column:
    dtype = np.dtype(dtype)
    if dtype.kind == "c":
        part = "float" if dtype.itemsize == 8 else "double"
        value = complex(value)
        return F.struct(F.lit(value.real).cast(part).alias("re"), F.lit(value.imag).cast(part).alias("im"))
    if dtype.kind == "f":
        return as_type(F.lit(float(dtype.type(value))), dtype)
    if dtype.kind == "b":
        return F.lit(bool(value))
    number = int(dtype.type(value))
    return as_type(F.lit(str(number)) if abs(number) >= 1 << 63 else F.lit(number), dtype)


def wrap(c: Column, dtype) -> Column:
    """An integer of any width to ``dtype``, modulo its range."""
    bits, signed = 8 * np.dtype(dtype).itemsize, np.dtype(dtype).kind == "i"
    if bits == 64:
        span = F.lit(str(1 << 64)).cast("decimal(38,0)")
        low = F.pmod(c.cast("decimal(38,0)"), span)
        if not signed:
            return low.cast("decimal(20,0)")
        half = F.lit(str(1 << 63)).cast("decimal(38,0)")
        return F.when(low >= half, low - span).otherwise(low).cast("long")
    c = c.cast("long").bitwiseAND(F.lit((1 << bits) - 1))
    if signed:
        c = c.bitwiseXOR(F.lit(1 << (bits - 1))) - F.lit(1 << (bits - 1))
    return as_type(c, dtype)


def cast(c: Column, old, new) -> Column:
    """As ndarray.astype."""
    old, new = np.dtype(old), np.dtype(new)
    if old == new:
        return c
    if new.kind == "c":
        part = "float" if new.itemsize == 8 else "double"
        re, im = (c["re"], c["im"]) if old.kind == "c" else (cast(c, old, "float64"), F.lit(0.0))
        return F.struct(re.cast(part).alias("re"), im.cast(part).alias("im"))
    if old.kind == "c":
        return cast(c["re"], "float32" if old.itemsize == 8 else "float64", new)
    if new.kind == "b":
        return (c != 0) if old.kind != "f" else (F.isnan(c) | (c != 0))
    if old.kind == "b":
        return as_type(c.cast("int"), new)
    if new.kind == "f":
        return as_type(c, new)
    if old.kind == "f":
        # Out of range, infinite and NaN: what 64-bit conversion gives on common machines.
        bad = F.isnan(c) | (F.abs(c) >= 2.0**63)
        whole = F.when(bad, F.lit(-(1 << 63))).otherwise(F.when(bad, F.lit(0.0)).otherwise(c).cast("double").cast("long"))
        return wrap(whole, new)
    if np.can_cast(old, new):
        return as_type(c, new)
    return wrap(wrap(c, np.int64) if old == np.uint64 else c, new)


def _safe(kind: str, a: Column, b: Column, dtype) -> Column:
    ops = {"+": (F.try_add, lambda x, y: x + y), "-": (F.try_subtract, lambda x, y: x - y), "*": (F.try_multiply, lambda x, y: x * y)}
    attempt, plain = ops[kind]
    dtype = np.dtype(dtype)
    if dtype.kind == "f":
        return plain(a, b)
    if dtype == np.int64:
        wide = [x.cast("decimal(19,0)" if kind == "*" else "decimal(38,0)") for x in (a, b)]
        return F.coalesce(attempt(a, b), wrap(plain(*wide), dtype))
    if dtype == np.uint64:
        if kind == "*":  # by halves, so that no product exceeds 38 digits
            half = F.lit(str(1 << 32)).cast("decimal(20,0)")
            low, high = F.pmod(b, half).cast("decimal(18,0)"), F.floor(b / half).cast("decimal(18,0)")
            upper = wrap(a * high, dtype).cast("decimal(38,0)")
            return wrap(F.pmod(upper, half.cast("decimal(38,0)")) * half.cast("decimal(18,0)") + (a * low).cast("decimal(38,0)"), dtype)
        return wrap(plain(a.cast("decimal(38,0)"), b.cast("decimal(38,0)")), dtype)
    return wrap(plain(a.cast("long"), b.cast("long")), dtype)


def add(a, b, dtype):
    return _safe("+", a, b, dtype)


def subtract(a, b, dtype):
    return _safe("-", a, b, dtype)


def multiply(a, b, dtype):
    return _safe("*", a, b, dtype)


def negative(a, dtype):
    dtype = np.dtype(dtype)
    return -a if dtype.kind == "f" else subtract(as_type(F.lit(0), dtype), a, dtype)


def absolute(a, dtype):
    dtype = np.dtype(dtype)
    if dtype.kind in "u":
        return a
    return F.abs(a) if dtype.kind == "f" else F.when(a < 0, negative(a, dtype)).otherwise(a)


def signbit(a, dtype):
    # Comparisons lose the sign of zero; the text of a number keeps it. Java prints no sign for NaN.
    return a.cast("string").startswith("-") if np.dtype(dtype).kind == "f" else a < 0


def divide(a, b, dtype):
    sign = F.when(signbit(a, dtype) != signbit(b, dtype), F.lit(-INF)).otherwise(F.lit(INF))
    by_zero = F.when(a == 0, F.lit(NAN)).otherwise(sign)
    out = F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).when(b == 0, by_zero).otherwise(F.try_divide(a.cast("double"), b.cast("double")))
    return as_type(out, dtype)


def remainder(a, b, dtype):
    dtype = np.dtype(dtype)
    if dtype.kind == "f":
        r = F.try_mod(a, b)
        fixed = F.when((r != 0) & ((r < 0) != (b < 0)), r + b).when(r == 0, F.when(signbit(b, dtype), F.lit(-0.0)).otherwise(F.lit(0.0))).otherwise(r)
        finite = F.when(F.abs(b) == INF, F.when((a == 0) | ((a < 0) == (b < 0)), F.when((a == 0), F.when(signbit(b, dtype), F.lit(-0.0)).otherwise(F.lit(0.0))).otherwise(a)).otherwise(b)).otherwise(fixed)
        return as_type(F.when(F.isnan(a) | F.isnan(b) | (b == 0) | (F.abs(a) == INF), F.lit(NAN)).otherwise(finite), dtype)
    r = F.try_mod(a, b)
    return as_type(F.when(b == 0, F.lit(0)).when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r), dtype)


def _rounded(a, dtype, how):
    """floor, ceil and the like, past which large, infinite and NaN values go unchanged."""
    if np.dtype(dtype).kind != "f":
        return a
    small = F.when(F.isnan(a) | (F.abs(a) >= 2.0**53), F.lit(0.0)).otherwise(a)
    out = as_type(how(small), dtype)
    out = F.when((out == 0) & signbit(a, dtype), as_type(F.lit(-0.0), dtype)).otherwise(out)
    return F.when(F.isnan(a) | (F.abs(a) >= 2.0**53), a).otherwise(out)


def floor(a, dtype):
    return _rounded(a, dtype, F.floor)


def ceil(a, dtype):
    return _rounded(a, dtype, F.ceil)


def trunc(a, dtype):
    return _rounded(a, dtype, lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)))


def round_(a, dtype):
    return as_type(F.rint(a), dtype) if np.dtype(dtype).kind == "f" else a


def floor_divide(a, b, dtype):
    dtype = np.dtype(dtype)
    if dtype.kind == "f":
        # From the exact remainder, as NumPy does: the quotient alone may round up to the next integer.
        q = divide(a - remainder(a, b, dtype), b, dtype)
        f = floor(q, dtype)
        near = F.when(q - f > 0.5, f + 1).otherwise(f)
        by_inf = F.when((a == 0) | ((a < 0) == (b < 0)), F.lit(0.0)).otherwise(F.lit(-1.0))
        return as_type(F.when(b == 0, divide(a, b, dtype)).when(F.isnan(a) | F.isnan(b) | (F.abs(a) == INF), F.lit(NAN)).when(F.abs(b) == INF, by_inf).otherwise(near), dtype)
    wide_a, wide_b = a.cast("long"), b.cast("long")
    beyond = (wide_b == 0) | (wide_a == F.lit(-(1 << 63))) & (wide_b == -1)
    safe = F.when(beyond, F.lit(1).cast("long")).otherwise(wide_b)
    quotient = F.call_function("div", F.when(beyond, F.lit(0).cast("long")).otherwise(wide_a), safe)
    rest = F.try_mod(wide_a, safe)
    lower = F.when((rest != 0) & ((wide_a < 0) != (wide_b < 0)), quotient - 1).otherwise(quotient)
    return wrap(F.when(wide_b == 0, F.lit(0).cast("long")).when(beyond, wide_a).otherwise(lower), dtype)


def equal(a, b, kind="f"):
    return (a == b) & ~F.isnan(a) if kind == "f" else a == b


def compare(op, a, b, kind="f"):
    out = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return out & ~F.isnan(a) & ~F.isnan(b) if kind == "f" else out


def minimum(a, b, dtype):
    if np.dtype(dtype).kind != "f":
        return F.least(a, b)
    return F.when(F.isnan(a) | F.isnan(b), literal(NAN, dtype)).otherwise(F.least(a, b))


def maximum(a, b, dtype):
    return F.greatest(a, b)


def log(a, dtype, f):
    shift = 1 if f is F.log1p else 0
    inside = F.when(a > -shift, a).otherwise(F.lit(1.0))
    return as_type(F.when(F.isnan(a) | (a < -shift), F.lit(NAN)).when(a == -shift, F.lit(-INF)).otherwise(f(inside)), dtype)


def logaddexp(a, b, dtype):
    top = F.greatest(a, b)
    out = F.when(a == b, a + F.lit(float(np.log(2)))).otherwise(top + F.log1p(F.exp(-F.abs(a - b))))
    return as_type(F.when(F.isnan(a) | F.isnan(b), F.lit(NAN)).when(F.abs(top) == INF, top).otherwise(out), dtype)


def power(a, b, dtype):
    out = F.when((a == 1) | (b == 0), F.lit(1.0)).when((a == -1) & (F.abs(b) == INF), F.lit(1.0)).otherwise(F.pow(a, b))
    return as_type(out, dtype)


def copysign(a, b, dtype):
    return F.when(signbit(b, dtype), -F.abs(a)).otherwise(F.abs(a))


def sign(a, dtype):
    return as_type(F.signum(a), dtype) if np.dtype(dtype).kind == "f" else as_type(F.when(a > 0, 1).when(a < 0, -1).otherwise(0), dtype)


def shift_left(a, b, dtype):
    bits = 8 * np.dtype(dtype).itemsize
    inside = F.when((b < 0) | (b >= bits), F.lit(0)).otherwise(b).cast("int")
    return F.when((b < 0) | (b >= bits), as_type(F.lit(0), dtype)).otherwise(wrap(F.call_function("shiftleft", a.cast("long"), inside), dtype))


def shift_right(a, b, dtype):
    bits = 8 * np.dtype(dtype).itemsize
    inside = F.when((b < 0) | (b >= bits), F.lit(bits - 1)).otherwise(b).cast("int")
    beyond = F.when(a < 0, F.lit(-1)).otherwise(F.lit(0))
    return as_type(F.when((b < 0) | (b >= bits), beyond).otherwise(F.call_function("shiftright", a.cast("long"), inside)), dtype)
