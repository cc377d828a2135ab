"""Elementwise functions: a table of names, the dtypes they take, the dtype they give, their column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import meta
from ..array import Array, combine, full, is_array
from ..functions import ieee


def scalar(value, dtype) -> Array:
    """A Python scalar as an array of a dtype; a scalar of a kind that the dtype can't hold is an error."""
    dtype = np.dtype(dtype)
    if isinstance(value, bool | np.bool_):
        if dtype.kind != "b":
            raise TypeError("a bool goes with bool arrays only")
    elif isinstance(value, int | np.integer):
        if dtype.kind == "b":
            raise TypeError("an int doesn't go with bool arrays")
        if dtype.kind in "iu" and not np.iinfo(dtype).min <= value <= np.iinfo(dtype).max:
            raise OverflowError(f"{value} is out of bounds for {dtype}")
    elif isinstance(value, float | np.floating):
        if dtype.kind not in "fc":
            raise TypeError("a float goes with floating-point arrays only")
    elif isinstance(value, complex | np.complexfloating):
        if dtype.kind != "c":
            raise TypeError("a complex number goes with complex arrays only")
    else:
        raise TypeError(f"{type(value).__name__} isn't an array or a scalar")
    return full((), value, dtype)


def promote(*xs) -> list[Array]:
    """Arrays from arrays and at most all but one scalars."""
    arrays = [x for x in xs if is_array(x)]
    if not arrays:
        raise TypeError("at least one operand must be an array")
    dtype = meta.result_type(*arrays)
    return [x if is_array(x) else _like(scalar(x, dtype), arrays[0]) for x in xs]


def _like(x: Array, other: Array) -> Array:
    x.spec = other.spec
    return x


def by_numpy(name: str, dtype, arrays: list[Array]) -> Array:
    """An elementwise NumPy function over Arrow batches, for what columns can't express."""
    np_function, dtype = getattr(np, name), np.dtype(dtype)
    kinds = [a.dtype for a in arrays]

    def column(part, kind):
        if kind.kind == "c":
            return (part["re"].to_numpy(float) + 1j * part["im"].to_numpy(float)).astype(kind)
        return part.to_numpy().astype(kind)

    def apply(*parts):
        with np.errstate(all="ignore"):
            out = np_function(*[column(p, k) for p, k in zip(parts, kinds, strict=True)]).astype(dtype)
        return pd.DataFrame({"re": out.real, "im": out.imag}) if dtype.kind == "c" else pd.Series(out)

    # A pandas function takes its kinds of column from its signature.
    hints = {f"p{i}": pd.DataFrame if k.kind == "c" else pd.Series for i, k in enumerate(kinds)}
    result = pd.DataFrame if dtype.kind == "c" else pd.Series
    args = ", ".join(hints)
    scope = {"apply": apply}
    exec(f"def call({args}):\n    return apply({args})", scope)  # noqa: S102  a function of as many named arguments
    call = scope["call"]
    call.__annotations__ = {**hints, "return": result}
    udf = F.pandas_udf(call, meta.spark_type(dtype))
    casted = [lambda c, k=k: c.cast(meta.spark_type(k)) if k.kind != "c" else c for k in kinds]
    return combine(lambda *cs: udf(*[f(c) for f, c in zip(casted, cs, strict=True)]), arrays, dtype)


#: Functions of one floating-point array that Spark computes as NumPy does.
_FLOAT = {n: getattr(F, n) for n in "acosh asin acos asinh atan atanh cos cosh exp expm1 sin sinh sqrt tan tanh".split()}
_LOGS = {n: getattr(F, n) for n in "log log1p log2 log10".split()}
_SAME = {"floor": ieee.floor, "ceil": ieee.ceil, "trunc": ieee.trunc, "round": ieee.round_, "negative": ieee.negative, "positive": lambda a, _: a, "sign": ieee.sign}


def _unary(name: str, category: str, x: Array) -> Array:
    if not is_array(x):
        raise TypeError(f"{name} takes an array")
    meta.check_kind(name, category, x.dtype)
    d = x.dtype
    if name in ("real", "imag"):
        part = {"real": "re", "imag": "im"}[name]
        return combine(lambda a: a[part], [x], "float32" if d.itemsize == 8 else "float64")
    if d.kind == "c":
        out = {"abs": d.type(0).real.dtype, "isnan": bool, "isinf": bool, "isfinite": bool}.get(name, d)
        alias = {"acos": "arccos", "acosh": "arccosh", "asin": "arcsin", "asinh": "arcsinh", "atan": "arctan", "atanh": "arctanh"}
        return by_numpy(alias.get(name, name), out, [x])
    if name in ("isnan", "isinf", "isfinite"):
        if d.kind != "f":
            return combine(lambda a: F.lit(name == "isfinite") | (a != a), [x], bool)
        how = {"isnan": F.isnan, "isinf": lambda a: F.abs(a) == ieee.INF, "isfinite": lambda a: ~F.isnan(a) & (F.abs(a) < ieee.INF)}[name]
        return combine(how, [x], bool)
    if name == "signbit":
        return combine(lambda a: ieee.signbit(a, d), [x], bool)
    if name == "abs":
        return combine(lambda a: ieee.absolute(a, d), [x], d)
    if name in _SAME:
        return combine(lambda a: _SAME[name](a, d), [x], d)
    if name in _FLOAT:
        return combine(lambda a: ieee.as_type(_FLOAT[name](a), d), [x], d)
    if name in _LOGS:
        return combine(lambda a: ieee.log(a, d, _LOGS[name]), [x], d)
    if name == "square":
        return combine(lambda a: ieee.multiply(a, a, d), [x], d)
    if name == "reciprocal":
        return combine(lambda a: ieee.divide(ieee.literal(1, d), a, d), [x], d)
    if name == "bitwise_invert":
        if d == np.uint64:
            return by_numpy("bitwise_invert", d, [x])
        return combine((lambda a: ~a) if d.kind == "b" else (lambda a: ieee.wrap(F.bitwise_not(a.cast("long")), d)), [x], d)
    if name == "logical_not":
        return combine(lambda a: ~a, [x], bool)
    raise KeyError(name)


def _bits(name: str):
    method = {"bitwise_and": "bitwiseAND", "bitwise_or": "bitwiseOR", "bitwise_xor": "bitwiseXOR"}[name]
    truth = {"bitwise_and": lambda a, b: a & b, "bitwise_or": lambda a, b: a | b, "bitwise_xor": lambda a, b: a != b}[name]
    return lambda a, b, d: truth(a, b) if d.kind == "b" else getattr(a, method)(b)


_ARITHMETIC = {
    "add": ieee.add, "subtract": ieee.subtract, "multiply": ieee.multiply, "divide": ieee.divide, "remainder": ieee.remainder, "floor_divide": ieee.floor_divide, "minimum": ieee.minimum, "maximum": ieee.maximum, "logaddexp": ieee.logaddexp,
    "bitwise_and": _bits("bitwise_and"), "bitwise_or": _bits("bitwise_or"), "bitwise_xor": _bits("bitwise_xor"), "bitwise_left_shift": ieee.shift_left, "bitwise_right_shift": ieee.shift_right,
    "atan2": lambda a, b, d: ieee.as_type(F.atan2(a, b), d), "hypot": lambda a, b, d: ieee.as_type(F.hypot(a, b), d), "copysign": ieee.copysign, "pow": ieee.power,
}
_COMPARE = {"less": "<", "less_equal": "<=", "greater": ">", "greater_equal": ">="}


def _binary(name: str, category: str, x1, x2) -> Array:
    x1, x2 = promote(x1, x2)
    meta.check_kind(name, category, x1.dtype, x2.dtype)
    d = meta.result_type(x1, x2)
    if d.name not in meta.DTYPES:
        raise TypeError(f"{name} doesn't take {x1.dtype} and {x2.dtype} together")
    if name.startswith("logical_"):
        how = {"logical_and": lambda a, b: a & b, "logical_or": lambda a, b: a | b, "logical_xor": lambda a, b: a != b}[name]
        return combine(how, [x1, x2], bool)
    if name == "nextafter":
        return by_numpy(name, x1.dtype, [x1, x2])
    if name in ("hypot", "copysign") and d.kind != "f":
        d = np.result_type(d, np.float64 if d.itemsize > 2 else np.float32 if d.itemsize > 1 else np.float16)
        d = np.dtype(np.float64) if d.name == "float16" else d
    both = [astype(x1, d), astype(x2, d)]
    if name in ("equal", "not_equal"):
        if d.kind == "c":
            same = lambda a, b: ieee.equal(a["re"], b["re"]) & ieee.equal(a["im"], b["im"])
        else:
            same = lambda a, b: ieee.equal(a, b, d.kind)
        return combine(same if name == "equal" else lambda a, b: ~same(a, b), both, bool)
    if d.kind == "c" or d == np.uint64 and ("bitwise" in name or name == "floor_divide") or name == "pow" and d.kind in "iu" or name == "atan2":
        numpy_name = {"pow": "power", "atan2": "arctan2", "bitwise_left_shift": "left_shift", "bitwise_right_shift": "right_shift"}.get(name, name)
        return by_numpy(numpy_name, bool if name in _COMPARE else d, both)
    if name in _COMPARE:
        return combine(lambda a, b: ieee.compare(_COMPARE[name], a, b, d.kind), both, bool)
    return combine(lambda a, b: _ARITHMETIC[name](a, b, d), both, d)


_UNARY_KINDS = {
    "numeric": "abs isfinite isinf isnan negative positive round sign square", "real numeric": "ceil floor signbit trunc", "integer or boolean": "bitwise_invert", "boolean": "logical_not", "complex floating-point": "conj imag real",
    "floating-point": "acos acosh asin asinh atan atanh cos cosh exp expm1 log log1p log2 log10 reciprocal sin sinh sqrt tan tanh",
}
_BINARY_KINDS = {
    "numeric": "add multiply pow subtract", "floating-point": "divide", "real floating-point": "atan2 logaddexp nextafter", "real numeric": "copysign floor_divide hypot maximum minimum remainder", "any": "equal greater greater_equal less less_equal not_equal",
    "integer or boolean": "bitwise_and bitwise_or bitwise_xor", "integer": "bitwise_left_shift bitwise_right_shift", "boolean": "logical_and logical_or logical_xor",
}


def _define():
    for category, names in _UNARY_KINDS.items():
        for name in names.split():
            def one(x, /, *, _name=name, _category=category) -> Array:
                return _unary(_name, _category, x)

            one.__name__ = one.__qualname__ = name
            one.__doc__ = f"Elementwise {name} of {category} arrays."
            globals()[name] = one
    for category, names in _BINARY_KINDS.items():
        for name in names.split():
            def two(x1, x2, /, *, _name=name, _category=category) -> Array:
                return _binary(_name, _category, x1, x2)

            two.__name__ = two.__qualname__ = name
            two.__doc__ = f"Elementwise {name} of {category} arrays; one operand may be a scalar."
            globals()[name] = two


_define()
NAMES = sorted({*" ".join(_UNARY_KINDS.values()).split(), *" ".join(_BINARY_KINDS.values()).split(), "clip"})


def astype(x: Array, dtype, /, *, copy: bool = True, device=None) -> Array:
    dtype = np.dtype(dtype)
    if dtype == x.dtype:
        return x
    if x.dtype.kind == "c" and dtype.kind != "c":
        raise TypeError("complex arrays don't cast to real ones")
    return combine(lambda a: ieee.cast(a, x.dtype, dtype), [x], dtype)


def clip(x: Array, /, min=None, max=None) -> Array:
    """Limit to [min, max]; the dtype stays."""
    meta.check_kind("clip", "real numeric", x.dtype)
    for bound, how in ((min, ieee.maximum), (max, ieee.minimum)):
        if bound is not None:
            bound = astype(bound, x.dtype) if is_array(bound) else full((), bound, x.dtype, spec=x.spec)
            x = combine(lambda a, b, how=how: how(a, b, x.dtype), [x, bound], x.dtype)
    return x


def where(condition: Array, x1, x2, /) -> Array:
    x1, x2 = promote(x1, x2)
    meta.check_kind("where", "boolean", condition.dtype)
    d = meta.result_type(x1, x2)
    return combine(lambda c, a, b: F.when(c, a).otherwise(b), [condition, astype(x1, d), astype(x2, d)], d)


def elemwise(function, *arrays: Array, dtype) -> Array:
    """A function of columns, elementwise."""
    return combine(lambda *cs: function(*cs), promote(*arrays), dtype)


def _operators():
    pairs = {
        "add": "add", "sub": "subtract", "mul": "multiply", "truediv": "divide", "floordiv": "floor_divide", "mod": "remainder", "pow": "pow", "and": "bitwise_and", "or": "bitwise_or", "xor": "bitwise_xor", "lshift": "bitwise_left_shift", "rshift": "bitwise_right_shift",
    }
    compares = {"eq": "equal", "ne": "not_equal", "lt": "less", "le": "less_equal", "gt": "greater", "ge": "greater_equal"}
    known = (Array, bool, int, float, complex, np.generic)
    for short, name in (pairs | compares).items():
        function = globals()[name]
        setattr(Array, f"__{short}__", lambda self, other, f=function: f(self, other) if isinstance(other, known) else NotImplemented)
        if short in pairs:
            setattr(Array, f"__r{short}__", lambda self, other, f=function: f(other, self) if isinstance(other, known) else NotImplemented)
    for short, name in {"neg": "negative", "pos": "positive", "abs": "abs", "invert": "bitwise_invert"}.items():
        setattr(Array, f"__{short}__", lambda self, f=globals()[name]: f(self))

    def matmul(self, other):
        from .linalg import matmul as product

        return product(self, other) if isinstance(other, Array) else NotImplemented

    def rmatmul(self, other):
        from .linalg import matmul as product

        return product(other, self) if isinstance(other, Array) else NotImplemented

    Array.__matmul__, Array.__rmatmul__ = matmul, rmatmul


_operators()
