"""What the namespace can do."""

from __future__ import annotations

from ..meta import DTYPES, isdtype


class NamespaceInfo:
    def capabilities(self) -> dict:
        return {"boolean indexing": False, "data-dependent shapes": False, "max dimensions": 64}

    def default_device(self) -> str:
        return "cpu"

    def devices(self) -> list[str]:
        return ["cpu"]

    def default_dtypes(self, *, device=None) -> dict:
        return {"real floating": DTYPES["float64"], "complex floating": DTYPES["complex128"], "integral": DTYPES["int64"], "indexing": DTYPES["int64"]}

    def dtypes(self, *, device=None, kind=None) -> dict:
        return {n: d for n, d in DTYPES.items() if kind is None or isdtype(d, kind)}
