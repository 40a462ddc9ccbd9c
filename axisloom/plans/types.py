"""Which annotated type may feed which: structural rules, without numeric promotion."""

from __future__ import annotations

import types
import typing
from typing import Annotated, Any, TypeVar, Union, get_args, get_origin

import numpy as np

T = TypeVar("T")


class Element(typing.Generic[T]):
    """Marks the element type of an array annotation."""


class Array(typing.Generic[T]):
    """``Array[T]``: an object array whose cells are T."""

    def __class_getitem__(cls, item: Any) -> Any:
        return Annotated[np.ndarray, Element[item]]


class Missing:
    """Stands for an annotation that isn't there."""


def _union(t: Any) -> tuple | None:
    return get_args(t) if get_origin(t) in (Union, types.UnionType) else None


def _element(t: Any) -> Any:
    if get_origin(t) is Annotated:
        for extra in get_args(t)[1:]:
            if get_origin(extra) is Element:
                return get_args(extra)[0]
    return None


def compatible(incoming: Any, required: Any) -> bool:
    """Whether a value annotated ``incoming`` may be passed where ``required`` is annotated."""
    if isinstance(incoming, TypeVar) or isinstance(required, TypeVar):
        return True
    if Missing in (incoming, required) or Any in (incoming, required) or incoming == required:
        return True
    if isinstance(incoming, str) or isinstance(required, str):
        return True  # names that can't be resolved
    many, wanted = _union(incoming), _union(required)
    if many is not None:
        return all(compatible(m, required) for m in many)
    if wanted is not None:
        return any(compatible(incoming, w) for w in wanted)
    if get_origin(incoming) is Annotated or get_origin(required) is Annotated:
        a, b = _element(incoming), _element(required)
        if a is not None and b is not None and not compatible(a, b):
            return False
        strip = lambda t: get_args(t)[0] if get_origin(t) is Annotated else t
        return compatible(strip(incoming), strip(required))
    left, right = get_origin(incoming) or incoming, get_origin(required) or required
    if not (isinstance(left, type) and isinstance(right, type) and issubclass(left, right)):
        return False
    x, y = get_args(incoming), get_args(required)
    if not x or not y:
        return True
    if Ellipsis in (*x, *y):
        x, y = [t for t in x if t is not Ellipsis], [t for t in y if t is not Ellipsis]
        n = max(len(x), len(y))
        x, y = (x * n)[:n], (y * n)[:n]
    return len(x) == len(y) and all(compatible(p, q) for p, q in zip(x, y, strict=True))


def same(a: Any, b: Any) -> bool | None:
    """Typed equality: floats within a relative 1e-9, arrays and frames by content; None where undecidable."""
    try:
        if type(a) is not type(b):
            return False
        if isinstance(a, dict):
            return same_dicts(a, b)
        if isinstance(a, float):
            return bool(np.isclose(a, b, rtol=1e-9, atol=0, equal_nan=False))
        if isinstance(a, np.ndarray):
            return bool(np.array_equal(a, b, equal_nan=a.dtype.kind in "fc")) if a.dtype != object else same(a.tolist(), b.tolist())
        if isinstance(a, (list, tuple)):
            return _all([same(x, y) for x, y in zip(a, b, strict=True)]) if len(a) == len(b) else False
        if isinstance(a, (set, frozenset)):
            return a == b
        if hasattr(a, "equals"):
            return bool(a.equals(b))
        return bool(a == b)
    except Exception:  # noqa: BLE001  any comparison may fail in its own way
        return None


def _all(found: list[bool | None]) -> bool | None:
    return False if False in found else None if None in found else True


def same_dicts(a: dict, b: dict) -> bool | None:
    """Keyed comparison; None when some value can't be decided and none differs."""
    return False if a.keys() != b.keys() else _all([same(v, b[k]) for k, v in a.items()])
