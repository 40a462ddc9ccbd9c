"""What a Python worker keeps between its tasks: the state of one operator at a time.

Workers outlive stages. Without this, a worker would hold the vocabularies and memos of every
operator that ever ran in it.
"""

from __future__ import annotations

import ctypes
import gc
from typing import Any

_HELD: dict[str, dict[Any, Any]] = {}


def state(operator: str) -> dict[Any, Any]:
    """The worker's dict for an operator; what another operator kept is let go."""
    if operator not in _HELD:
        if _HELD:
            _HELD.clear()
            gc.collect()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)
        _HELD[operator] = {}
    return _HELD[operator]
