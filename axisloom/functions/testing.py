"""Stand-ins for nodes in tests."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any
from unittest.mock import Mock

from axisloom.plans.flow import Flow


@contextmanager
def replaced(flow: Flow, out: str, body: Callable | None = None, **mock: Any) -> Iterator[Callable]:
    """Give the node that makes ``out`` another body for a while: the one given, or a mock with these settings."""
    node = flow.node(out)
    kept, node.body = node.body, body if body is not None else Mock(**mock)
    try:
        yield node.body
    finally:
        node.body = kept
