"""Driver-side caches for scalar runs, and reuse of equal calls in Spark."""

from __future__ import annotations

import functools
import hashlib
import inspect
import os
import pickle
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable, Mapping
from pathlib import Path
from typing import Any

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_key(value: Any) -> Hashable:
    """A hashable stand-in: equal content, also of arrays and frames, gives equal keys; types count."""
    kind = type(value).__name__
    if isinstance(value, Mapping):
        return (kind, tuple(sorted(((as_key(k), as_key(v)) for k, v in value.items()), key=repr)))
    if isinstance(value, (list, tuple)):
        return (kind, tuple(map(as_key, value)))
    if isinstance(value, (set, frozenset)):
        return (kind, tuple(sorted(map(as_key, value), key=repr)))
    if isinstance(value, np.ndarray):
        if value.dtype == object:
            return (kind, value.shape, as_key(value.ravel().tolist()))
        return (kind, value.shape, value.dtype.str, hashlib.sha256(np.ascontiguousarray(value).tobytes()).hexdigest())
    try:
        hash(value)
    except TypeError:
        return (kind, hashlib.sha256(cloudpickle.dumps(value)).hexdigest())
    return (kind, value)


class Simple:
    """Keeps everything."""

    def __init__(self) -> None:
        self.held: dict[Hashable, Any] = {}

    def get(self, key: Hashable) -> Any:
        return self.held.get(key)

    def put(self, key: Hashable, value: Any, took: float = 0.0) -> None:
        self.held[key] = value

    def __contains__(self, key: Hashable) -> bool:
        return key in self.held

    def __len__(self) -> int:
        return len(self.held)

    def clear(self) -> None:
        self.held.clear()


class Recent(Simple):
    """Keeps the entries used last."""

    def __init__(self, most: int = 128) -> None:
        super().__init__()
        if most < 1:
            raise ValueError("a cache holds one entry at least")
        self.held: OrderedDict[Hashable, Any] = OrderedDict()
        self.most, self._lock = most, threading.Lock()

    def get(self, key: Hashable) -> Any:
        with self._lock:
            if key in self.held:
                self.held.move_to_end(key)
            return self.held.get(key)

    def put(self, key: Hashable, value: Any, took: float = 0.0) -> None:
        with self._lock:
            self.held[key] = value
            self.held.move_to_end(key)
            while len(self.held) > self.most:
                self.held.popitem(last=False)


class Weighted(Simple):
    """Keeps what is used often and took long: the least weighted sum of both shares goes first."""

    def __init__(self, most: int = 128, use_weight: float = 0.5, time_weight: float = 0.5) -> None:
        super().__init__()
        self.most, self.use_weight, self.time_weight = most, use_weight, time_weight
        self.uses: dict[Hashable, int] = {}
        self.took: dict[Hashable, float] = {}

    def get(self, key: Hashable) -> Any:
        if key in self.held:
            self.uses[key] += 1
        return self.held.get(key)

    def _worth(self, key: Hashable) -> float:
        uses, took = sum(self.uses.values()) or 1, sum(self.took.values()) or 1
        return self.use_weight * self.uses[key] / uses + self.time_weight * self.took[key] / took

    def put(self, key: Hashable, value: Any, took: float = 0.0) -> None:
        if key not in self.held and len(self.held) >= self.most:
            worst = min(self.held, key=self._worth)
            for d in (self.held, self.uses, self.took):
                d.pop(worst)
        self.held[key], self.uses[key], self.took[key] = value, self.uses.get(key, 0) + 1, took

    def clear(self) -> None:
        for d in (self.held, self.uses, self.took):
            d.clear()


class Disk:
    """Keeps pickles in a folder, the oldest of which go beyond ``most``; a cache in memory may stand before it."""

    def __init__(self, folder: str | Path, most: int | None = None, front: Simple | None = None) -> None:
        self.folder, self.most, self.front = Path(folder), most, front
        self.folder.mkdir(parents=True, exist_ok=True)

    def _path(self, key: Hashable) -> Path:
        return self.folder / f"{hashlib.sha256(cloudpickle.dumps(key)).hexdigest()}.pkl"

    def get(self, key: Hashable) -> Any:
        if self.front is not None and key in self.front:
            return self.front.get(key)
        try:
            value = pickle.loads(self._path(key).read_bytes())
        except FileNotFoundError:
            return None
        if self.front is not None:
            self.front.put(key, value)
        return value

    def put(self, key: Hashable, value: Any, took: float = 0.0) -> None:
        path = self._path(key)
        part = path.with_suffix(f".{os.getpid()}")
        part.write_bytes(cloudpickle.dumps(value))
        part.replace(path)
        if self.front is not None:
            self.front.put(key, value, took)
        if self.most is not None:
            files = sorted(self.folder.glob("*.pkl"), key=lambda p: p.stat().st_mtime_ns)
            for old in files[: max(0, len(files) - self.most)]:
                old.unlink(missing_ok=True)

    def __contains__(self, key: Hashable) -> bool:
        return self.front is not None and key in self.front or self._path(key).exists()

    def __len__(self) -> int:
        return sum(1 for _ in self.folder.glob("*.pkl"))

    def clear(self) -> None:
        if self.front is not None:
            self.front.clear()
        for p in self.folder.glob("*.pkl"):
            p.unlink(missing_ok=True)


def code_key(f: Callable) -> str:
    """A digest of a function's source, so that an edit gives another key."""
    try:
        text = inspect.getsource(f)
    except (OSError, TypeError):
        text = repr(getattr(getattr(f, "__code__", None), "co_code", f))
    return hashlib.sha256(text.encode()).hexdigest()


def memoize(cache: Any = None, key: Callable[..., Hashable] | None = None) -> Callable[[Callable], Callable]:
    """Decorator: equal arguments are computed once."""
    cache = Simple() if cache is None else cache

    def wrap(f: Callable) -> Callable:
        own = code_key(f)

        @functools.wraps(f)
        def call(*args: Any, **kwargs: Any) -> Any:
            k = (own, key(*args, **kwargs) if key else as_key((args, kwargs)))
            if k in cache:
                return cache.get(k)
            began = time.perf_counter()
            value = f(*args, **kwargs)
            cache.put(k, value, time.perf_counter() - began)
            return value

        call.cache = cache  # type: ignore[attr-defined]
        return call

    return wrap


def once_for_each(df: DataFrame, arguments: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Compute a costly column once for each distinct set of arguments and join it back.

    ``compute`` gets the distinct arguments and adds columns to them; nulls count as equal.
    """
    unique = compute(df.select(*arguments).distinct())
    new = [c for c in unique.columns if c not in arguments]
    right = unique.select(*[F.col(a).alias(f"_k_{a}") for a in arguments], *new)
    same: Column = F.lit(True)
    for a in arguments:
        same = same & df[a].eqNullSafe(right[f"_k_{a}"])
    return df.join(right, same, "inner").drop(*[f"_k_{a}" for a in arguments])
