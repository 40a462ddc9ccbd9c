"""Axis frames: arrays as one row a cell, keyed by their axes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axisloom.plans.spec import regular_shape, shape_of


@dataclass(frozen=True)
class AxisFrame:
    """A DataFrame with one row for each cell of an array.

    ``axes`` are key columns, ``name`` the value column; a missing cell is a row that isn't there
    and a null value is a null. ``sizes`` holds the sizes known on the driver; a ``sparse`` frame
    (business keys, gaps) is never checked against others' sizes. ``error`` names the column of
    error records where errors are kept as data.
    """

    df: DataFrame
    name: str
    axes: tuple[str, ...] = ()
    sizes: Mapping[str, int] = field(default_factory=dict)
    sparse: bool = False
    error: str | None = None

    @classmethod
    def from_values(cls, spark: SparkSession, name: str, axes: Iterable[str], values: Any, dtype: str | None = None) -> AxisFrame:
        """A frame of a nested list, range or array; axes count from 0 in row-major order."""
        axes = tuple(axes)
        shape = shape_of(values, name)[: len(axes)]
        if len(shape) < len(axes):
            raise ValueError(f"{name!r} has {len(shape)} dimensions and {len(axes)} axes")
        if isinstance(values, range) and len(axes) == 1 and dtype in (None, "bigint", "long"):
            df = spark.range(len(values)).select(F.col("id").alias(axes[0]), (F.col("id") * values.step + values.start).alias(name))
            return cls(df, name, axes, {axes[0]: len(values)})
        if dtype is None and (columns := _flat_columns(values, axes, shape, name)) is not None:
            return cls(spark.createDataFrame(columns), name, axes, dict(zip(axes, map(int, shape), strict=True)))
        cells: list = list(values) if not isinstance(values, np.ndarray) else list(values.reshape(-1, *values.shape[len(axes) :]))
        if not isinstance(values, np.ndarray):
            for _ in axes[1:]:
                cells = [c for row in cells for c in row]
        keep = [k for k, c in enumerate(cells) if c is not np.ma.masked]
        index = np.unravel_index(np.array(keep, dtype=np.int64), shape) if keep else [np.zeros(0, np.int64)] * len(axes)
        plain = [c.tolist() if isinstance(c, np.ndarray) else c.item() if isinstance(c, np.generic) else c for c in (cells[k] for k in keep)]
        schema = ", ".join(f"`{a}` bigint" for a in axes)
        if dtype is None and plain:
            dtype = spark.createDataFrame([(v,) for v in plain[:1000]], ["v"]).schema["v"].dataType.simpleString()
        rows = pd.DataFrame({a: i for a, i in zip(axes, index, strict=True)} | {name: pd.Series(plain, dtype=object)})
        df = spark.createDataFrame(list(rows.itertuples(index=False, name=None)), f"{schema}, `{name}` {dtype or 'string'}")
        return cls(df, name, axes, dict(zip(axes, map(int, shape), strict=True)))

    @classmethod
    def from_scalar(cls, spark: SparkSession, name: str, value: Any) -> AxisFrame:
        """A frame of one row without axes."""
        return cls(spark.range(1).select(F.lit(value).alias(name)), name)

    @classmethod
    def from_table(cls, df: DataFrame, name: str, axes: Iterable[str], value: str | Column | None = None, sparse: bool = True) -> AxisFrame:
        """A frame over key columns of a table."""
        axes = tuple(axes)
        column = F.col(value) if isinstance(value, str) else value if value is not None else F.col(name)
        return cls(df.select(*axes, column.alias(name)), name, axes, sparse=sparse)

    @classmethod
    def from_bag(cls, df: DataFrame, name: str, axes: Iterable[str], value: str | Column, inner: str = "r", order: Iterable[str] = ()) -> AxisFrame:
        """A frame over keys that repeat, with an innermost axis that numbers the repeats from 0."""
        axes = tuple(axes)
        column = F.col(value) if isinstance(value, str) else value
        by = Window.partitionBy(*axes).orderBy(*(order or [c for c in df.columns if c not in axes]))
        return cls(df.select(*axes, (F.row_number().over(by) - 1).cast("bigint").alias(inner), column.alias(name)), name, (*axes, inner), sparse=True)

    def with_df(self, df: DataFrame, **changes: Any) -> AxisFrame:
        return replace(self, df=df, **changes)

    def value(self) -> Column:
        return F.col(f"`{self.name}`")

    def rename(self, name: str) -> AxisFrame:
        """The same cells under another name."""
        return self.with_df(self.df.withColumnRenamed(self.name, name), name=name)

    def rename_axes(self, names: Mapping[str, str]) -> AxisFrame:
        """The same cells with other axis names."""
        return self.with_df(self.df.withColumnsRenamed(dict(names)), axes=tuple(names.get(a, a) for a in self.axes), sizes={names.get(a, a): n for a, n in self.sizes.items()})

    def at(self, **fixed: int | slice) -> AxisFrame:
        """Cells at an index or in a slice of some axes; the filter reaches the scan."""
        df = self.df
        for axis, k in fixed.items():
            if axis not in self.axes:
                raise ValueError(f"{self.name!r} has no axis {axis!r}")
            df = df.filter(index_filter(F.col(f"`{axis}`"), k, self.sizes.get(axis), axis))
        return self.with_df(df, sparse=True)

    def size(self, axis: str) -> int:
        """Size of an axis, counted where it isn't known."""
        if axis in self.sizes:
            return self.sizes[axis]
        top = self.df.agg(F.max(f"`{axis}`")).first()[0]
        return 0 if top is None else int(top) + 1

    def shape(self) -> tuple[int, ...]:
        return tuple(self.size(a) for a in self.axes)

    def missing(self) -> DataFrame:
        """Indices of the full space that have no cell."""
        return space(self.df.sparkSession, {a: self.size(a) for a in self.axes}).join(self.df.select(*self.axes), list(self.axes), "left_anti")

    def to_numpy(self, fill: Any = None) -> np.ndarray:
        """All cells as a dense array on the driver; missing ones are masked, or ``fill``."""
        rows = self.df.select(*[f"`{a}`" for a in self.axes], f"`{self.name}`").collect()
        shape = tuple(self.sizes[a] if a in self.sizes else max((r[k] for r in rows), default=-1) + 1 for k, a in enumerate(self.axes))
        out = np.empty(shape, object)
        seen = np.zeros(shape, bool)
        for r in rows:
            out[tuple(r[:-1])] = r[-1]
            seen[tuple(r[:-1])] = True
        if seen.all():
            return out
        if fill is not None:
            out[~seen] = fill
            return out
        return np.ma.MaskedArray(out, ~seen, dtype=object)


def _flat_columns(values: Any, axes: tuple[str, ...], shape: tuple[int, ...], name: str) -> pa.Table | None:
    """Index and value columns of plain numbers, texts or truth values, made without a Python object for each cell; None for other cells."""
    if isinstance(values, np.ma.MaskedArray):
        return None
    if isinstance(values, np.ndarray):
        if values.ndim != len(axes) or values.dtype.kind not in "iufb":
            return None
        flat = pa.array(np.ascontiguousarray(values).ravel())
    elif len(axes) == 1 and isinstance(values, list) and len({type(v) for v in values}) == 1 and isinstance(values[0], (int, float, str)):
        try:
            flat = pa.array(values)
        except (pa.ArrowInvalid, OverflowError):
            return None
    else:
        return None
    if flat.type in (pa.float16(), pa.float32()):
        flat = flat.cast(pa.float64())
    elif pa.types.is_integer(flat.type):
        flat = flat.cast(pa.int64())
    return pa.table([*(pa.array(i.ravel()) for i in np.indices(shape, np.int64)), flat], names=[*axes, name])


def index_filter(column: Column, k: int | slice, size: int | None, axis: str) -> Column:
    """A predicate for an index or slice; negative ones need the size."""
    if isinstance(k, slice):
        if size is not None:
            start, stop, step = k.indices(size)
        else:
            start, stop, step = k.start or 0, k.stop, k.step or 1
            if start < 0 or (stop or 0) < 0 or step < 0:
                raise ValueError(f"the size of axis {axis!r} isn't known; negative slices need it")
        if step < 0:
            picked = range(start, stop, step)
            if not picked:
                return F.lit(False)
            start, stop, step = picked[-1], picked[0] + 1, -step
        inside = column >= start
        if stop is not None:
            inside = inside & (column < stop)
        return inside & ((column - start) % step == 0) if step != 1 else inside
    if size is not None:
        if not -size <= k < size:
            raise IndexError(f"{k} is outside axis {axis!r} of size {size}")
        k %= size
    elif k < 0:
        raise ValueError(f"the size of axis {axis!r} isn't known; negative indices need it")
    return column == k


def space(spark: SparkSession, sizes: Mapping[str, int]) -> DataFrame:
    """Every index of a shape, one column an axis."""
    frames = [spark.range(n).withColumnRenamed("id", a) for a, n in sizes.items()]
    if not frames:
        return spark.range(1).drop("id")
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(f)
    return out


def linear_index(axes: Iterable[str], shape: Iterable[int]) -> Column:
    """Row-major position of an index."""
    from axisloom.plans.spec import strides

    terms = [F.col(a) * s for a, s in zip(axes, strides(tuple(shape)), strict=True)]
    out = F.lit(0).cast("bigint")
    for t in terms:
        out = out + t
    return out


def unravel(linear: Column, axes: Iterable[str], shape: Iterable[int]) -> list[Column]:
    """Index columns of a row-major position."""
    from axisloom.plans.spec import strides

    shape, whole = tuple(shape), linear.cast("bigint")
    return [F.pmod(F.call_function("div", whole, F.lit(s).cast("bigint")), F.lit(n).cast("bigint")).alias(a) for a, s, n in zip(axes, strides(shape), shape, strict=True)]


def in_order(value: Column, axes: Iterable[str]) -> Column:
    """Aggregate: the values of a group as an array in the order of some axes."""
    pairs = F.collect_list(F.struct(*[F.col(f"`{a}`").alias(f"k{i}") for i, a in enumerate(axes)], value.alias("v")))
    return F.transform(F.array_sort(pairs), lambda p: p["v"])


def dense_shape(x: Any) -> tuple[int, ...]:
    """Shape of a cell's nested value."""
    return regular_shape(x)
