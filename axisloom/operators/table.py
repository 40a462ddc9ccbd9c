"""Results as one labelled table, and casts by declared type."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisloom.operators.compile import BROADCAST_CELLS, _cells
from axisloom.operators.frame import AxisFrame
from axisloom.plans.spec import IndexSpec, lineage


def coordinates(specs: Iterable[IndexSpec], name: str, made: Iterable[str] = ()) -> dict[str, tuple[str, ...]]:
    """The root inputs that label an output, with the axes they label: those whose axes all survive."""
    specs = list(specs)
    whole = {r.name: tuple(r.places) for s in specs for r in s.inputs if None not in r.axes}
    return {root: axes for root, axes in lineage(specs).get(name, {}).items() if set(whole.get(root, axes)) <= set(axes)}


def assemble(frames: Mapping[str, AxisFrame], outputs: Iterable[str], specs: Iterable[IndexSpec] = (), keep_axes: bool = False) -> DataFrame:
    """Outputs and the inputs that label them as one table.

    Arrays over the same axes meet in a full outer join, arrays over other axes spread over the
    product, values without axes are repeated on every row; the axis columns go in the end.
    """
    specs, outputs = list(specs), list(outputs)
    labels = {c for o in outputs for c in coordinates(specs, o) if c in frames}
    names = [*sorted(labels - set(outputs)), *outputs]
    groups: dict[tuple[str, ...], list[AxisFrame]] = {}
    for n in names:
        f = frames[n]
        order = tuple(sorted(f.axes))
        groups.setdefault(order, []).append(f if f.name == n else f.rename(n))
    tables = []
    for axes, members in groups.items():
        df = members[0].df
        for f in members[1:]:
            df = df.join(f.df, list(axes), "full") if axes else df.crossJoin(F.broadcast(f.df))
        tables.append((axes, df, min((c for f in members if (c := _cells(f)) is not None), default=None)))
    tables.sort(key=lambda t: -len(t[0]))
    axes, out, _ = tables[0]
    for more, df, cells in tables[1:]:
        shared = [a for a in more if a in axes]
        small = not more or cells is not None and cells <= BROADCAST_CELLS
        out = out.join(df, shared, "full" if set(more) <= set(axes) else "left") if shared else out.crossJoin(F.broadcast(df) if small else df)
        axes = (*axes, *[a for a in more if a not in axes])
    return out.select(*[f"`{a}`" for a in axes if keep_axes], *[f"`{n}`" for n in names])


def composite(df: DataFrame, names: Iterable[str], out: str | None = None) -> DataFrame:
    """Several coordinates over the same axes as one struct column, called ``a:b`` by default."""
    names = list(names)
    return df.withColumn(out or ":".join(names), F.struct(*names)).drop(*names)


def split_composite(df: DataFrame, name: str) -> DataFrame:
    """The columns of a composite again."""
    return df.select(*[c for c in df.columns if c != name], F.col(f"`{name}`.*"))


def cast(f: AxisFrame, dtype: str, warn: bool = False) -> AxisFrame:
    """A frame with its value cast; values that can't be cast become null. ``warn`` counts them, which is a job."""
    new = f.with_df(f.df.withColumn(f.name, f.value().try_cast(dtype)))
    if warn:
        lost = f.df.filter(f.value().isNotNull() & f.value().try_cast(dtype).isNull()).count()
        if lost:
            warnings.warn(f"{lost} values of {f.name!r} are no {dtype}; the column stays as it is", stacklevel=2)
            return f
    return new
