"""Parameter sweeps as relations."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisloom.plans.flow import Flow

Rows = Iterator[dict[str, Any]]


class Sweep:
    """Rows of parameters: a product of dimensions, some of them zipped groups of names.

    ``dims`` lists names and tuples of names, all of ``items`` by default. Each row then gets
    ``constants`` where it has no such name, ``derivers`` in turn, and is left out where
    ``exclude`` holds. Derivers and ``exclude`` are functions of the row, or SQL expressions, which
    run only in :meth:`frame`.
    """

    def __init__(self, items: Mapping[str, Iterable[Any]], dims: Iterable[str | tuple[str, ...]] | None = None, exclude: Callable[[dict], bool] | str | None = None, constants: Mapping[str, Any] | None = None, derivers: Mapping[str, Callable[[dict], Any] | str] | None = None) -> None:
        self.items = {k: list(v) for k, v in items.items()}
        self.dims = [d if isinstance(d, tuple) else (d,) for d in (dims if dims is not None else self.items)]
        self.exclude, self.constants, self.derivers = exclude, dict(constants or {}), dict(derivers or {})
        for group in self.dims:
            lengths = {len(self.items[n]) for n in group}
            if len(lengths) > 1:
                raise ValueError(f"{group} are zipped but have lengths {sorted(lengths)}")

    def __iter__(self) -> Rows:
        """Rows in nested-loop order."""
        if not self.items:
            return
        for parts in itertools.product(*[list(zip(*(self.items[n] for n in g), strict=True)) for g in self.dims]):
            row = {n: v for g, vs in zip(self.dims, parts, strict=True) for n, v in zip(g, vs, strict=True)}
            for k, v in self.constants.items():
                row.setdefault(k, v)
            for k, f in self.derivers.items():
                row[k] = f(row)  # type: ignore[operator]
            if self.exclude is None or not self.exclude(row):  # type: ignore[operator]
                yield row

    def list(self) -> list[dict[str, Any]]:
        return list(self)

    def __len__(self) -> int:
        if not self.items:
            return 0
        if self.exclude is None:
            n = 1
            for g in self.dims:
                n *= len(self.items[g[0]])
            return n
        return sum(1 for _ in self)

    def __add__(self, other: Sweep | Sweeps) -> Sweeps:
        return Sweeps(self, other)

    combine = __add__

    def product(self, *others: Sweep) -> Sweep:
        """The product of sweeps: all constants and derivers apply, and rows that any of them leaves out go."""
        sweeps = (self, *others)
        items: dict[str, Any] = {}
        for s in sweeps:
            twice = set(items) & set(s.items)
            if twice:
                raise ValueError(f"{sorted(twice)} are in two sweeps")
            items |= s.items
        tests = [s.exclude for s in sweeps if s.exclude is not None]
        if any(isinstance(t, str) for t in tests):
            exclude: Any = " OR ".join(f"({t})" for t in tests)
        else:
            exclude = (lambda row: any(t(row) for t in tests)) if tests else None
        constants = {k: v for s in sweeps for k, v in s.constants.items()}
        derivers = {k: v for s in sweeps for k, v in s.derivers.items()}
        return Sweep(items, [d for s in sweeps for d in s.dims], exclude, constants, derivers)

    def derive(self, **derivers: Any) -> Sweep:
        """The same sweep with these derivers instead of its own."""
        return Sweep(self.items, self.dims, self.exclude, self.constants, derivers)

    def only(self, names: Iterable[str]) -> Sweep | list[dict[str, Any]]:
        """Rows narrowed to some names and made distinct, in order of first appearance."""
        names = list(names)
        seen: dict[tuple, dict[str, Any]] = {}
        for row in self:
            narrow = {k: row[k] for k in names if k in row}
            seen.setdefault(tuple(narrow.items()), narrow)
        return list(seen.values())

    def frame(self, spark: SparkSession) -> DataFrame:
        """The rows as a DataFrame, built as joins of one relation for each dimension."""
        df: DataFrame | None = None
        for g in self.dims:
            part = spark.createDataFrame(list(zip(*(self.items[n] for n in g), strict=True)), list(g))
            df = part if df is None else df.crossJoin(F.broadcast(part))
        if df is None:
            raise ValueError("a sweep without items has no columns")
        for k, v in self.constants.items():
            if k not in df.columns:
                df = df.withColumn(k, F.lit(v))
        for k, f in self.derivers.items():
            df = df.withColumn(k, F.expr(f) if isinstance(f, str) else f({c: F.col(c) for c in df.columns}))
        if self.exclude is not None:
            gone = F.expr(self.exclude) if isinstance(self.exclude, str) else self.exclude({c: F.col(c) for c in df.columns})
            df = df.filter(~F.coalesce(gone, F.lit(False)))
        return df


class Sweeps:
    """Several sweeps one after the other; adding gives a new object."""

    def __init__(self, *sweeps: Sweep | Sweeps) -> None:
        self.sweeps = [s for one in sweeps for s in (one.sweeps if isinstance(one, Sweeps) else [one])]

    def __iter__(self) -> Rows:
        return itertools.chain.from_iterable(self.sweeps)

    def list(self) -> list[dict[str, Any]]:
        return list(self)

    def __len__(self) -> int:
        return sum(map(len, self.sweeps))

    def __add__(self, other: Sweep | Sweeps) -> Sweeps:
        return Sweeps(self, other)

    combine = __add__

    def only(self, names: Iterable[str]) -> list[dict[str, Any]]:
        """Each member narrowed on its own; rows of different members stay apart."""
        names = list(names)
        return [row for s in self.sweeps for row in s.only(names)]

    def frame(self, spark: SparkSession) -> DataFrame:
        out = self.sweeps[0].frame(spark)
        for s in self.sweeps[1:]:
            out = out.unionByName(s.frame(spark), allowMissingColumns=True)
        return out


def count_calls(flow: Flow, out: str, rows: DataFrame) -> DataFrame:
    """How often each node that ``out`` needs would be called with the same root inputs.

    One pass over the relation: grouping sets, one for each node. Columns: ``node`` (its outputs), the
    roots of ``out`` (null where the node doesn't depend on them) and ``calls``.
    """
    nodes = list(dict.fromkeys(flow.node(o).out for o in [*flow.upstream(out), out]))
    roots = [r for r in flow.roots(out) if r in rows.columns]
    per_node = {o: [r for r in flow.roots(o[0]) if r in roots] for o in nodes}
    sets = {tuple(v) for v in per_node.values()}
    grouped = rows.groupingSets([[F.col(f"`{c}`") for c in s] for s in sets], *[F.col(f"`{r}`") for r in roots]).agg(F.count("*").alias("calls"), F.grouping_id().alias("_set"))
    bit = {r: 1 << (len(roots) - 1 - k) for k, r in enumerate(roots)}
    ids = [(",".join(o), sum(bit[r] for r in roots if r not in s)) for o, s in per_node.items()]
    names = rows.sparkSession.createDataFrame(ids, "node string, _set bigint")
    return grouped.join(F.broadcast(names), "_set").select("node", *roots, "calls")


def cache_plan(flow: Flow, out: str, rows: DataFrame, least: int = 2) -> DataFrame:
    """Which nodes to cache for a sweep: those called ``least`` times with some inputs, except ``out``'s own."""
    calls = count_calls(flow, out, rows).groupBy("node").agg(F.max("calls").alias("most_calls"))
    return calls.withColumn("cache", (F.col("most_calls") >= least) & (F.col("node") != ",".join(flow.node(out).out)))


def set_caches(flow: Flow, out: str, rows: DataFrame, least: int = 2) -> None:
    """Turn caching on and off in a flow by :func:`cache_plan`; one row for each node comes to the driver."""
    for r in cache_plan(flow, out, rows, least).collect():
        flow.node(r["node"].split(",")[0]).cache = r["cache"]


def sweep_inputs(flow: Flow, sweep: Sweep | Sweeps, axis: str = "sweep") -> tuple[Flow, dict[str, list[Any]]]:
    """A flow with a sweep axis on all swept inputs, and the inputs to map it over: one job for all rows."""
    rows = sweep.list()
    names = [n for n in (rows[0] if rows else {}) if n in flow.roots()]
    new = flow.copy()
    new.add_axis(*names, axis=axis)
    return new, {n: [r[n] for r in rows] for n in names}


def fixed_points(flow: Flow, out: str, sizes: Mapping[str, int]) -> list[dict[str, int]]:
    """Fixed indices that split a map into jobs over the independent axes of an output."""
    axes = flow.independent_axes(out)
    return [dict(zip(axes, k, strict=True)) for k in itertools.product(*(range(sizes[a]) for a in axes))]
