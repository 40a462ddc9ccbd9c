"""Runs: a flow over arrays, resumed from and kept in a run folder, in the foreground or not."""

from __future__ import annotations

import math
import threading
import time
import uuid
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisloom.functions.node import OPAQUE, Node
from axisloom.operators.compile import _cells as cells_of
from axisloom.operators.compile import compile_node
from axisloom.operators.dataset import Dataset, dataset
from axisloom.operators.frame import AxisFrame
from axisloom.operators.table import assemble, cast
from axisloom.plans.flow import Flow
from axisloom.sources.store import RunFolder
from axisloom.sources.tables import ByReference


@dataclass
class Results:
    """Frames of inputs and outputs of a run; they are lazy until something reads them."""

    flow: Flow
    frames: dict[str, AxisFrame]
    outputs: list[str]
    run: RunFolder | None = None
    cached: list[DataFrame] = field(default_factory=list)
    measured: dict[str, tuple[float, int]] = field(default_factory=dict)

    def __getitem__(self, name: str) -> AxisFrame:
        return self.frames[name]

    def __contains__(self, name: str) -> bool:
        return name in self.frames

    def value(self, name: str) -> Any:
        """A value without axes, or a dense array, on the driver."""
        f = self.frames[name]
        return f.to_numpy() if f.axes else f.df.select(f"`{name}`").first()[0]

    def to_table(self, *outputs: str, keep_axes: bool = False) -> DataFrame:
        """One labelled table of some outputs, by default of all."""
        return assemble(self.frames, outputs or self.outputs, self.flow.specs(), keep_axes)

    def to_dataset(self, *outputs: str) -> Dataset:
        """Some outputs, by default all, and the inputs that label them as labelled dense arrays on the driver."""
        return dataset(self.frames, outputs or self.outputs, self.flow.specs())

    def profile(self) -> DataFrame:
        """Seconds and cells of each output that was measured (``measure=True``), in order."""
        rows = [(o, *self.measured[o]) for o in self.outputs if o in self.measured]
        return next(iter(self.frames.values())).df.sparkSession.createDataFrame(rows, "output string, seconds double, cells bigint")

    def cast(self, types: Mapping[str, str], warn: bool = True) -> Results:
        """Outputs with their values cast."""
        frames = {k: cast(f, types[k], warn) if k in types else f for k, f in self.frames.items()}
        return Results(self.flow, frames, self.outputs, self.run, self.cached, self.measured)

    def unpersist(self) -> None:
        """Let go of what was kept for several readers."""
        for df in self.cached:
            df.unpersist()

    def __enter__(self) -> Results:
        return self

    def __exit__(self, *_: Any) -> None:
        self.unpersist()


def _flat(flow: Flow, inputs: Mapping[str, Any]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    if hasattr(inputs, "model_dump"):
        inputs = inputs.model_dump()
    for k, v in inputs.items():
        if isinstance(v, Mapping) and flow._is_scope(k):
            out |= {f"{k}.{i}": x for i, x in v.items()}
        else:
            out[k] = v
    return out


def check_fixed(flow: Flow, fixed: Mapping[str, int | slice], frames: Mapping[str, Any]) -> None:
    """Raise where a fixed axis isn't there, is reduced, or the index lies outside."""
    axes = flow.axes()
    known = {a for names in axes.values() for a in names if a}
    gone = {a for names in flow.reduced().values() for a in names}
    for a, k in fixed.items():
        if a not in known:
            raise ValueError(f"there is no axis {a!r}")
        if a in gone:
            raise ValueError(f"axis {a!r} is reduced, so it can't be fixed")
        for f in frames.values():
            if isinstance(f, AxisFrame) and a in f.sizes and isinstance(k, int) and not -f.sizes[a] <= k < f.sizes[a]:
                raise IndexError(f"{k} is outside axis {a!r} of size {f.sizes[a]}")


def input_frames(spark: SparkSession, flow: Flow, inputs: Mapping[str, Any]) -> dict[str, Any]:
    """Frames of indexed inputs; other values stay as they are, DataFrames become frames over their axes."""
    axes = flow.axes()
    out: dict[str, Any] = {}
    for name, v in inputs.items():
        if isinstance(v, AxisFrame):
            out[name] = v if v.name == name else v.rename(name)
        elif name in axes or isinstance(v, ByReference):
            if isinstance(v, ByReference):
                v = v.load(spark)
            if name not in axes:
                out[name] = v
                continue
            named = tuple(a or f"{name}_{k}" for k, a in enumerate(axes[name]))
            out[name] = AxisFrame.from_table(v, name, named) if isinstance(v, DataFrame) else AxisFrame.from_values(spark, name, named, v)
        else:
            out[name] = v
    return out


def run_map(
    flow: Flow,
    spark: SparkSession,
    inputs: Mapping[str, Any],
    *,
    outputs: Iterable[str] | None = None,
    fixed: Mapping[str, int | slice] | None = None,
    errors: str = "raise",
    folder: str | None = None,
    storage: str | Mapping[str, str] = "parquet",
    resume: bool = False,
    validation: str = "auto",
    cut: bool = False,
    check: bool = True,
    chunk: int | Callable[[int], int] | None = None,
    measure: bool = False,
    hook: Callable[[Node, dict[str, AxisFrame]], None] | None = None,
) -> Results:
    """Compile a flow over arrays.

    Without ``folder`` the result is lazy: one plan for each output, and nothing runs before it is
    read. With it every node is written as Parquet, and ``resume`` computes only cells that are
    not there yet. ``outputs`` prunes the flow, ``cut`` lets inputs stand for intermediates,
    ``fixed`` selects indices, ``storage`` names the storage kind of all or of each output, and ``errors="continue"`` keeps failures of Python bodies as data.
    ``chunk`` says how many cells a task of an opaque body gets (or computes it from the number of all), where that number
    is known; else Spark's partitions stay. ``measure`` times each node by a job of its own.
    """
    if errors not in ("raise", "continue"):
        raise ValueError(f"errors can't be {errors!r}")
    given = _flat(flow, inputs)
    if outputs is not None or cut:
        flow = flow.sub(given if cut else None, outputs)
    roots = set(flow.roots())
    missing, extra = roots - set(given) - set(flow.defaults()), set(given) - roots
    if missing or extra:
        raise ValueError(f"inputs are missing: {sorted(missing)}; nothing takes: {sorted(extra)}")
    values = input_frames(spark, flow, {**flow.defaults(), **given})
    fixed = dict(fixed or {})
    check_fixed(flow, fixed, values)
    run = None
    if folder is not None:
        run = RunFolder(spark, folder, storage)
        run.open(flow, {**flow.defaults(), **given}, errors=errors, resume=resume, validation=validation)
        for name, v in values.items():
            if isinstance(v, AxisFrame) and v.axes and isinstance(given.get(name), (list, range, np.ndarray)):
                run.write_input(v)
    selected = {k: v.at(**{a: i for a, i in fixed.items() if a in v.axes}) if isinstance(v, AxisFrame) and set(fixed) & set(v.axes) else v for k, v in values.items()}
    takers: dict[str, int] = {}
    for n in flow.nodes:
        for p in n.free:
            takers[p] = takers.get(p, 0) + 1
    cached: list[DataFrame] = []
    measured: dict[str, tuple[float, int]] = {}
    for n in flow.order():
        args = {p: selected[p] if p in selected else n.defaults[p] for p in n.free if p in selected or p in n.defaults}
        if run is not None and resume:
            args = run.only_missing(n, args)
        if chunk is not None and n.kind in OPAQUE:
            args = dealt(args, chunk)
        began = time.perf_counter()
        made = compile_node(spark, n, args, keep_errors=errors == "continue", check=check)
        late = {a: k for a, k in fixed.items() if n.spec is not None and a in n.spec.created}
        if late:
            made = {o: f.at(**late) for o, f in made.items()}
        if run is not None:
            made = run.write(n, made)
        elif n.cache or n.kind == "python" and any(takers.get(o, 0) > 1 for o in n.out):
            for o, f in made.items():  # opaque bodies that several nodes read are computed once
                df = f.df.persist()
                cached.append(df)
                made[o] = f.with_df(df)
        if measure:
            counts = {o: f.df.select(F.count(f"`{o}`"), F.count("*")).first()[1] for o, f in made.items()}
            took = time.perf_counter() - began
            measured |= {o: (took, c) for o, c in counts.items()}
        if hook is not None:
            hook(n, made)
        selected |= made
    frames = {k: v if isinstance(v, AxisFrame) else AxisFrame.from_scalar(spark, k, v) for k, v in selected.items() if isinstance(v, AxisFrame) or isinstance(v, (int, float, str, bool)) or isinstance(v, np.generic)}
    return Results(flow, frames, [o for n in flow.order() for o in n.out], run, cached, measured)


def slots(spark: SparkSession) -> int:
    """How many tasks run at a time."""
    return spark.sparkContext.defaultParallelism


def chunk_size(cells: int, at_once: int, waves: int = 8) -> int:
    """Cells for a task, so that each slot gets about so many tasks and none is left with a long one at the end."""
    return max(1, math.ceil(cells / (at_once * waves)))


def dealt(args: Mapping[str, Any], chunk: int | Callable[[int], int]) -> dict[str, Any]:
    """Arguments with the largest frame of known size dealt over tasks of about ``chunk`` cells."""
    known = {p: cells for p, v in args.items() if isinstance(v, AxisFrame) and v.axes and not v.sparse and (cells := cells_of(v)) is not None}
    if not known:
        return dict(args)
    p = max(known, key=lambda k: known[k])
    size = chunk(known[p]) if callable(chunk) else chunk
    if size < 1:
        raise ValueError(f"a task can't get {size} cells")
    f = args[p]
    return {**args, p: f.with_df(f.df.repartition(max(1, math.ceil(known[p] / size)), *[f"`{a}`" for a in f.axes]))}


class AsyncRun:
    """A run in a thread of its own, whose jobs carry a tag and can be cancelled."""

    def __init__(self, spark: SparkSession, work: Callable[[], Any], start: bool = True) -> None:
        self.spark, self.work, self.tag = spark, work, f"axisloom-{uuid.uuid4().hex}"
        self.future: Future = Future()
        self._thread: threading.Thread | None = None
        if start:
            self.start()

    def start(self) -> AsyncRun:
        if self._thread is None:
            self._thread = InheritableThread(target=self._run, session=self.spark)
            self._thread.daemon = True
            self._thread.start()
        return self

    def _run(self) -> None:
        self.spark.addTag(self.tag)
        try:
            self.future.set_result(self.work())
        except BaseException as e:  # noqa: BLE001  handed to whoever asks for the result
            self.future.set_exception(e)

    def result(self, timeout: float | None = None) -> Any:
        if self._thread is None:
            raise RuntimeError("the run hasn't been started")
        return self.future.result(timeout)

    def done(self) -> bool:
        return self.future.done()

    def cancel(self) -> None:
        """Cancel the run's jobs."""
        self.spark.interruptTag(self.tag)


def run_async(flow: Flow, spark: SparkSession, inputs: Mapping[str, Any], *, start: bool = True, action: Callable[[Results], Any] | None = None, **options: Any) -> AsyncRun:
    """:func:`run_map` in the background; ``action`` is what to do with the results there."""
    return AsyncRun(spark, lambda: (action or (lambda r: r))(run_map(flow, spark, inputs, **options)), start)


def gather_runs(*runs: AsyncRun, at_once: int = 1) -> list[Any]:
    """Results of several runs, ``at_once`` of them at a time."""

    def one(r: AsyncRun) -> Any:
        return r.start().result()

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(one, runs))
