"""Failed calls: what they were called with, what caused them, and calling them again."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisloom.functions.node import Node
from axisloom.operators.compile import join_frames
from axisloom.operators.frame import AxisFrame
from axisloom.plans.flow import Flow


def failures(frame: AxisFrame) -> DataFrame:
    """Cells with an error record: axes and ``error``. An empty table where errors aren't kept."""
    axes = [f"`{a}`" for a in frame.axes]
    if not frame.error:
        return frame.df.select(*axes, F.lit(None).cast("string").alias("error")).limit(0)
    return frame.df.filter(F.col(f"`{frame.error}`").isNotNull()).select(*axes, F.col(f"`{frame.error}`").alias("error"))


def failed_calls(node: Node, frames: Mapping[str, AxisFrame], out: AxisFrame) -> DataFrame:
    """Arguments of the calls that failed themselves, with their axes and error; for element-wise nodes."""
    own = failures(out).filter("error.kind = 'error'")
    args, _, _ = join_frames([f.rename_axes({a: b for a, b in zip(f.axes, node.spec.ref(p).axes, strict=True) if b and a != b}) if node.spec and node.spec.ref(p) else f for p, f in frames.items() if p in node.free])
    return own.join(args, list(out.axes), "inner") if out.axes else own.crossJoin(args)


def reproduce(node: Node, row: Any, **plain: Any) -> Any:
    """Call a node again on a row of :func:`failed_calls`; raises what the body raises."""
    values = row.asDict(recursive=True)
    return node(**plain, **{p: values[p] for p in node.free if p in values})


def root_causes(flow: Flow, frames: Mapping[str, AxisFrame], name: str) -> DataFrame:
    """For each skipped cell of an output the errors that it goes back to: its axes, ``cause`` (an output) and ``error``.

    Errors inside a reduced array are causes of every cell of the output they share axes with. Where they share no
    axis, they are causes of all skipped cells alike, and stand once, with null axes.
    """
    skipped = failures(frames[name]).filter("error.kind = 'propagated'").drop("error")
    out: DataFrame | None = None
    for up in flow.upstream(name):
        f = frames[up]
        if not f.error:
            continue
        shared = [a for a in f.axes if a in frames[name].axes]
        origin = failures(f).filter("error.kind = 'error'").withColumn("cause", F.lit(up)).select(*shared, "cause", "error")
        if shared:
            found = skipped.join(origin, shared)
        else:
            found = origin
            for a in frames[name].axes:
                found = found.withColumn(a, F.lit(None).cast(frames[name].df.schema[a].dataType))
        found = found.select(*[f"`{a}`" for a in frames[name].axes], "cause", "error")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return skipped.withColumn("cause", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string")).limit(0)
    return out


def save_failures(frame: AxisFrame, path: str) -> None:
    """Keep error records as a Parquet table."""
    failures(frame).write.mode("overwrite").parquet(path)
