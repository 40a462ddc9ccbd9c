"""From nodes to DataFrames: joins on shared axes, products, grouped reductions, new axes.

One node becomes one plan. Inputs join on the axes they share, those that share none last, as a
product with the smaller side broadcast only where its size is known to be small. Reductions with
an aggregate body stay partial aggregates in the JVM; Python bodies get the reduced cells of each
group as an array in the order of the reduced axes. Nothing is collected on the driver.
"""

from __future__ import annotations

import math
import reprlib
import socket
import time
import traceback
from collections.abc import Callable, Mapping
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisloom.functions.node import OPAQUE, Node
from axisloom.operators.frame import AxisFrame, in_order
from axisloom.plans.spec import notation

#: A side of a product is broadcast when it has at most so many cells.
BROADCAST_CELLS = 100_000
#: A product of known sizes above this is refused.
PRODUCT_CELLS = 10**12

#: What a failed call says of itself, and the whole record. ``arguments`` shows each one, long ones shortened.
FAILED = {"failed": "string", "message": "string", "arguments": "map<string,string>", "traceback": "string", "host": "string", "at": "double"}
ERROR = "struct<kind:string,node:string,type:string,message:string,reason:string,count:bigint,arguments:map<string,string>,traceback:string,host:string,at:double>"
SHOWN = reprlib.Repr(maxstring=200, maxother=200, maxlist=20, maxtuple=20, maxdict=20)


def own_error(node: str, held: Column) -> Column:
    """Record of a call that failed."""
    more = [held[k].alias(k) for k in ("arguments", "traceback", "host", "at")]
    return F.struct(F.lit("error").alias("kind"), F.lit(node).alias("node"), held["failed"].alias("type"), held["message"].alias("message"), F.lit(None).cast("string").alias("reason"), F.lit(1).cast("bigint").alias("count"), *more)


def _failure(e: Exception, args: Mapping[str, Any]) -> tuple:
    """What to keep of a failed call, in the order of ``FAILED``."""
    return type(e).__name__, str(e), {k: SHOWN.repr(v.item() if isinstance(v, np.generic) else v) for k, v in args.items()}, "".join(traceback.format_exception(e)), socket.gethostname(), time.time()


def passed_on(node: str, reason: str, count: Column) -> Column:
    """Record of a call that was skipped because of errors in its inputs."""
    return F.struct(F.lit("propagated").alias("kind"), F.lit(node).alias("node"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("message"), F.lit(reason).alias("reason"), count.cast("bigint").alias("count"), *[F.lit(None).cast(t).alias(k) for k, t in FAILED.items() if k in ("arguments", "traceback", "host", "at")])


def _cells(frame: AxisFrame) -> int | None:
    if all(a in frame.sizes for a in frame.axes):
        return math.prod(frame.sizes[a] for a in frame.axes)
    return None


def join_frames(frames: list[AxisFrame]) -> tuple[DataFrame, tuple[str, ...], dict[str, int]]:
    """Frames joined on shared axes, then multiplied: the DataFrame, its axes and the sizes known."""
    sizes: dict[str, int] = {}
    for f in frames:
        for a in f.axes:
            if a in f.sizes and not f.sparse:
                if sizes.setdefault(a, f.sizes[a]) != f.sizes[a]:
                    raise ValueError(f"axis {a!r} has sizes {sizes[a]} and {f.sizes[a]}")
    left = sorted(frames, key=lambda f: (-len(f.axes), -(_cells(f) or 0)))
    first = left.pop(0)
    df, axes = first.df, first.axes
    while left:
        best = next((f for f in left if set(f.axes) & set(axes)), None)
        if best is not None:
            shared = [a for a in best.axes if a in axes]
            df = df.join(best.df, shared, "inner")
        else:
            best = left[0]
            whole = math.prod(sizes.get(a, 1) for a in {*axes, *best.axes})
            if whole > PRODUCT_CELLS:
                raise ValueError(f"the product over {sorted({*axes, *best.axes})} has {whole} cells")
            cells = 1 if not best.axes else _cells(best)
            other = F.broadcast(best.df) if cells is not None and cells <= BROADCAST_CELLS else best.df
            df = df.crossJoin(other)
        axes += tuple(a for a in best.axes if a not in axes)
        left.remove(best)
    return df, axes, sizes


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def _python(node: Node, types: list[str], names: list[str], ranks: Mapping[str, int], plain: Mapping[str, Any], keep_errors: bool) -> Callable[..., Column]:
    """The body as an Arrow-batched function from columns to a struct of outputs (and of an error)."""
    fields = [f"o{k}:{t}" for k, t in enumerate(types)]
    if keep_errors:
        fields += [f"{k}:{t}" for k, t in FAILED.items()]
    outs = node.out

    def one(args: dict[str, Any]) -> tuple:
        result = node(**args)
        return tuple(_out(node.pick(result, o)) for o in outs)

    def run(skip: pd.Series, *series: pd.Series) -> pd.DataFrame:
        rows = []
        for skipped, *cells in zip(skip, *series, strict=True):
            if skipped:  # its inputs hold errors, so the body isn't called
                rows.append((None,) * len(fields))
                continue
            args = {**plain, **{n: _arg(c, ranks.get(n, 0)) for n, c in zip(names, cells, strict=True)}}
            if keep_errors:
                try:
                    rows.append((*one(args), *[None] * len(FAILED)))
                except Exception as e:  # noqa: BLE001  errors of bodies are data here
                    rows.append((*[None] * len(outs), *_failure(e, args)))
            else:
                rows.append(one(args))
        return pd.DataFrame({f.split(":")[0]: pd.Series([r[k] for r in rows], dtype=object) for k, f in enumerate(fields)})

    return F.pandas_udf(run, T._parse_datatype_string(f"struct<{','.join(fields)}>"))


def _batched(node: Node, types: list[str], names: list[str], ranks: Mapping[str, int], plain: Mapping[str, Any], keep_errors: bool) -> Callable[..., Column]:
    """The body over whole Arrow batches: a pandas Series for each argument in, one for each output back.

    Cells whose inputs hold errors don't reach the body. Where a batch fails and errors are kept, its cells are called one by one.
    """
    fields = [f"o{k}:{t}" for k, t in enumerate(types)]
    if keep_errors:
        fields += [f"{k}:{t}" for k, t in FAILED.items()]
    outs = node.out

    def call(args: dict[str, Any], index: pd.Index) -> list[pd.Series]:
        result = node(**plain, **args)
        series = [pd.Series(node.pick(result, o)) for o in outs]
        if any(len(s) != len(index) for s in series):
            raise ValueError(f"{node.name} gave {[len(s) for s in series]} cells for {len(index)}")
        return [s.set_axis(index) for s in series]

    def run(skip: pd.Series, *series: pd.Series) -> pd.DataFrame:
        given = {n: s.map(lambda c, r=ranks.get(n, 0): _arg(c, r)) if ranks.get(n) else s for n, s in zip(names, series, strict=True)}
        index = skip.index[~skip.astype(bool)]
        out = pd.DataFrame({f.split(":")[0]: pd.Series([None] * len(skip), skip.index, object) for f in fields})
        if not len(index):
            return out
        try:
            for k, s in enumerate(call({n: s.loc[index] for n, s in given.items()}, index)):
                if len(index) == len(skip):
                    out[f"o{k}"] = s
                else:
                    out.loc[index, f"o{k}"] = s.astype(object)
        except Exception:
            if not keep_errors:
                raise
            for i in index:
                one = {n: s.loc[[i]] for n, s in given.items()}
                try:
                    values = [s.loc[i] for s in call(one, pd.Index([i]))]
                    for k, v in enumerate(values):
                        out.at[i, f"o{k}"] = _out(v)
                except Exception as e:  # noqa: BLE001  errors of bodies are data here
                    for f, v in zip(FAILED, _failure(e, {n: s.loc[i] for n, s in one.items()}), strict=True):
                        out.at[i, f] = v
        return out

    return F.pandas_udf(run, T._parse_datatype_string(f"struct<{','.join(fields)}>"))


def _arg(cell: Any, rank: int) -> Any:
    """A reduced argument arrives as (index, value) cells; its array is as large as the largest index."""
    if not rank:
        return cell.item() if isinstance(cell, np.generic) else cell
    rows = [tuple(c.values()) if isinstance(c, dict) else tuple(c) for c in cell]
    shape = tuple(max((r[k] for r in rows), default=-1) + 1 for k in range(rank))
    out, seen = np.empty(shape, object), np.zeros(shape, bool)
    for r in rows:
        out[r[:rank]], seen[r[:rank]] = r[rank], True
    return out if seen.all() else np.ma.MaskedArray(out, ~seen)


def _out(value: Any) -> Any:
    return value.tolist() if isinstance(value, np.ndarray) else value.item() if isinstance(value, np.generic) else value


def compile_node(spark: Any, node: Node, values: Mapping[str, Any], *, keep_errors: bool = False, check: bool = True) -> dict[str, AxisFrame]:
    """Frames of a node's outputs. ``values`` holds a frame or a plain value for each parameter that isn't bound."""
    spec = node.spec
    out_axes = spec.axes if spec else ()
    frames: dict[str, AxisFrame] = {p: v for p in node.free if isinstance(v := values.get(p), AxisFrame)}
    plain = {p: values[p] for p in node.free if p in values and p not in frames}
    for p, f in list(frames.items()):
        ref = spec.ref(p) if spec else None
        if ref is not None:
            if len(ref.axes) != len(f.axes):
                raise ValueError(f"{p!r} has the axes {f.axes}, {node.name} reads {notation([ref])}")
            frames[p] = f.rename_axes({a: b for a, b in zip(f.axes, ref.axes, strict=True) if b is not None and a != b})
        if f.name != p:
            frames[p] = frames[p].rename(p)
    kept = tuple(a for a in out_axes if any(a in f.axes and (spec.ref(p) is not None and a in spec.ref(p).axes) for p, f in frames.items()))
    gone = {p: tuple(a for a in f.axes if not (spec and spec.ref(p) is not None and a in spec.ref(p).axes)) for p, f in frames.items()}
    created = tuple(a for a in out_axes if a not in kept)
    errors = {p: f.error for p, f in frames.items() if f.error}

    ranks: dict[str, int] = {}
    joined: list[AxisFrame] = []
    aggregate = node.kind == "aggregate"
    for p, f in frames.items():
        if not aggregate and gone[p]:
            f = _gathered(f, gone[p], p)
            ranks[p] = len(gone[p]) if node.kind in OPAQUE else 0
            if node.kind not in OPAQUE:
                f = f.with_df(f.df.withColumn(p, F.transform(column(p), lambda c: c["v"])))
        joined.append(f)
    if joined:
        df, _, sizes = join_frames(joined)
    else:
        df, sizes = spark.range(1).drop("id"), {}

    names = [p for p in node.free if p in frames]
    args: dict[str, Any] = {p: column(p) for p in names} | {p: (v if node.kind in OPAQUE else _literal(v)) for p, v in plain.items()}
    bad = _error_of_inputs(node, frames, gone, errors, aggregate)

    if aggregate:
        result = node(**args)
        outs = result if len(node.out) > 1 else (result,)
        extra = [bad.alias("_bad")] if bad is not None else []
        columns = [c.alias(f"_o{k}") for k, c in enumerate(outs)] + extra
        grouped = df.groupBy(*[column(a) for a in kept]).agg(*columns)
        held = F.struct(*[column(f"_o{k}").alias(f"o{k}") for k in range(len(outs))])
        df = grouped.select(*kept, held.alias("_s"), *(["_bad"] if extra else []))
    else:
        if node.kind == "sql":
            held = F.struct(F.expr(node.body).alias("o0"))
            for p, v in {**plain, **node.defaults, **node.bound}.items():
                if p not in names:
                    df = df.withColumn(p, _literal(v))
        elif node.kind in OPAQUE:
            if node.returns is None:
                raise ValueError(f"{node.name} needs the Spark types it returns")
            types = list(node.returns)
            if created:
                types = [_nested(t, len(created)) for t in types]
            if not names and node.kind == "batch":
                raise ValueError(f"{node.name} takes no arrays, so there are no batches; use a python body")
            run = (_python if node.kind == "python" else _batched)(node, types, names, ranks, plain, keep_errors)
            held = run(F.lit(False) if bad is None else bad.isNotNull(), *[column(p) for p in names])
        else:
            result = node(**args)
            outs = [result] if len(node.out) == 1 else [node.pick(result, o) for o in node.out]
            held = F.struct(*[(c if isinstance(c, Column) else _literal(c)).alias(f"o{k}") for k, c in enumerate(outs)])
        axes = [column(a) for a in kept]
        if bad is not None:  # CASE keeps native bodies off rows with errors
            held = held if node.kind in OPAQUE else F.when(bad.isNull(), held)
            df = df.select(*axes, held.alias("_s"), bad.alias("_bad"))
        else:
            df = df.select(*axes, held.alias("_s"))

    error = None
    fields = {f.name for f in df.schema["_s"].dataType.fields}
    if keep_errors and ("failed" in fields or "_bad" in df.columns):
        failed = F.when(column("_s")["failed"].isNotNull(), own_error(node.name, column("_s"))) if "failed" in fields else F.lit(None).cast(ERROR)
        df = df.withColumn("_error", F.coalesce(column("_bad") if "_bad" in df.columns else F.lit(None).cast(ERROR), failed))
        error = "_error"
    sparse = any(f.sparse for f in joined)
    known = {a: sizes[a] for a in kept if a in sizes}
    out: dict[str, AxisFrame] = {}
    for k, o in enumerate(node.out):
        value = column("_s")[f"o{k}"]
        own = f"{o}__error"
        if error:
            picked = F.when(column(error).isNull(), value).alias(o)
            out[o] = AxisFrame(df.select(*kept, picked, column(error).alias(own)), o, kept, known, sparse, own)
        else:
            out[o] = AxisFrame(df.select(*kept, value.alias(o)), o, kept, known, sparse)
        if created:
            out[o] = spread(out[o], created, out_axes, check=check and not sparse, once=node.kind in OPAQUE)
        elif out[o].axes != tuple(out_axes):
            out[o] = out[o].with_df(out[o].df, axes=tuple(out_axes))
    return out


def _literal(v: Any) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, np.ndarray):
        v = v.tolist()
    if isinstance(v, Mapping):
        return F.struct(*[_literal(x).alias(k) for k, x in v.items()])
    if isinstance(v, (list, tuple, range)):
        return F.array(*[_literal(x) for x in v])
    return F.lit(v)


def _nested(t: str, depth: int) -> str:
    for _ in range(depth):
        t = f"array<{t}>"
    return t


def _gathered(f: AxisFrame, gone: tuple[str, ...], name: str) -> AxisFrame:
    """Reduced axes folded into one array of (index..., v), in row-major order."""
    kept = tuple(a for a in f.axes if a not in gone)
    cells = F.array_sort(F.collect_list(F.struct(*[column(a).alias(f"k{i}") for i, a in enumerate(gone)], column(f.name).alias("v"))))
    more = []
    if f.error:
        more = [F.sum(column(f.error).isNotNull().cast("bigint")).alias(f"{f.error}_n")]
    df = f.df.groupBy(*[column(a) for a in kept]).agg(cells.alias(name), *more)
    return f.with_df(df, axes=kept, sizes={a: n for a, n in f.sizes.items() if a in kept})


def _error_of_inputs(node: Node, frames: Mapping[str, AxisFrame], gone: Mapping[str, tuple], errors: Mapping[str, str], aggregate: bool) -> Column | None:
    """The record that inputs with errors give a cell: a whole error wins over errors inside an array."""
    found = []
    for p, e in errors.items():
        if not gone[p]:
            here = column(e).isNotNull()
            if aggregate:
                here = F.max(here.cast("int")) > 0
            found.append(F.when(here, passed_on(node.name, "input_is_error", F.lit(1))))
    for p, e in errors.items():
        if gone[p]:
            n = F.sum(column(e).isNotNull().cast("bigint")) if aggregate else column(f"{e}_n")
            found.append(F.when(n > 0, passed_on(node.name, "array_contains_errors", n)))
    return F.coalesce(*found) if found else None


def _lengths(c: Column, depth: int) -> list[Column]:
    """The length of an array, then of all arrays in it put together, level by level."""
    found = [F.size(c)]
    for _ in range(depth - 1):
        c = F.flatten(c)
        found.append(F.size(c))
    return found


def spread(f: AxisFrame, created: tuple[str, ...], out_axes: tuple[str, ...], *, check: bool = True, once: bool = False) -> AxisFrame:
    """One row for each element of an array cell, with its position as a new axis; nested for several.

    All arrays along a new axis must have one length, which is checked as rows pass where ``check``
    holds: arrays of another length than others make the job fail. The lengths are a plan of their own. With ``once`` (bodies that are
    opaque, dear or random) both plans read one exchange of the arrays, so that the body runs once for each cell;
    native bodies are computed again for their lengths alone, without an exchange.
    """
    df, name = f.df, f.name
    keep = [column(a) for a in f.axes] + ([column(f.error)] if f.error else [])
    if f.error:
        # an error cell stands for its whole inner array, so it stays one row with index 0
        df = df.withColumn(name, F.when(column(f.error).isNotNull(), F.array(F.lit(None).cast(df.schema[name].dataType.elementType))).otherwise(column(name)))
    if check and f.axes and not f.error:
        mark = F.hash(*[column(a) for a in f.axes])
        if once:  # both plans need the same columns, so that they share the exchange
            df = df.repartition(*[column(a) for a in f.axes])
        lengths = _lengths(column(name), len(created))
        ends = [g(n).alias(f"_{g.__name__}{k}") for k, n in enumerate(lengths) for g in (F.min, F.max)]
        one = df.agg(*ends, *([F.max(mark).alias("_mark")] if once else []))
        df = df.crossJoin(F.broadcast(one))  # one row
        even = F.lit(True)
        for k in range(len(created)):
            even = even & (column(f"_min{k}") == column(f"_max{k}"))
        if once:
            even = even & (mark <= column("_mark"))
        kind = df.schema[name].dataType
        uneven = F.raise_error(F.lit(f"arrays of {name} differ in length")).cast(kind)
        df = df.withColumn(name, F.when(even, column(name)).otherwise(uneven))
    for a in created:
        df = df.select(*keep, F.posexplode(column(name)).alias(a, name)).withColumn(a, column(a).cast("bigint"))
        keep.append(column(a))
    return f.with_df(df, axes=tuple(out_axes))


def ordered(f: AxisFrame, axes: tuple[str, ...]) -> Column:
    """Aggregate: values of a frame as an array ordered by some of its axes."""
    return in_order(f.value(), axes)
