"""More of the query catalogue: what flows, nodes, specs, sweeps, caches and run folders say and do.

Each goes through the operator it is named for; its SQL gives the expected rows from the tables, or as plain values.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisloom.functions import cache as caches
from axisloom.functions.node import Node, Resources, attribute, chain, gather, nest, node
from axisloom.operators import errors
from axisloom.operators.frame import AxisFrame, space
from axisloom.operators.table import assemble
from axisloom.plans import spec as specs
from axisloom.plans.flow import Flow, UnusedInputs, VariantFlow
from axisloom.plans.run import gather_runs, run_async
from axisloom.plans.spec import IndexSpec
from axisloom.plans.types import Array, compatible, same, same_dicts
from axisloom.queries import query
from axisloom.sources.store import ResumeError, RunFolder, register_storage, scratch_folder, storage
from axisloom.sources.sweep import Sweep, fixed_points, set_caches, sweep_inputs
from axisloom.sources.tables import ByReference, read_any, read_inputs, read_table
from axisloom.streaming.status import Running, read_heartbeat, write_heartbeat

PRICES = "SELECT o_orderkey AS o, {} FROM orders"


def _price(spark: SparkSession, d: str, name: str = "x") -> AxisFrame:
    return AxisFrame.from_table(read_table(spark, d, "orders"), name, ["o_orderkey"], "o_totalprice").rename_axes({"o_orderkey": "o"})


def _rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def _shown(x: Any) -> str:
    """Nested tuples as text, the same in Python and in the SQL twins."""
    if isinstance(x, (tuple, list)):
        return "(" + " ".join(map(_shown, x)) + ")"
    return "-" if x is None else ":" if x == slice(None) else str(x)


def _refused(call: Any, kind: type[Exception] | tuple = ValueError) -> bool:
    try:
        call()
    except kind:
        return True
    return False


def _plus(x):
    return x + 1


def _times(y):
    return y * 2


def _line() -> Flow:
    return Flow([Node(_plus, "y", spec="x[o] -> y[o]"), Node(_times, "z", spec="y[o] -> z[o]")])


# specs


@query("SELECT * FROM (VALUES ('in', 'u', 0, 'p'), ('in', 'u', 1, '-'), ('in', 'v', 0, 'q'), ('out', 'w', 0, 'q'), ('out', 'w', 1, 'p')) t(side, name, place, axis)")
def spec_slots(spark: SparkSession, d: str) -> DataFrame:
    found = IndexSpec.parse("u[p, :], v[q] -> w[q, p]").slots()
    return _rows(spark, [("out" if s.made else "in", s.array, s.place, s.axis or "-") for s in found], "side string, name string, place int, axis string")


@query("SELECT * FROM (VALUES ('... -> x[i]'), ('a[i, :], s.b[j] -> c[i, j]'), ('a[i] -> b[i], c[i]')) t(notation)")
def spec_text(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [(str(IndexSpec.parse(t)),) for t in ("...->x[ i ]", "a[i,:],s.b[j]->c[i,j]", "a[i] -> b[i],c[i]")], "notation string")


@query("SELECT * FROM (VALUES ('(6 4 ?)', '(True True False)'), ('(6 4 9)', '(True True False)')) t(shape, mapped)")
def spec_shape(spark: SparkSession, d: str) -> DataFrame:
    s = IndexSpec.parse("u[p, q], v[q] -> w[q, p, inner]")
    found = [s.shape({"u": (4, 6), "v": (6,)}, internal) for internal in (None, {"w": (9,)})]
    return _rows(spark, [(_shown(shape), _shown(mapped)) for shape, mapped in found], "shape string, mapped string")


@query("SELECT n::INTEGER AS n, (n // 10 % 4)::INTEGER AS a, (n // 2 % 5)::INTEGER AS b, (n % 2)::INTEGER AS c FROM (SELECT unnest(range(40)) AS n)")
def spec_positions(spark: SparkSession, d: str) -> DataFrame:
    s = IndexSpec.parse("u[a, b], v[c] -> w[a, b, c]")
    return _rows(spark, [(n, *s.position((4, 5, 2), n).values()) for n in range(40)], "n int, a int, b int, c int")


@query("SELECT n::INTEGER AS n, '(' || n // 3 || ' :)' AS u, '(' || n % 3 || ')' AS v FROM (SELECT unnest(range(12)) AS n)")
def spec_reads(spark: SparkSession, d: str) -> DataFrame:
    s = IndexSpec.parse("u[a, :], v[b] -> w[a, b]")
    return _rows(spark, [(n, *map(_shown, s.reads((4, 3), n).values())) for n in range(12)], "n int, u string, v string")


@query("SELECT * FROM (VALUES ('more', 'u[a, k], v[b, k] -> w[a, b, k]'), ('names', 'x[a], v[b] -> y[a, b]'), ('axes', 'u[t], v[b] -> w[t, b]')) t(change, notation)")
def spec_rewrites(spark: SparkSession, d: str) -> DataFrame:
    s = IndexSpec.parse("u[a], v[b] -> w[a, b]")
    found = {"more": s.rewrite(more=["k"]), "names": s.rewrite({"u": "x", "w": "y"}), "axes": s.rewrite(axes={"a": "t"})}
    return _rows(spark, [(k, str(v)) for k, v in found.items()], "change string, notation string")


@query("SELECT * FROM (VALUES ('(7 3 2)', '(6 2 1)'), ('(5)', '(1)'), ('()', '()')) t(shape, strides)")
def spec_strides(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [(_shown(s), _shown(specs.strides(s))) for s in ((7, 3, 2), (5,), ())], "shape string, strides string")


_SEVERAL = ("u[p, q], v[q] -> m[p, q]", "m[p, :] -> low[p]", "low[p], v[q] -> top[q, p]")


@query("SELECT * FROM (VALUES ('u', 2, '(p q)', '()'), ('v', 1, '(q)', '()'), ('m', 2, '(p q)', '(q)'), ('low', 1, '(p)', '()'), ('top', 2, '(q p)', '()')) t(name, rank, axes, reduced)")
def spec_axes(spark: SparkSession, d: str) -> DataFrame:
    many = [IndexSpec.parse(t) for t in _SEVERAL]
    axes, ranks, gone = specs.axes_of(many), specs.ranks(many), specs.reduced_axes(many)
    return _rows(spark, [(k, ranks[k], _shown(axes[k]), _shown(sorted(gone.get(k, ())))) for k in axes], "name string, rank int, axes string, reduced string")


@query("SELECT * FROM (VALUES ('m', 'u', '(p q)'), ('m', 'v', '(q)'), ('low', 'u', '(p)'), ('top', 'u', '(p)'), ('top', 'v', '(q)')) t(out, root, axes)")
def spec_lineage(spark: SparkSession, d: str) -> DataFrame:
    found = specs.lineage([IndexSpec.parse(t) for t in _SEVERAL])
    return _rows(spark, [(o, r, _shown(a)) for o, roots in found.items() for r, a in roots.items()], "out string, root string, axes string")


@query("SELECT * FROM (VALUES ('nested', '(2 3)'), ('ragged', '(2)'), ('range', '(5)'), ('array', '(4 1 2)'), ('empty', '(0)')) t(kind, shape)")
def array_shapes(spark: SparkSession, d: str) -> DataFrame:
    found = {"nested": specs.shape_of([[1, 2, 3], [4, 5, 6]]), "ragged": specs.regular_shape([[1], [2, 3]]), "range": specs.shape_of(range(5)), "array": specs.shape_of(np.zeros((4, 1, 2))), "empty": specs.shape_of([])}
    return _rows(spark, [(k, _shown(v)) for k, v in found.items()], "kind string, shape string")


@query("SELECT k::INTEGER AS k, k % 3 = 0 AS missing FROM (SELECT unnest(range(10)) AS k)")
def array_mask(spark: SparkSession, d: str) -> DataFrame:
    masked = np.ma.masked_where(np.arange(10) % 3 == 0, np.arange(10))
    return _rows(spark, list(enumerate(specs.mask_of(masked))), "k int, missing boolean")


@query("SELECT * FROM (VALUES ('(1 a 2 b)')) t(woven)")
def array_weave(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [(_shown(specs.weave([False, True, False, True], "ab", (1, 2))),)], "woven string")


@query("SELECT i::INTEGER AS i, j::INTEGER AS j FROM (SELECT unnest(range(6)) AS i), (SELECT unnest(range(4)) AS j)")
def array_index_space(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, specs.index_space((6, 4)), "i int, j int")


@query("SELECT * FROM (VALUES ('sizes', true), ('ranks', true), ('names', true), ('output axes', true), ('fine', false)) t(spec, refused)")
def spec_refusals(spark: SparkSession, d: str) -> DataFrame:
    """Sizes that differ, ranks and axis names that don't agree, and axes that no output has."""
    both = Flow([Node(lambda u, v: u + v, "w", spec="u[a], v[a] -> w[a]")])
    many = lambda *texts: specs.check_axes([IndexSpec.parse(t) for t in texts])
    found = {
        "sizes": lambda: both.map(spark, {"u": [1, 2], "v": [1, 2, 3]}),
        "ranks": lambda: many("u[a, b] -> w[a, b]", "w[a] -> z[a]"),
        "names": lambda: many("u[a, b] -> w[a, b]", "w[b, c] -> z[b, c]"),
        "output axes": lambda: IndexSpec.parse("u[a, b] -> w[a]"),
        "fine": lambda: many("u[a, b] -> w[a, b]", "w[a, :] -> z[a]"),
    }
    return _rows(spark, [(k, _refused(f)) for k, f in found.items()], "spec string, refused boolean")


# axes of flows


@query(PRICES.format("2 * (o_totalprice + 1) AS z"))
def flow_add_axis(spark: SparkSession, d: str) -> DataFrame:
    """A flow of single values, mapped over an axis that is added to its input."""
    flow = Flow([Node(_plus, "y"), Node(_times, "z")])
    flow.add_axis("x", axis="o")
    return flow.map(spark, {"x": _price(spark, d)})["z"].df


@query("SELECT r_regionkey AS r, s_nationkey AS n, 10 * r_regionkey + s_nationkey AS y FROM region, (SELECT DISTINCT n_nationkey AS s_nationkey FROM nation)")
def flow_add_two_axes(spark: SparkSession, d: str) -> DataFrame:
    """Two inputs with an axis each: a product."""
    flow = Flow([Node(lambda a, b: 10 * a + b, "y")])
    flow.add_axis("a", axis="r")
    flow.add_axis("b", axis="n")
    a = AxisFrame.from_table(read_table(spark, d, "region").select(F.col("r_regionkey").alias("r"), F.col("r_regionkey").alias("a")), "a", ["r"])
    b = AxisFrame.from_table(read_table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_nationkey").alias("b")), "b", ["n"])
    return flow.map(spark, {"a": a, "b": b})["y"].df


@query("SELECT * FROM (VALUES ('u', '(4 6)'), ('m', '(4 6)'), ('low', '(4)')) t(name, shape)")
def flow_shapes(spark: SparkSession, d: str) -> DataFrame:
    flow = Flow([Node(lambda u: u, "m", spec="u[p, q] -> m[p, q]"), Node(lambda m: F.sum(m), "low", kind="aggregate", spec="m[p, :] -> low[p]")])
    return _rows(spark, [(k, _shown(v)) for k, v in flow.shapes({"u": np.zeros((4, 6))}).items()], "name string, shape string")


@query("SELECT * FROM (VALUES ('m', '(p q)'), ('low', '(p)'), ('made', '()')) t(out, axes)")
def flow_independent_axes(spark: SparkSession, d: str) -> DataFrame:
    flow = Flow([Node(lambda u: u, "m", spec="u[p, q] -> m[p, q]"), Node(lambda m: F.sum(m), "low", kind="aggregate", spec="m[p, :] -> low[p]"), Node(lambda: [1], "made", kind="arrays", spec="... -> made[k]")])
    return _rows(spark, [(o, _shown(flow.independent_axes(o))) for o in ("m", "low", "made")], "out string, axes string")


@query("SELECT * FROM (VALUES ('x[o] -> y[o]'), ('y[o] -> z[o]'), ('... -> n[k]'), ('n[k] -> m[k]')) t(notation)")
def flow_specs(spark: SparkSession, d: str) -> DataFrame:
    """Specs of all nodes; one that is missing is inferred from those who read the output."""
    flow = _line().join(Node(lambda: F.array(F.lit(1)), "n", kind="arrays"), Node(lambda n: n, "m", spec="n[k] -> m[k]"))
    return _rows(spark, [(str(s),) for s in flow.specs()], "notation string")


@query("SELECT k, v FROM (SELECT unnest(range(5)) AS k, unnest(range(10, 15)) AS v)")
def flow_inferred_axis(spark: SparkSession, d: str) -> DataFrame:
    """A node without inputs or spec makes an array that others index."""
    flow = Flow([Node(lambda: F.sequence(F.lit(10).cast("bigint"), F.lit(14).cast("bigint")), "n", kind="arrays"), Node(lambda n: n, "v", spec="n[k] -> v[k]")])
    return flow.map(spark, {})["v"].df


@query("SELECT ps AS q, c AS p, c + 10 * ps AS w FROM (SELECT unnest(range(3)) AS c), (SELECT unnest(range(4)) AS ps)")
def flow_permuted_axes(spark: SparkSession, d: str) -> DataFrame:
    flow = Flow([Node(lambda u: u, "w", spec="u[p, q] -> w[q, p]")])
    return flow.map(spark, {"u": np.array([[p + 10 * q for q in range(4)] for p in range(3)])})["w"].df.select("q", "p", "w")


# flows


@query(PRICES.format("o_totalprice + 1 AS y, o_totalprice - 1 AS w"))
def flow_join(spark: SparkSession, d: str) -> DataFrame:
    both = Flow([Node(_plus, "y", spec="x[o] -> y[o]")]) | Flow([Node(lambda x: x - 1, "w", spec="x[o] -> w[o]")])
    return both.map(spark, {"x": _price(spark, d)}).to_table("y", "w", keep_axes=True).select("o", "y", "w")


@query("SELECT * FROM (VALUES (0, 'y z'), (1, 'q')) t(part, outputs)")
def flow_split(spark: SparkSession, d: str) -> DataFrame:
    parts = _line().join(Node(lambda p: p, "q")).split()
    return _rows(spark, [(k, " ".join(sorted(f.makers()))) for k, f in enumerate(parts)], "part int, outputs string")


@query(PRICES.format("3 * (o_totalprice + 1) AS z"))
def flow_replace(spark: SparkSession, d: str) -> DataFrame:
    """A node dropped, one added, one replaced."""
    flow = _line()
    flow.drop("z")
    flow.add(Node(lambda y: y, "z"), "y[o] -> z[o]")
    flow.replace(Node(lambda y: 3 * y, "z", spec="y[o] -> z[o]"))
    return flow.map(spark, {"x": _price(spark, d)})["z"].df


@query("SELECT c_custkey::BIGINT AS k, 4 * (c_custkey + 1)::BIGINT AS w, 1::BIGINT AS nodes FROM customer WHERE c_custkey < 50")
def flow_simplified(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that feed one another with the same roots are fused; the fused flow gives the same values."""
    flow = Flow([Node(_plus, "y"), Node(_times, "z"), Node(lambda z: z * 2, "w")]).simplified()
    n = len(flow.nodes)
    flow.add_axis("x", axis="k")
    x = AxisFrame.from_table(read_table(spark, d, "customer").filter("c_custkey < 50").select(F.col("c_custkey").alias("k"), F.col("c_custkey").alias("x")), "x", ["k"])
    return flow.map(spark, {"x": x})["w"].df.withColumn("nodes", F.lit(n).cast("bigint")).select(F.col("k").cast("bigint").alias("k"), F.col("w").cast("bigint").alias("w"), "nodes")


def _parcel() -> Flow:
    def volume(width, height):
        return width * height

    def weight(volume, density=2):
        return volume * density

    def fee(volume, weight, rate):
        return rate * (volume + weight)

    return Flow([Node(fee, "fee"), Node(volume, "volume"), Node(weight, "weight")])


@query("SELECT * FROM (VALUES ('fee', 'density height rate width', 'volume weight', ''), ('volume', 'height width', '', 'fee weight'), ('weight', 'density height width', 'volume', 'fee')) t(out, roots, upstream, downstream)")
def flow_dependencies(spark: SparkSession, d: str) -> DataFrame:
    flow = _parcel()
    return _rows(spark, [(o, " ".join(flow.roots(o)), " ".join(flow.upstream(o)), " ".join(flow.downstream(o))) for o in sorted(flow.makers())], "out string, roots string, upstream string, downstream string")


@query("SELECT * FROM (VALUES (0, 'volume', true, false), (1, 'weight', false, false), (2, 'fee', false, true)) t(generation, out, source, leaf)")
def flow_generations(spark: SparkSession, d: str) -> DataFrame:
    flow = _parcel()
    return _rows(spark, [(k, n.out[0], n in flow.sources(), n in flow.leaves()) for k, level in enumerate(flow.generations()) for n in level], "generation int, out string, source boolean, leaf boolean")


@query("SELECT * FROM (VALUES ('density rate volume'), ('rate volume weight'), ('density height rate width'), ('height rate weight width')) t(arguments)")
def flow_argument_sets(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [(" ".join(s),) for s in _parcel().argument_sets("fee")], "arguments string")


@query("SELECT * FROM (VALUES ('inputs', 'density height rate width'), ('outputs', 'fee volume weight'), ('intermediate_outputs', 'volume weight'), ('required_inputs', 'height rate width'), ('optional_inputs', 'density')) t(what, names)")
def flow_info(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, [(k, " ".join(v)) for k, v in _parcel().info().items()], "what string, names string")


@query(PRICES.format("o_totalprice * 5 + 7 AS y"))
def flow_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Defaults of a node, changed on the node, then on the flow."""
    n = Node(lambda x, a=1, b=2: x * a + b, "y", spec="x[o] -> y[o]")
    n.update_defaults({"b": 3})
    flow = Flow([n])
    flow.update_defaults({"a": 5, "b": 7})
    return flow.map(spark, {"x": _price(spark, d)})["y"].df


@query(PRICES.format("2 * (o_totalprice + 1) AS total"))
def flow_renames(spark: SparkSession, d: str) -> DataFrame:
    flow = _line()
    flow.update_renames({"x": "price", "z": "total"})
    return flow.map(spark, {"price": _price(spark, d, "price")})["total"].df


@query("SELECT o_orderkey AS k, o_totalprice + 2 AS y FROM orders")
def node_renames(spark: SparkSession, d: str) -> DataFrame:
    """Parameters, outputs and axes of a node renamed, and a bound value."""
    n = Node(lambda a, b: a + b, "c", spec="a[i] -> c[i]", renames={"a": "u"})
    n.update_renames({"a": "x", "c": "y"}, update_from="original")
    n.update_axes({"i": "k"})
    n.update_bound({"b": 2})
    return Flow([n]).map(spark, {"x": _price(spark, d).rename_axes({"o": "k"})})["y"].df


@query(PRICES.format('2 * (o_totalprice + 1) AS "s.z"'))
def flow_scope(spark: SparkSession, d: str) -> DataFrame:
    """Names under a scope; inputs come as a dict of it."""
    flow = _line()
    flow.update_scope("s", inputs="*", outputs="*")
    return flow.map(spark, {"s": {"x": _price(spark, d)}})["s.z"].df


@query("SELECT * FROM (VALUES ('n.x', 'n.y'), ('x', 'y')) t(parameter, out)")
def node_scope(spark: SparkSession, d: str) -> DataFrame:
    n = Node(_plus, "y")
    n.update_scope("n", inputs="*", outputs="*")
    back = n.copy()
    back.update_scope(None, inputs="*", outputs="*")
    return _rows(spark, [(m.parameters[0], m.out[0]) for m in (n, back)], "parameter string, out string")


@query(PRICES.format("o_totalprice + 1 AS y"))
def flow_copy(spark: SparkSession, d: str) -> DataFrame:
    """A change of a copy doesn't reach the flow."""
    flow = _line()
    other = flow.copy(name="other")
    other.replace(Node(lambda x: x - 100, "y", spec="x[o] -> y[o]"))
    return flow.map(spark, {"x": _price(spark, d)}, outputs=["y"])["y"].df


@query("SELECT * FROM (VALUES ('cycle', true), ('repeated output', true), ('defaults', true), ('scopes', true), ('types', true), ('unknown input', true), ('missing input', true), ('fixed reduced axis', true), ('fixed outside', true), ('fine', false)) t(fault, refused)")
def flow_refusals(spark: SparkSession, d: str) -> DataFrame:
    def whole(x: int) -> int:
        return x

    def text(y: str) -> str:
        return y

    total = Node(lambda y: F.sum(y), "s", kind="aggregate")
    line = Flow([Node(_plus, "y", spec="x[o] -> y[o]")])
    found = {
        "cycle": lambda: Flow([Node(lambda a: a, "b"), Node(lambda b: b, "a")]),
        "repeated output": lambda: Flow([Node(lambda a: a, "b"), Node(lambda c: c, "b")]),
        "defaults": lambda: Flow([Node(lambda a=1: a, "b"), Node(lambda a=2: a, "c")]),
        "scopes": lambda: Flow([Node(lambda p: p, "q.r", parameters=["p"]), Node(lambda q: q, "z")]),
        "types": lambda: Flow([Node(whole, "y"), Node(text, "z")]),
        "unknown input": lambda: line.map(spark, {"x": [1], "q": 2}),
        "missing input": lambda: line.map(spark, {}),
        "fixed reduced axis": lambda: Flow([Node(_plus, "y", spec="x[o] -> y[o]"), total]).map(spark, {"x": [1]}, fixed={"o": 0}),
        "fixed outside": lambda: line.map(spark, {"x": [1, 2]}, fixed={"o": 5}),
        "fine": lambda: line.map(spark, {"x": [1, 2]}, fixed={"o": 1}),
    }
    return _rows(spark, [(k, _refused(f, (ValueError, TypeError, IndexError))) for k, f in found.items()], "fault string, refused boolean")


@query("SELECT * FROM (VALUES ('int int', true), ('int float', false), ('int int|str', true), ('int|str int', false), ('list list', true), ('list[int] list[str]', false), ('Array[int] Array[str]', false)) t(types, fit)")
def type_rules(spark: SparkSession, d: str) -> DataFrame:
    found = {"int int": (int, int), "int float": (int, float), "int int|str": (int, int | str), "int|str int": (int | str, int), "list list": (list[int], list), "list[int] list[str]": (list[int], list[str]), "Array[int] Array[str]": (Array[int], Array[str])}
    return _rows(spark, [(k, bool(compatible(*v))) for k, v in found.items()], "types string, fit boolean")


@query("SELECT * FROM (VALUES ('int float', false), ('close floats', true), ('arrays', true), ('lists', false), ('dicts', true)) t(values_, equal)")
def equal_values(spark: SparkSession, d: str) -> DataFrame:
    found = {"int float": same(1, 1.0), "close floats": same(0.1 + 0.2, 0.3), "arrays": same(np.arange(3), np.arange(3)), "lists": same([1, [2]], [1, [3]]), "dicts": same_dicts({"a": [1]}, {"a": [1]})}
    return _rows(spark, [(k, bool(v)) for k, v in found.items()], "values_ string, equal boolean")


@query("SELECT * FROM (VALUES ('x', 'input', 'int', 'bigint'), ('y', 'output', 'float', NULL)) t(name, side, hint, spark_type)")
def flow_annotations(spark: SparkSession, d: str) -> DataFrame:
    def body(x: int) -> float:
        return x / 2

    flow = Flow([Node(body, "y")])
    types = flow.input_schema()
    rows = [(k, side, t.__name__, types.get(k)) for side, hints in (("input", flow.input_hints()), ("output", flow.output_hints())) for k, t in hints.items()]
    return _rows(spark, rows, "name string, side string, hint string, spark_type string")


@query("SELECT * FROM (VALUES ('g', 'one'), ('g', 'two')) t(grp, variant)")
def variants_of_flow(spark: SparkSession, d: str) -> DataFrame:
    flow = VariantFlow([Node(lambda a: a, "b", variant={"g": "one"}), Node(lambda a: -a, "b", variant={"g": "two"})])
    return _rows(spark, [(g, v) for g, vs in flow.variants().items() for v in vs], "grp string, variant string")


@query(PRICES.format("-(o_totalprice + 1) AS z"))
def variants_merged(spark: SparkSession, d: str) -> DataFrame:
    """Two flows as variants of one; nodes that are alike stay common."""
    first = Node(_plus, "y", spec="x[o] -> y[o]")
    flows = {"keep": Flow([first, Node(lambda y: y, "z", spec="y[o] -> z[o]")]), "turn": Flow([first, Node(lambda y: -y, "z", spec="y[o] -> z[o]")])}
    return VariantFlow.merge(flows).choose("turn").map(spark, {"x": _price(spark, d)})["z"].df


# single values


@query("SELECT k::INTEGER AS k, ((k + 1) * 2)::INTEGER AS volume, ((k + 1) * 4)::INTEGER AS weight, ((k + 1) * 18)::INTEGER AS fee FROM (SELECT unnest(range(20)) AS k)")
def scalar_run(spark: SparkSession, d: str) -> DataFrame:
    """A flow called on plain values: several outputs, everything on the way, and as a plain function."""
    flow = _parcel()
    fee = flow.function("fee")
    rows = []
    for k in range(20):
        volume, weight = flow.run(["volume", "weight"], width=k + 1, height=2)
        full = flow.run("fee", width=k + 1, height=2, rate=3, full=True)
        assert full["fee"] == flow("fee", width=k + 1, height=2, rate=3) == flow.run("fee", volume=volume, weight=weight, rate=3)
        rows.append((k, volume, weight, fee(width=k + 1, height=2, rate=3)))
    return _rows(spark, rows, "k int, volume int, weight int, fee int")


@query("SELECT * FROM (VALUES ('unused', true), ('allowed', false), ('missing', true), ('arrays', true)) t(run, refused)")
def scalar_run_refusals(spark: SparkSession, d: str) -> DataFrame:
    flow = _parcel()
    found = {
        "unused": lambda: flow.run("volume", width=1, height=2, q=1),
        "allowed": lambda: flow.run("volume", width=1, height=2, q=1, allow_unused=True),
        "missing": lambda: flow.run("volume", width=1),
        "arrays": lambda: _line().run("z", x=1),
    }
    return _rows(spark, [(k, _refused(f, (ValueError, UnusedInputs, RuntimeError))) for k, f in found.items()], "run string, refused boolean")


@query("SELECT * FROM (VALUES ('decorated', 3), ('chained', 8), ('picked', 7), ('bound', 10), ('nested', 6), ('gathered', 5), ('attribute', 4)) t(node, value)")
def node_calls(spark: SparkSession, d: str) -> DataFrame:
    made = node("y")(_plus)
    picked = Node(lambda x: {"a": x, "b": x + 2}, ("a", "b"), picker=lambda r, name: r[name])
    found = {
        "decorated": made(x=2), "chained": Flow(chain([_plus, lambda _plus: _plus * 2])).run(x=3), "picked": picked.pick(picked(x=5), "b"),
        "bound": Node(lambda a, b=1: a * b, "c", bound={"b": 5})(a=2), "nested": nest([Node(_plus, "y"), Node(_times, "z")], "z")(x=2),
        "gathered": sum(gather(["a", "b"])(a=2, b=3).values()), "attribute": int(attribute("real", "v")(v=4 + 1j)),
    }
    return _rows(spark, found.items(), "node string, value int")


@query("SELECT k::INTEGER AS k, (k % 4 * (k % 4))::INTEGER AS y, 4 AS calls FROM (SELECT unnest(range(20)) AS k)")
def memoized_calls(spark: SparkSession, d: str) -> DataFrame:
    """Equal arguments are computed once."""
    calls = []
    f = caches.memoize(caches.Recent(8))(lambda x: calls.append(1) or x * x)
    rows = [(k, f(k % 4)) for k in range(20)]
    return _rows(spark, [(*r, len(calls)) for r in rows], "k int, y int, calls int")


@query("SELECT * FROM (VALUES ('simple', 'a b c'), ('recent', 'b c'), ('weighted', 'a c'), ('disk', 'b c')) t(cache, held)")
def cache_policies(spark: SparkSession, d: str) -> DataFrame:
    """What is left after a, b and c went in, two fitting: a took long and was asked for again, b was quick."""
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        kinds = {"simple": caches.Simple(), "recent": caches.Recent(2), "weighted": caches.Weighted(2), "disk": caches.Disk(folder, 2)}
        for name, c in kinds.items():
            c.put("a", 1, 10.0)
            if name == "weighted":
                c.get("a")
            c.put("b", 2, 0.1)
            c.put("c", 3, 5.0)
        return _rows(spark, [(n, " ".join(k for k in "abc" if k in c)) for n, c in kinds.items()], "cache string, held string")


@query("SELECT * FROM (VALUES ('equal arrays', true), ('other type', false), ('edited code', false), ('same code', true)) t(what, same_key)")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    found = {
        "equal arrays": caches.as_key({"a": np.arange(3)}) == caches.as_key({"a": np.arange(3)}), "other type": caches.as_key([1]) == caches.as_key((1,)),
        "edited code": caches.code_key(_plus) == caches.code_key(_times), "same code": caches.code_key(_plus) == caches.code_key(_plus),
    }
    return _rows(spark, found.items(), "what string, same_key boolean")


@query("SELECT * FROM (VALUES ('over', 2, '4GB'), ('updated', 8, '4GB'), ('most', 8, '4GB')) t(made, cpus, memory)")
def resource_rules(spark: SparkSession, d: str) -> DataFrame:
    own, base = Resources(cpus=2), Resources(cpus=1, memory="4GB")
    over = own.over(base)
    found = {"over": over, "updated": over.updated(cpus=8), "most": Resources.most([over, Resources(cpus=8, memory="300MB")])}
    return _rows(spark, [(k, r.cpus, r.memory) for k, r in found.items()], "made string, cpus int, memory string")


# sweeps


@query("SELECT * FROM (VALUES (0, 1, 3), (1, 1, 4), (2, 2, 3), (3, 2, 4)) t(place, a, b)")
def sweep_list(spark: SparkSession, d: str) -> DataFrame:
    """Rows in nested-loop order, as many as the length tells."""
    s = Sweep({"a": [1, 2], "b": [3, 4]})
    assert len(s) == len(s.list()) == len(list(s))
    return _rows(spark, [(k, r["a"], r["b"]) for k, r in enumerate(s)], "place int, a int, b int")


@query("SELECT * FROM (VALUES (1), (2), (1)) t(a)")
def sweep_union_only(spark: SparkSession, d: str) -> DataFrame:
    """Members of a union are narrowed each on its own."""
    both = Sweep({"a": [1, 2], "b": [5, 6]}).combine(Sweep({"a": [1], "b": [7]}))
    return _rows(spark, [(r["a"],) for r in both.only(["a"])], "a int")


@query("SELECT * FROM (VALUES ('zipped lengths', true), ('repeated names', true), ('fine', false)) t(sweep, refused)")
def sweep_refusals(spark: SparkSession, d: str) -> DataFrame:
    found = {"zipped lengths": lambda: Sweep({"a": [1, 2], "b": [1]}, [("a", "b")]), "repeated names": lambda: Sweep({"a": [1]}).product(Sweep({"a": [2]})), "fine": lambda: Sweep({"a": [1, 2], "b": [1]})}
    return _rows(spark, [(k, _refused(f)) for k, f in found.items()], "sweep string, refused boolean")


@query("SELECT low::BIGINT AS low, high::BIGINT AS high, count(*) AS n FROM (VALUES (0), (20)) a(low), (VALUES (30), (50)) b(high) JOIN lineitem ON l_quantity > low AND l_quantity <= high GROUP BY ALL")
def sweep_map(spark: SparkSession, d: str) -> DataFrame:
    """A flow over all rows of a sweep, in one job with a sweep axis."""
    flow, inputs = sweep_inputs(Flow([Node(lambda low, high: F.struct(low.alias("low"), high.alias("high")), "band")]), Sweep({"low": [0, 20], "high": [30, 50]}))
    bands = flow.map(spark, inputs)["band"].df.select("band.*")
    li = read_table(spark, d, "lineitem").select("l_quantity")
    return li.join(F.broadcast(bands), (li.l_quantity > F.col("low")) & (li.l_quantity <= F.col("high"))).groupBy("low", "high").agg(F.count("*").alias("n"))  # four bands


@query("SELECT p, q, 10 * p + q AS w FROM (SELECT unnest(range(2)) AS p), (SELECT unnest(range(3)) AS q)")
def sweep_points(spark: SparkSession, d: str) -> DataFrame:
    """A map split into one job for each index of its independent axes, and put together again."""
    flow = Flow([Node(lambda u, v: 10 * u + v, "w", spec="u[p], v[q] -> w[p, q]")])
    jobs = [flow.map(spark, {"u": [0, 1], "v": [0, 1, 2]}, fixed=k)["w"].df for k in fixed_points(flow, "w", {"p": 2, "q": 3})]
    out = jobs[0]
    for df in jobs[1:]:
        out = out.unionByName(df)
    return out


@query("SELECT * FROM (VALUES ('c', true), ('d', false)) t(node, cache)")
def sweep_set_caches(spark: SparkSession, d: str) -> DataFrame:
    flow = Flow([Node(lambda a, b: a, "c"), Node(lambda c, x: c, "d")])
    set_caches(flow, "d", Sweep({"a": [1, 2], "b": [1], "x": [1, 2, 3]}).frame(spark))
    return _rows(spark, [(o, flow[o].cache) for o in ("c", "d")], "node string, cache boolean")


# runs and folders


@query("SELECT k::INTEGER AS k, (10 * k)::BIGINT AS total FROM (SELECT unnest(range(4)) AS k)")
def async_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs in the background, two at a time."""
    flow = Flow([Node(lambda x: x * 2, "y", spec="x[i] -> y[i]"), Node(lambda y: F.sum(y), "s", kind="aggregate")])
    runs = [run_async(flow, spark, {"x": [k] * 5}, start=k == 0, action=lambda r: r.value("s")) for k in range(4)]
    return _rows(spark, list(enumerate(gather_runs(*runs, at_once=2))), "k int, total bigint")


def _stored(spark: SparkSession, name: str, **options: Any) -> tuple[Flow, str]:
    flow = Flow([Node(lambda x, y: x * y, "z", spec="x[i], y[j] -> z[i, j]"), Node(lambda z: F.sum(z), "t", kind="aggregate")])
    folder = scratch_folder(spark, name)
    flow.map(spark, {"x": [1, 2, 3], "y": range(10, 12)}, folder=folder, **options)
    return flow, folder


@query("SELECT i, j, (i + 1) * (j + 10) AS z FROM (SELECT unnest(range(3)) AS i), (SELECT unnest(range(2)) AS j)")
def load_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Outputs of a run read back from its folder, in another format."""
    _, folder = _stored(spark, "load", storage={"z": "orc"})
    z, t = RunFolder(spark, folder).outputs("z", "t")
    assert t.df.count() == 1
    return z.df


@query("SELECT i + 1 AS x, j + 10 AS y, (i + 1) * (j + 10) AS z, 126::BIGINT AS t FROM (SELECT unnest(range(3)) AS i), (SELECT unnest(range(2)) AS j)")
def load_table(spark: SparkSession, d: str) -> DataFrame:
    """All outputs of a run with the inputs that label them."""
    return RunFolder(spark, _stored(spark, "table")[1]).to_table()


@query("SELECT * FROM (VALUES ('z', 'orc', '(i j)'), ('t', 'parquet', '()')) t(output, kind, axes)")
def load_manifest(spark: SparkSession, d: str) -> DataFrame:
    m = RunFolder(spark, _stored(spark, "manifest", storage={"z": "orc"})[1]).load()
    return _rows(spark, [(o, v["kind"], _shown(v["axes"])) for o, v in m["outputs"].items()], "output string, kind string, axes string")


@query("SELECT * FROM (VALUES ('t', '{\"t\":126}')) t(output, json)")
def load_json(spark: SparkSession, d: str) -> DataFrame:
    found = RunFolder(spark, _stored(spark, "json")[1]).to_json("t")
    return _rows(spark, [(k, x) for k, rows in found.items() for x in rows], "output string, json string")


@query("SELECT * FROM (VALUES ('(0 0)', true, 10), ('(2 1)', true, 33), ('(1 1)', true, 99)) t(index, held, z)")
def store_cells(spark: SparkSession, d: str) -> DataFrame:
    """Single cells of a run: read, asked for, and put where there is none."""
    flow, folder = Flow([Node(lambda x, y: x * y, "z", spec="x[i], y[j] -> z[i, j]")]), scratch_folder(spark, "cells")
    for k in (0, 2):
        flow.map(spark, {"x": [1, 2, 3], "y": range(10, 12)}, folder=folder, resume=True, fixed={"i": k})
    run = RunFolder(spark, folder)
    assert not run.has("z", 1, 1)
    run.put("z", {(1, 1): 99, (0, 0): -1})
    return _rows(spark, [(_shown(k), run.has("z", *k), run.cell("z", *k)) for k in ((0, 0), (2, 1), (1, 1))], "index string, held boolean, z int")


@query("SELECT 1::BIGINT AS i, j FROM (SELECT unnest(range(2)) AS j)")
def store_missing(spark: SparkSession, d: str) -> DataFrame:
    flow, folder = Flow([Node(lambda x, y: x * y, "z", spec="x[i], y[j] -> z[i, j]")]), scratch_folder(spark, "missing")
    for k in (0, 2):
        flow.map(spark, {"x": [1, 2, 3], "y": range(10, 12)}, folder=folder, resume=True, fixed={"i": k})
    return RunFolder(spark, folder).missing("z")


@query("SELECT * FROM (VALUES ('inputs', true), ('error mode', true), ('foreign folder', true), ('skipped', false), ('same', false)) t(change, refused)")
def store_resume_refusals(spark: SparkSession, d: str) -> DataFrame:
    flow, folder, other = Flow([Node(_plus, "y", spec="x[o] -> y[o]")]), scratch_folder(spark, "compared"), scratch_folder(spark, "other")
    flow.map(spark, {"x": [1, 2]}, folder=folder)
    spark.range(1).write.parquet(f"{other}/table")
    again = lambda x, path=folder, **o: lambda: flow.map(spark, {"x": x}, folder=path, resume=True, **o)
    found = {"inputs": again([1, 3]), "error mode": again([1, 2], errors="continue"), "foreign folder": again([1, 2], other), "same": again([1, 2]), "skipped": again([1, 3], validation="skip")}
    return _rows(spark, [(k, _refused(f, ResumeError)) for k, f in found.items()], "change string, refused boolean")


@query(PRICES.format("o_totalprice + 1 AS y"))
def store_kinds(spark: SparkSession, d: str) -> DataFrame:
    """A storage kind of one's own."""
    register_storage("json-lines", lambda df, path, mode: df.write.mode(mode).json(path), lambda s, path, schema: s.read.schema(schema).json(path))
    assert len(storage("json-lines")) == 2
    flow = Flow([Node(_plus, "y", spec="x[o] -> y[o]")])
    return flow.map(spark, {"x": _price(spark, d)}, folder=scratch_folder(spark, "kinds"), storage="json-lines")["y"].df


@query("SELECT i, j, 10 * i + j AS x FROM (SELECT unnest(range(3)) AS i), (SELECT unnest(range(4)) AS j)")
def frame_values(spark: SparkSession, d: str) -> DataFrame:
    """A dense array as a frame, back as an array, and as a frame again."""
    x = AxisFrame.from_values(spark, "x", "ij", np.array([[10 * i + j for j in range(4)] for i in range(3)])).to_numpy()
    return AxisFrame.from_values(spark, "x", "ij", x).df


@query("SELECT n_regionkey::BIGINT AS g, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS r, n_name AS name FROM nation")
def frame_bag(spark: SparkSession, d: str) -> DataFrame:
    """Rows that repeat a key, numbered along an inner axis."""
    n = read_table(spark, d, "nation").select(F.col("n_regionkey").cast("bigint").alias("g"), "n_name")
    return AxisFrame.from_bag(n, "name", ["g"], "n_name", order=["n_name"]).df


@query("SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation")
def scan_by_reference(spark: SparkSession, d: str) -> DataFrame:
    """A table written once and passed by its path."""
    ref = ByReference.write(read_table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("name")), scratch_folder(spark, "reference"))
    assert read_any(spark, ref.path).count() == ref.load(spark).count()
    return ref.load(spark)


@query("SELECT k, 3 * k AS y FROM (SELECT unnest(range(1, 5)) AS k)")
def scan_json_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Inputs of a flow from a JSON document."""
    path = scratch_folder(spark, "inputs")
    spark.createDataFrame([([1, 2, 3, 4], 3)], "x array<bigint>, n bigint").coalesce(1).write.json(path)
    r = Flow([Node(lambda x, n: F.struct(x.alias("k"), (x * n).alias("y")), "v", spec="x[i] -> v[i]")]).map(spark, read_inputs(spark, path))
    return r["v"].df.select("v.*")


@query("SELECT * FROM (VALUES ('y', 4, false, true)) t(output, done, stale, later)")
def heartbeats(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch_folder(spark, "heart")
    for done in (2, 4):
        write_heartbeat(spark, folder, {"y": done})
    now, later = read_heartbeat(spark, folder), read_heartbeat(spark, folder, now=9e9)
    return _rows(spark, [(k, v, now["stale"], later["stale"]) for k, v in now["progress"].items()], "output string, done int, stale boolean, later boolean")


@query("SELECT count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(stddev_samp(o_totalprice), 6) AS deviation, max(o_totalprice) AS most FROM orders WHERE o_orderkey < 200")
def running_values(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of values that come one by one."""
    r = Running()
    for row in read_table(spark, d, "orders").filter("o_orderkey < 200").select("o_totalprice").collect():
        r.add(row[0])
    return _rows(spark, [(r.count, round(r.mean, 6), round(r.deviation, 6), r.most)], "n bigint, mean double, deviation double, most double")


# errors as data


def _failing(spark: SparkSession, d: str, keep: str = "s"):
    def body(x: float) -> float:
        if x < 0:
            raise ValueError("negative")
        return 2 * x

    x = AxisFrame.from_table(read_table(spark, d, "customer"), "x", ["c_custkey"], "c_acctbal").rename_axes({"c_custkey": "c"})
    flow = Flow([Node(body, "y", kind="python", returns="double", spec="x[c] -> y[c]"), Node(lambda y: F.sum(y), "s", kind="aggregate")], check_types=False).sub(outputs=[keep])
    return flow.map(spark, {"x": x}, errors="continue")


@query("SELECT c_custkey AS c, c_acctbal AS x, 'ValueError' AS type, 'negative' AS message, c_acctbal::VARCHAR AS argument FROM customer WHERE c_acctbal < 0")
def error_calls(spark: SparkSession, d: str) -> DataFrame:
    """What the failed calls were called with, from the inputs and from the record itself."""
    r = _failing(spark, d, "y")
    return errors.failed_calls(r.flow["y"], {"x": r["x"]}, r["y"]).select("c", "x", F.col("error.type").alias("type"), F.col("error.message").alias("message"), F.col("error.arguments")["x"].alias("argument"))


@query("SELECT 'y' AS cause, 'negative' AS message, count(*) AS n FROM customer WHERE c_acctbal < 0")
def error_causes(spark: SparkSession, d: str) -> DataFrame:
    """What a reduction over cells with errors goes back to."""
    r = _failing(spark, d)
    return errors.root_causes(r.flow, r.frames, "s").groupBy("cause", F.col("error.message").alias("message")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS c FROM customer WHERE c_acctbal < 0")
def error_saved(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_folder(spark, "failures")
    errors.save_failures(_failing(spark, d, "y")["y"], path)
    return spark.read.parquet(path).select("c")


@query("SELECT 'negative' AS message, count(*) > 0 AS raised FROM customer WHERE c_acctbal < 0")
def error_reproduced(spark: SparkSession, d: str) -> DataFrame:
    """A failed call, called again."""
    r = _failing(spark, d, "y")
    row = errors.failed_calls(r.flow["y"], {"x": r["x"]}, r["y"]).orderBy("c").first()
    return _rows(spark, [("negative", row is not None and _refused(lambda: errors.reproduce(r.flow["y"], row)))], "message string, raised boolean")


# tables


@query("SELECT i, j, a, b, a + b AS s FROM (SELECT unnest(range(3)) AS i, unnest([5, 6, 7])::BIGINT AS a), (SELECT unnest(range(2)) AS j, unnest([1, 2])::BIGINT AS b)")
def table_with_axes(spark: SparkSession, d: str) -> DataFrame:
    r = Flow([Node(lambda a, b: a + b, "s", spec="a[i], b[j] -> s[i, j]")]).map(spark, {"a": [5, 6, 7], "b": [1, 2]})
    return assemble(r.frames, ["s"], r.flow.specs(), keep_axes=True).select("i", "j", "a", "b", "s")


@query("SELECT i, j FROM (SELECT unnest(range(50)) AS i), (SELECT unnest(range(20)) AS j)")
def table_space(spark: SparkSession, d: str) -> DataFrame:
    return space(spark, {"i": 50, "j": 20})
