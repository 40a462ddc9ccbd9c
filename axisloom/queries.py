"""The query catalogue: every operator family of the engine over the supplied tables, with its SQL twin.

Each entry pairs a function of (spark, sf_dir) with DuckDB SQL that gives the same columns and rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axisloom.functions.cache import once_for_each
from axisloom.functions.node import Node, attribute, gather, nest
from axisloom.operators.compile import compile_node
from axisloom.operators.frame import AxisFrame, linear_index, space, unravel
from axisloom.operators.table import assemble, cast, composite, split_composite
from axisloom.plans.flow import Flow, VariantFlow
from axisloom.sources.store import RunFolder, list_runs, scratch_folder
from axisloom.sources.sweep import Sweep, cache_plan, count_calls
from axisloom.sources.tables import ByReference, read_table
from axisloom.streaming.events import sessions, windowed
from axisloom.streaming.status import Status, running_stats

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, tuple[Query, str]] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL."""

    def register(f: Query) -> Query:
        CATALOGUE[f.__name__] = (f, sql)
        return f

    return register


def _money(c: Column) -> Column:
    return c.cast("decimal(18,4)")


def _total(c: Column) -> Column:
    return F.sum(_money(c)).cast("decimal(30,4)")


def _lineitem(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem")


def _frame(spark: SparkSession, d: str, table: str, axes: str, value: str | Column, name: str) -> AxisFrame:
    return AxisFrame.from_table(read_table(spark, d, table), name, axes.split(), value)


# patterns of maps


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS rev FROM lineitem")
def map_elementwise(spark: SparkSession, d: str) -> DataFrame:
    """One body call for each cell of a bag of rows."""
    li = _lineitem(spark, d)
    cells = AxisFrame.from_table(li, "cell", ["l_orderkey", "l_linenumber"], F.struct("l_extendedprice", "l_discount"))
    n = Node(lambda cell: cell["l_extendedprice"] * (1 - cell["l_discount"]), "rev", spec="cell[o, r] -> rev[o, r]")
    out = compile_node(spark, n, {"cell": cells.rename_axes({"l_orderkey": "o", "l_linenumber": "r"})})["rev"]
    return out.rename_axes({"o": "l_orderkey", "r": "l_linenumber"}).df


@query("SELECT conv_id, turn, length(text) AS chars FROM conversations")
def map_nd(spark: SparkSession, d: str) -> DataFrame:
    text = _frame(spark, d, "conversations", "conv_id turn", "text", "text")
    flow = Flow([Node(lambda text: F.length(text).cast("bigint"), "chars", spec="text[conv_id, turn] -> chars[conv_id, turn]")])
    return flow.map(spark, {"text": text})["chars"].df


@query("SELECT o_orderkey AS o, o_totalprice / 1.25 AS net, o_totalprice - o_totalprice / 1.25 AS tax FROM orders")
def map_multi_output(spark: SparkSession, d: str) -> DataFrame:
    """Two outputs of one body."""
    price = _frame(spark, d, "orders", "o_orderkey", "o_totalprice", "price").rename_axes({"o_orderkey": "o"})
    n = Node(lambda price: (price / 1.25, price - price / 1.25), ("net", "tax"), spec="price[o] -> net[o], tax[o]")
    made = compile_node(spark, n, {"price": price})
    return assemble(made, ["net", "tax"], keep_axes=True)


@query(
    "SELECT o_orderkey AS o, rev / o_totalprice AS share FROM orders JOIN "
    "(SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS rev FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"
)
def zip_two_arrays(spark: SparkSession, d: str) -> DataFrame:
    price = _frame(spark, d, "orders", "o_orderkey", "o_totalprice", "price").rename_axes({"o_orderkey": "o"})
    rev = AxisFrame.from_table(_lineitem(spark, d), "item", ["l_orderkey", "l_linenumber"], "l_extendedprice")
    flow = Flow([
        Node(lambda item: _total(item).cast("double"), "rev", kind="aggregate", spec="item[o, :] -> rev[o]"),
        Node(lambda rev, price: rev / price, "share", spec="rev[o], price[o] -> share[o]"),
    ])
    return flow.map(spark, {"item": rev.rename_axes({"l_orderkey": "o"}), "price": price})["share"].df


@query("SELECT r_name || '/' || l_returnflag AS pair FROM region CROSS JOIN (SELECT DISTINCT l_returnflag FROM lineitem)")
def outer_product(spark: SparkSession, d: str) -> DataFrame:
    region = _frame(spark, d, "region", "r_regionkey", "r_name", "region").rename_axes({"r_regionkey": "i"})
    flags = _lineitem(spark, d).select("l_returnflag").distinct()
    flag = AxisFrame.from_table(flags, "flag", ["l_returnflag"], "l_returnflag").rename_axes({"l_returnflag": "j"})
    flow = Flow([Node(lambda region, flag: F.concat_ws("/", region, flag), "pair", spec="region[i], flag[j] -> pair[i, j]")])
    return flow.map(spark, {"region": region, "flag": flag})["pair"].df.select("pair")


@query("SELECT l_orderkey AS o, l_partkey AS p, l_quantity * p_retailprice AS worth FROM lineitem JOIN part ON l_partkey = p_partkey")
def broadcast_align(spark: SparkSession, d: str) -> DataFrame:
    qty = AxisFrame.from_table(_lineitem(spark, d), "qty", ["l_orderkey", "l_partkey"], "l_quantity").rename_axes({"l_orderkey": "o", "l_partkey": "p"})
    price = _frame(spark, d, "part", "p_partkey", "p_retailprice", "price").rename_axes({"p_partkey": "p"})
    flow = Flow([Node(lambda qty, price: qty * price, "worth", spec="qty[o, p], price[p] -> worth[o, p]")])
    return flow.map(spark, {"qty": qty, "price": price})["worth"].df


@query(
    "SELECT c_custkey AS c, s AS segment, n_name || ':' || s AS label FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "CROSS JOIN (VALUES ('BUILDING'), ('MACHINERY')) v(s)"
)
def mixed_zip_product(spark: SparkSession, d: str) -> DataFrame:
    """Two arrays zipped on one axis, times a third."""
    cust = read_table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    home = AxisFrame.from_table(cust, "home", ["c_custkey", "k"], F.lit(1)).rename_axes({"c_custkey": "c"})
    nation = _frame(spark, d, "nation", "n_nationkey", "n_name", "nation").rename_axes({"n_nationkey": "k"})
    seg = AxisFrame.from_values(spark, "seg", ["s"], ["BUILDING", "MACHINERY"])
    flow = Flow([Node(lambda home, nation, seg: F.struct(F.concat_ws(":", nation, seg).alias("label"), seg.alias("segment")), "x", spec="home[c, k], nation[k], seg[s] -> x[c, k, s]")])
    return flow.map(spark, {"home": home, "nation": nation, "seg": seg})["x"].df.select("c", "x.segment", "x.label")


@query("SELECT l_orderkey AS o, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DECIMAL(30,4) AS rev FROM lineitem GROUP BY 1")
def reduce_partial(spark: SparkSession, d: str) -> DataFrame:
    return order_revenue(spark, d)["rev"].df


def order_revenue(spark: SparkSession, d: str):
    """Revenue of each line, then of each order."""
    li = _lineitem(spark, d)
    price = AxisFrame.from_table(li, "line", ["l_orderkey", "l_linenumber"], F.struct("l_extendedprice", "l_discount")).rename_axes({"l_orderkey": "o", "l_linenumber": "r"})
    flow = Flow([
        Node(lambda line: _money(line["l_extendedprice"] * (1 - line["l_discount"])), "net", spec="line[o, r] -> net[o, r]"),
        Node(lambda net: F.sum(net).cast("decimal(30,4)"), "rev", kind="aggregate", spec="net[o, :] -> rev[o]"),
    ])
    return flow.map(spark, {"line": price})


@query("SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity::DECIMAL(18,4))::DECIMAL(30,4) AS qty FROM lineitem GROUP BY 1, 2")
def reduce_multi_axis(spark: SparkSession, d: str) -> DataFrame:
    q = AxisFrame.from_table(_lineitem(spark, d), "q", ["l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber"], "l_quantity")
    q = q.rename_axes({"l_returnflag": "f", "l_linestatus": "s"})
    return Flow([Node(lambda q: _total(q), "qty", kind="aggregate", spec="q[f, s, :, :] -> qty[f, s]")]).map(spark, {"q": q})["qty"].df


@query("SELECT sum(l_extendedprice::DECIMAL(18,4))::DECIMAL(30,4) AS total FROM lineitem")
def reduce_full(spark: SparkSession, d: str) -> DataFrame:
    p = AxisFrame.from_table(_lineitem(spark, d), "p", ["l_orderkey"], "l_extendedprice")
    return compile_node(spark, Node(lambda p: _total(p), "total", kind="aggregate"), {"p": p})["total"].df


@query(
    "SELECT c_nationkey AS n, max(spent) AS most FROM (SELECT o_custkey, sum(v)::DECIMAL(30,4) AS spent FROM (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,4)) AS v FROM lineitem GROUP BY 1) "
    "JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) JOIN customer ON o_custkey = c_custkey GROUP BY 1"
)
def reduce_chain(spark: SparkSession, d: str) -> DataFrame:
    """Sum for each order, then each customer, then the largest of each nation."""
    item = AxisFrame.from_table(_lineitem(spark, d), "item", ["l_orderkey", "l_linenumber"], "l_extendedprice").rename_axes({"l_orderkey": "o"})
    buys = AxisFrame.from_table(read_table(spark, d, "orders"), "buys", ["o_custkey", "o_orderkey"], F.lit(1)).rename_axes({"o_custkey": "c", "o_orderkey": "o"})
    home = AxisFrame.from_table(read_table(spark, d, "customer"), "home", ["c_nationkey", "c_custkey"], F.lit(1)).rename_axes({"c_nationkey": "n", "c_custkey": "c"})
    flow = Flow([
        Node(lambda item: F.sum(_money(item)), "v", kind="aggregate", spec="item[o, :] -> v[o]"),
        Node(lambda v, buys: v * buys, "paid", spec="v[o], buys[c, o] -> paid[c, o]"),
        Node(lambda paid: F.sum(paid).cast("decimal(30,4)"), "spent", kind="aggregate", spec="paid[c, :] -> spent[c]"),
        Node(lambda spent, home: spent * home, "there", spec="spent[c], home[n, c] -> there[n, c]"),
        Node(lambda there: F.max(there).cast("decimal(30,4)"), "most", kind="aggregate", spec="there[n, :] -> most[n]"),
    ])
    return flow.map(spark, {"item": item, "buys": buys, "home": home})["most"].df


@query(
    "WITH c AS (SELECT vec_id AS i, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS a FROM embeddings), "
    "m AS (SELECT label AS k, j, floor(1000 * avg(a)) / 1000 AS b FROM c JOIN embeddings ON i = vec_id GROUP BY 1, 2) "
    "SELECT i, k, round(sum(a * b), 3) + 0.0 AS dot FROM c JOIN m USING (j) GROUP BY 1, 2"
)
def contraction(spark: SparkSession, d: str) -> DataFrame:
    """A matrix product over components: every vector against the mean of each label."""
    emb = read_table(spark, d, "embeddings")
    cells = emb.select(F.col("vec_id").alias("i"), F.col("label").alias("k"), F.posexplode("embedding").alias("j", "x")).withColumn("x", F.col("x").cast("double"))
    a = AxisFrame.from_table(cells, "a", ["i", "j"], "x")
    b = AxisFrame.from_table(cells.groupBy("j", "k").agg((F.floor(1000 * F.avg("x")) / 1000).alias("b")), "b", ["j", "k"])
    n = Node(lambda a, b: F.round(F.sum(a * b), 3) + F.lit(0.0), "dot", kind="aggregate", spec="a[i, :], b[:, k] -> dot[i, k]")
    return compile_node(spark, n, {"a": a, "b": b})["dot"].df


@query("SELECT conv_id, string_agg(text, '|' ORDER BY turn) AS talk FROM conversations GROUP BY 1")
def ordered_reduce(spark: SparkSession, d: str) -> DataFrame:
    """Reduced cells reach the body in the order of their axis."""
    text = _frame(spark, d, "conversations", "conv_id turn", "text", "text")
    return compile_node(spark, Node(lambda text: F.array_join(text, "|"), "talk", spec="text[conv_id, :] -> talk[conv_id]"), {"text": text})["talk"].df


@query("SELECT i, 3 * i AS x FROM (SELECT unnest(range(100)) AS i)")
def generate_axis(spark: SparkSession, d: str) -> DataFrame:
    flow = Flow([Node(lambda n: F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda v: v * 3), "x", kind="arrays", spec="... -> x[i]")])
    return flow.map(spark, {"n": 100})["x"].df


@query("SELECT vec_id AS v, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings")
def growing_axis(spark: SparkSession, d: str) -> DataFrame:
    """Each cell grows an inner axis; all must have one length."""
    e = _frame(spark, d, "embeddings", "vec_id", "embedding", "e").rename_axes({"vec_id": "v"})
    n = Node(lambda e: e.cast("array<double>"), "x", kind="arrays", spec="e[v] -> x[v, dim]")
    return compile_node(spark, n, {"e": e})["x"].df


@query("SELECT vec_id AS v, a, b, embedding[8 * a + b + 1]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(8)) AS a), (SELECT unnest(range(8)) AS b)")
def internal_block(spark: SparkSession, d: str) -> DataFrame:
    """A cell that holds a block spreads over two inner axes."""
    e = _frame(spark, d, "embeddings", "vec_id", "embedding", "e").rename_axes({"vec_id": "v"})
    n = Node(lambda e: F.transform(F.sequence(F.lit(1), F.lit(57), F.lit(8)), lambda k: F.slice(e, k, F.lit(8)).cast("array<double>")), "x", kind="arrays", spec="e[v] -> x[v, a, b]")
    return compile_node(spark, n, {"e": e})["x"].df


# selection, resume, pruning


@query("SELECT o_orderkey AS o, 2 * o_totalprice AS y FROM orders WHERE o_orderkey = 7")
def fixed_index(spark: SparkSession, d: str) -> DataFrame:
    return _doubled(spark, d, {"o": 7})


@query("SELECT o_orderkey AS o, 2 * o_totalprice AS y FROM orders WHERE o_orderkey >= 10 AND o_orderkey < 1000 AND (o_orderkey - 10) % 3 = 0")
def fixed_slice(spark: SparkSession, d: str) -> DataFrame:
    return _doubled(spark, d, {"o": slice(10, 1000, 3)})


def _doubled(spark: SparkSession, d: str, fixed: dict) -> DataFrame:
    x = _frame(spark, d, "orders", "o_orderkey", "o_totalprice", "x").rename_axes({"o_orderkey": "o"})
    return Flow([Node(lambda x: 2 * x, "y", spec="x[o] -> y[o]")]).map(spark, {"x": x}, fixed=fixed)["y"].df


@query("SELECT o_orderkey AS o, 2 * o_totalprice AS y, o_orderkey % 3 <> 0 AS fresh FROM orders")
def resume_missing(spark: SparkSession, d: str) -> DataFrame:
    """A run of every third cell, resumed: cells that are stored are kept, the others computed."""
    x = _frame(spark, d, "orders", "o_orderkey", "o_totalprice", "x").rename_axes({"o_orderkey": "o"})
    flow, folder = Flow([Node(lambda x: 2 * x, "y", spec="x[o] -> y[o]")]), scratch_folder(spark, "resumed")
    first = flow.map(spark, {"x": x}, folder=folder, fixed={"o": slice(0, None, 3)})["y"].df
    whole = flow.map(spark, {"x": x}, folder=folder, resume=True)["y"].df
    return whole.join(first.select("o", F.lit(False).alias("kept")), "o", "left").select("o", "y", F.coalesce("kept", F.lit(True)).alias("fresh"))


@query("SELECT l_orderkey AS o, sum(l_quantity::DECIMAL(18,4))::DECIMAL(30,4) AS qty FROM lineitem GROUP BY 1")
def subflow_prune(spark: SparkSession, d: str) -> DataFrame:
    """Only the nodes that an output needs are planned, and only their columns are read."""
    li = _lineitem(spark, d)
    axes = ["l_orderkey", "l_linenumber"]
    flow = Flow([
        Node(lambda q: _total(q), "qty", kind="aggregate", spec="q[o, :] -> qty[o]"),
        Node(lambda p: _total(p), "rev", kind="aggregate", spec="p[o, :] -> rev[o]"),
        Node(lambda rev, qty: rev / qty, "mean", spec="rev[o], qty[o] -> mean[o]"),
    ])
    q = AxisFrame.from_table(li, "q", axes, "l_quantity").rename_axes({"l_orderkey": "o"})
    return flow.map(spark, {"q": q}, outputs=["qty"])["qty"].df


@query("SELECT l_orderkey AS o, l_quantity AS q FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 900")
def scan_filter_pushdown(spark: SparkSession, d: str) -> DataFrame:
    """A table passed by its path; the slice reaches the scan, which reads two columns."""
    li = ByReference(f"{d}/lineitem.parquet").load(spark)
    return AxisFrame.from_table(li, "q", ["l_orderkey"], "l_quantity").at(l_orderkey=slice(100, 900)).rename_axes({"l_orderkey": "o"}).df


@query("SELECT run, output, stored FROM (VALUES ('second', 'y', 25), ('first', 'y', 10)) v(run, output, stored), (SELECT count(*) FROM nation)")
def recent_runs_topk(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a folder, the newest first, and what they hold."""
    top, keys = scratch_folder(spark, "runs"), [r[0] for r in read_table(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    flow = Flow([Node(lambda x: x + 1, "y", spec="x[i] -> y[i]")])
    flow.map(spark, {"x": keys}, folder=f"{top}/first", fixed={"i": slice(0, 10)})
    flow.map(spark, {"x": keys}, folder=f"{top}/second")
    rows = [(run["path"].rsplit("/", 1)[1], o, RunFolder(spark, run["path"]).outputs(o).df.count()) for run in list_runs(spark, top, 5) for o in run["outputs"]]
    return spark.createDataFrame(rows, "run string, output string, stored int")


# sweeps


@query("SELECT a, b, c FROM (VALUES (1), (2)) x(a), (VALUES (3), (4)) y(b), (VALUES (5), (6)) z(c)")
def sweep_product(spark: SparkSession, d: str) -> DataFrame:
    whole = Sweep({"a": [1, 2]}).product(Sweep({"b": [3, 4]}), Sweep({"c": [5, 6]}))
    return whole.frame(spark).select(*[F.col(c).cast("int") for c in "abc"])


@query("SELECT a, b, c FROM (VALUES (1, 3), (2, 4)) x(a, b), (VALUES (5), (6)) z(c)")
def sweep_zipped(spark: SparkSession, d: str) -> DataFrame:
    return Sweep({"a": [1, 2], "b": [3, 4], "c": [5, 6]}, [("a", "b"), "c"]).frame(spark).select(*[F.col(c).cast("int") for c in "abc"])


@query("SELECT a, 7 AS k FROM (VALUES (1), (2)) x(a)")
def sweep_constants(spark: SparkSession, d: str) -> DataFrame:
    return Sweep({"a": [1, 2]}, constants={"a": 9, "k": 7}).frame(spark).select(F.col("a").cast("int"), F.col("k").cast("int"))


@query("SELECT low, low + 10 AS high, count(*) AS n FROM (VALUES (0), (10), (20), (30)) s(low) JOIN lineitem ON l_quantity >= low AND l_quantity < low + 10 GROUP BY 1, 2")
def sweep_derivers(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds with a derived bound, applied to a table."""
    s = Sweep({"low": [0, 10, 20, 30]}).derive(high="low + 10").frame(spark)
    li = _lineitem(spark, d).select("l_quantity")
    hit = li.join(F.broadcast(s), (li.l_quantity >= s.low) & (li.l_quantity < s.high))  # as many rows as the sweep names
    return hit.groupBy(F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high")).agg(F.count("*").alias("n"))


@query("SELECT a, b FROM (VALUES (1), (2)) x(a), (VALUES (3), (4)) y(b) WHERE NOT (a = 1 AND b = 3)")
def sweep_exclude(spark: SparkSession, d: str) -> DataFrame:
    return Sweep({"a": [1, 2], "b": [3, 4]}, exclude="a = 1 AND b = 3").frame(spark).select(*[F.col(c).cast("int") for c in "ab"])


@query("SELECT a, b FROM (VALUES (1, 3), (2, 3), (1, 4)) x(a, b)")
def sweep_union(spark: SparkSession, d: str) -> DataFrame:
    both = Sweep({"a": [1, 2], "b": [3]}) + Sweep({"a": [1], "b": [4]})
    return both.frame(spark).select(*[F.col(c).cast("int") for c in "ab"])


@query("SELECT DISTINCT a, a % 2 AS p FROM (VALUES (1), (2), (3)) x(a), (VALUES (5), (6)) z(c)")
def sweep_filtered_distinct(spark: SparkSession, d: str) -> DataFrame:
    rows = Sweep({"a": [1, 2, 3], "c": [5, 6]}, derivers={"p": lambda row: row["a"] % 2}).only(["a", "p"])
    return spark.createDataFrame([(r["a"], r["p"]) for r in rows], "a int, p int")


def _sweep_flow() -> Flow:
    return Flow([Node(lambda flag, status: flag, "c"), Node(lambda c, status, mode: c, "d"), Node(lambda mode: mode, "m"), Node(lambda d, m: d, "e")])


_CALLS = (
    "SELECT {n} AS node, {f} AS flag, {m} AS mode, {s} AS status, count(*) AS calls FROM (SELECT l_returnflag AS flag, l_linestatus AS status, l_linenumber AS mode FROM lineitem) GROUP BY ALL"
)
_COUNTS = " UNION ALL ".join((
    _CALLS.format(n="'c'", f="flag", m="NULL::INTEGER", s="status"),
    _CALLS.format(n="'d'", f="flag", m="mode", s="status"),
    _CALLS.format(n="'m'", f="NULL::VARCHAR", m="mode", s="NULL::VARCHAR"),
    _CALLS.format(n="'e'", f="flag", m="mode", s="status"),
))


def _sweep_rows(spark: SparkSession, d: str) -> DataFrame:
    return _lineitem(spark, d).select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("mode"))


@query(_COUNTS)
def count_sweep(spark: SparkSession, d: str) -> DataFrame:
    return count_calls(_sweep_flow(), "e", _sweep_rows(spark, d))


@query(f"SELECT node, max(calls) AS most_calls, max(calls) >= 2 AND node <> 'e' AS cache FROM ({_COUNTS}) GROUP BY 1")
def cache_plan_sweep(spark: SparkSession, d: str) -> DataFrame:
    return cache_plan(_sweep_flow(), "e", _sweep_rows(spark, d))


# tables, casts, errors


@query(
    "SELECT n_name AS nation, r_name AS region, n_name || ' in ' || r_name AS place, (SELECT count(*) FROM nation) AS nations "
    "FROM nation JOIN region ON n_regionkey = r_regionkey"
)
def table_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Outputs, the inputs that label them and a scalar in one table."""
    n = read_table(spark, d, "nation")
    nation = AxisFrame.from_table(n.select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("k"), "n_name"), "nation", ["r", "k"], "n_name")
    region = _frame(spark, d, "region", "r_regionkey", "r_name", "region").rename_axes({"r_regionkey": "r"})
    flow = Flow([
        Node(lambda nation, region: F.concat_ws(" in ", nation, region), "place", spec="nation[r, k], region[r] -> place[r, k]"),
        Node(lambda place: F.count(place), "nations", kind="aggregate"),
    ])
    return flow.map(spark, {"nation": nation, "region": region}).to_table("place", "nations")


@query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2")
def composite_coord(spark: SparkSession, d: str) -> DataFrame:
    li = _lineitem(spark, d).select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return split_composite(composite(li, ["flag", "status"]).groupBy("flag:status").agg(F.count("*").alias("n")), "flag:status").select("flag", "status", "n")


@query("SELECT event_id AS e, try_cast(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k FROM events")
def type_cast(spark: SparkSession, d: str) -> DataFrame:
    k = _frame(spark, d, "events", "event_id", F.regexp_extract("props", "[0-9]+", 0), "k").rename_axes({"event_id": "e"})
    return cast(k, "double").df


def _error_flow(spark: SparkSession, d: str, out: str):
    """One output and what it needs: nothing is read twice, so nothing is kept."""

    def body(x: float) -> float:
        if x < 0:
            raise ValueError("negative")
        return 1.5 * x

    x = _frame(spark, d, "customer", "c_custkey", "c_acctbal", "x").rename_axes({"c_custkey": "c"})
    home = _frame(spark, d, "customer", "c_nationkey c_custkey", F.lit(1), "home").rename_axes({"c_custkey": "c", "c_nationkey": "n"})
    flow = Flow([
        Node(body, "y", kind="python", returns="double", spec="x[c] -> y[c]"),
        Node(lambda y: y + 1, "z", spec="y[c] -> z[c]"),
        Node(lambda y, home: y * home, "there", spec="y[c], home[n, c] -> there[n, c]"),
        Node(lambda there: F.count(there), "m", kind="aggregate", spec="there[n, :] -> m[n]"),
    ], check_types=False)
    flow = flow.sub(outputs=[out])
    return flow.map(spark, {k: v for k, v in (("x", x), ("home", home)) if k in flow.roots()}, errors="continue")


@query("SELECT c_custkey AS c, CASE WHEN c_acctbal >= 0 THEN 1.5 * c_acctbal END AS y, CASE WHEN c_acctbal < 0 THEN 'ValueError' END AS error, CASE WHEN c_acctbal < 0 THEN 'negative' END AS message FROM customer")
def error_continue(spark: SparkSession, d: str) -> DataFrame:
    return _error_flow(spark, d, "y")["y"].df.select("c", "y", F.col("y__error.type").alias("error"), F.col("y__error.message").alias("message"))


@query("SELECT c_custkey AS c, CASE WHEN c_acctbal >= 0 THEN 1.5 * c_acctbal + 1 END AS z, CASE WHEN c_acctbal < 0 THEN 'input_is_error' END AS reason FROM customer")
def error_propagate_elementwise(spark: SparkSession, d: str) -> DataFrame:
    return _error_flow(spark, d, "z")["z"].df.select("c", "z", F.col("z__error.reason").alias("reason"))


@query(
    "SELECT c_nationkey AS n, CASE WHEN min(c_acctbal) >= 0 THEN count(*) END AS m, CASE WHEN min(c_acctbal) < 0 THEN 'array_contains_errors' END AS reason, "
    "CASE WHEN min(c_acctbal) < 0 THEN count(*) FILTER (c_acctbal < 0) END AS failed FROM customer GROUP BY 1"
)
def error_propagate_reduce(spark: SparkSession, d: str) -> DataFrame:
    return _error_flow(spark, d, "m")["m"].df.select("n", "m", F.col("m__error.reason").alias("reason"), F.col("m__error.count").alias("failed"))


# nodes


@query("SELECT o_orderkey AS row_axis, o_totalprice + 1 AS y FROM orders")
def rename_axes(spark: SparkSession, d: str) -> DataFrame:
    x = _frame(spark, d, "orders", "o_orderkey", "o_totalprice", "x").rename_axes({"o_orderkey": "row_axis"})
    flow = Flow([Node(lambda x: x + 1, "y", spec="x[o] -> y[o]")])
    flow.rename_axes({"o": "row_axis"})
    return flow.map(spark, {"x": x})["y"].df


@query("SELECT o_orderkey AS o, (o_totalprice + 1) * 2 AS z FROM orders")
def nested_fuse(spark: SparkSession, d: str) -> DataFrame:
    x = _frame(spark, d, "orders", "o_orderkey", "o_totalprice", "x").rename_axes({"o_orderkey": "o"})
    flow = Flow([Node(lambda x: x + 1, "y", spec="x[o] -> y[o]"), Node(lambda y: y * 2, "z", spec="y[o] -> z[o]")])
    flow.nest("*", "z")
    return flow.map(spark, {"x": x})["z"].df


@query("SELECT o_orderkey AS o, o_totalprice + 100 * 3 + 7 AS y FROM orders")
def bound_default_args(spark: SparkSession, d: str) -> DataFrame:
    """Bound values win over given ones, given ones over defaults."""
    x = _frame(spark, d, "orders", "o_orderkey", "o_totalprice", "x").rename_axes({"o_orderkey": "o"})
    n = Node(lambda x, a=1, b=2, c=7: x + a * b + c, "y", spec="x[o] -> y[o]", bound={"a": 100})
    return Flow([n]).map(spark, {"x": x, "b": 3})["y"].df


@query("SELECT o_orderkey AS o, o_totalprice * 10 AS y FROM orders")
def variant_select(spark: SparkSession, d: str) -> DataFrame:
    x = _frame(spark, d, "orders", "o_orderkey", "o_totalprice", "x").rename_axes({"o_orderkey": "o"})
    nodes = [Node(lambda x: x + 10, "y", spec="x[o] -> y[o]", variant="add"), Node(lambda x: x * 10, "y", spec="x[o] -> y[o]", variant="times")]
    return VariantFlow(nodes, default="add").choose("times").map(spark, {"x": x})["y"].df


@query("SELECT l_orderkey AS o, l_linenumber AS r, l_quantity AS quantity, l_discount AS discount FROM lineitem")
def struct_collect(spark: SparkSession, d: str) -> DataFrame:
    cells = AxisFrame.from_table(_lineitem(spark, d), "cell", ["l_orderkey", "l_linenumber"], F.struct(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount")))
    made = nest([attribute("quantity", "cell"), attribute("discount", "cell"), gather(["quantity", "discount"], "both")], "both").copy(spec="cell[o, r] -> both[o, r]")
    return compile_node(spark, made, {"cell": cells.rename_axes({"l_orderkey": "o", "l_linenumber": "r"})})["both"].df.select("o", "r", "both.*")


@query("SELECT l_orderkey AS o, l_tax AS tax FROM lineitem")
def attr_get(spark: SparkSession, d: str) -> DataFrame:
    cells = AxisFrame.from_table(_lineitem(spark, d), "cell", ["l_orderkey"], F.struct(F.col("l_tax").alias("tax")))
    return compile_node(spark, attribute("tax", "cell").copy(spec="cell[o] -> tax[o]"), {"cell": cells.rename_axes({"l_orderkey": "o"})})["tax"].df


@query("SELECT l_orderkey, l_linenumber, l_quantity * l_quantity + l_discount AS y FROM lineitem")
def memo_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """A costly body runs once for each distinct pair of arguments."""
    li = _lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    costly = F.pandas_udf(lambda q, k: q * q + k, "double")
    made = once_for_each(li, ["l_quantity", "l_discount"], lambda u: u.withColumn("y", costly("l_quantity", "l_discount")))
    return made.select("l_orderkey", "l_linenumber", "y")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS deviation, max(value) AS most FROM events GROUP BY 1")
def running_statistics(spark: SparkSession, d: str) -> DataFrame:
    return running_stats(read_table(spark, d, "events"), "event_type", "value")


@query("SELECT 'y' AS output, count(*) FILTER (n_nationkey < 10) AS stored, 0::BIGINT AS failed, count(*) AS total, 'incomplete' AS state, count(*) FILTER (n_nationkey < 10)::DOUBLE / count(*) AS share FROM nation")
def status_progress(spark: SparkSession, d: str) -> DataFrame:
    """How far a run in a folder has come, and the share done as live counts tell it."""
    keys = [r[0] for r in read_table(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    folder = scratch_folder(spark, "status")
    Flow([Node(lambda x: x + 1, "y", spec="x[i] -> y[i]")]).map(spark, {"x": keys}, folder=folder, fixed={"i": slice(0, 10)})
    found = RunFolder(spark, folder).status()
    done = Status(len(keys))
    done.start(10)
    done.finish(10)
    return found.withColumn("share", F.lit(done.share))


@query("SELECT p_partkey AS n, p_partkey // 50 % 40 AS i, p_partkey // 10 % 5 AS j, p_partkey % 10 AS k, p_partkey // 50 % 40 * 50 + p_partkey // 10 % 5 * 10 + p_partkey % 10 AS back FROM part")
def linear_indices(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part").select(F.col("p_partkey").alias("n"))
    out = p.select("n", *unravel(F.col("n"), "ijk", (40, 5, 10)))
    return out.withColumn("back", linear_index("ijk", (40, 5, 10)))


@query("SELECT i, j FROM (SELECT unnest(range(5)) AS i), (SELECT unnest(range(7)) AS j) WHERE (i + j) % 4 <> 0")
def missing_cells(spark: SparkSession, d: str) -> DataFrame:
    """The index space without the cells that are stored."""
    full = space(spark, {"i": 5, "j": 7})
    held = AxisFrame(full.filter("(i + j) % 4 = 0").withColumn("x", F.lit(1)), "x", ("i", "j"), {"i": 5, "j": 7})
    return held.missing()


@query("SELECT o_orderkey AS o, o_totalprice * (1 - length(o_orderpriority) / 100.0) AS rev FROM orders")
def pandas_udf_map(spark: SparkSession, d: str) -> DataFrame:
    """An opaque body over whole Arrow batches."""
    price = _frame(spark, d, "orders", "o_orderkey", "o_totalprice", "price").rename_axes({"o_orderkey": "o"})
    off = _frame(spark, d, "orders", "o_orderkey", F.length("o_orderpriority") / 100.0, "off").rename_axes({"o_orderkey": "o"})
    n = Node(lambda price, off: price * (1 - off), "rev", kind="batch", returns="double", spec="price[o], off[o] -> rev[o]")
    return Flow([n]).map(spark, {"price": price, "off": off})["rev"].df


@query("SELECT o_orderkey AS o, o_orderstatus || ':' || length(o_orderpriority) AS tag FROM orders")
def python_map(spark: SparkSession, d: str) -> DataFrame:
    """A Python body called cell by cell."""
    state = _frame(spark, d, "orders", "o_orderkey", "o_orderstatus", "state").rename_axes({"o_orderkey": "o"})
    level = _frame(spark, d, "orders", "o_orderkey", "o_orderpriority", "level").rename_axes({"o_orderkey": "o"})
    n = Node(lambda state, level: f"{state}:{len(level)}", "tag", kind="python", returns="string", spec="state[o], level[o] -> tag[o]")
    return Flow([n]).map(spark, {"state": state, "level": level})["tag"].df


@query("SELECT conv_id AS c, round(var_pop(length(text)), 4) AS v FROM conversations GROUP BY 1")
def opaque_reduce(spark: SparkSession, d: str) -> DataFrame:
    """A Python body over the reduced cells of each group."""
    n_chars = _frame(spark, d, "conversations", "conv_id turn", F.length("text").cast("double"), "n").rename_axes({"conv_id": "c"})

    def body(n):
        import numpy as np

        return round(float(np.var(np.asarray([x for x in np.ma.getdata(n) if x is not None], float))), 4)

    return compile_node(spark, Node(body, "v", kind="python", returns="double", spec="n[c, :] -> v[c]"), {"n": n_chars})["v"].df


@query("SELECT o_orderkey AS o, o_totalprice * 1.5 + 2 AS y FROM orders")
def sql_body(spark: SparkSession, d: str) -> DataFrame:
    x = _frame(spark, d, "orders", "o_orderkey", "o_totalprice", "x").rename_axes({"o_orderkey": "o"})
    n = Node("x * f + 2", "y", kind="sql", parameters=["x", "f"], defaults={"f": 1.5}, spec="x[o] -> y[o]")
    return Flow([n]).map(spark, {"x": x})["y"].df


@query("SELECT i, j, (3 * 40)::BIGINT AS e FROM (SELECT unnest(range(40)) AS i), (SELECT unnest(range(40)) AS j)")
def sweep_cube(spark: SparkSession, d: str, n: int = 40, kind: str = "column") -> DataFrame:
    """A zip, a product of three axes and a reduction over generated numbers."""
    return cube_flow(kind).map(spark, {p: range(n) for p in ("a", "b", "x", "y")})["e"].df


def cube_flow(kind: str = "column") -> Flow:
    """``n`` zipped calls, then ``n**3`` calls, then a sum for each of ``n**2`` groups; the calls native, or opaque to Spark (``batch``, ``python``)."""
    made = {} if kind == "column" else {"kind": kind, "returns": "bigint"}
    return Flow([
        Node(lambda a, b: a * 0 + b * 0 + 1, "c", spec="a[k], b[k] -> c[k]", **made),
        Node(lambda c, x, y: c * 3 + (x + y) * 0, "d", spec="c[k], x[i], y[j] -> d[i, j, k]", **made),
        Node(lambda d: F.sum(d), "e", kind="aggregate", spec="d[i, j, :] -> e[i, j]"),
    ])


# event windows


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DECIMAL(28,4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    return windowed(read_table(spark, d, "events"))


@query(
    "WITH s AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM s) "
    "SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", user_id, count(*) AS n FROM g GROUP BY user_id, k"
)
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    return sessions(read_table(spark, d, "events"))
