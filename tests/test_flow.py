from typing import Any

import numpy as np
import pytest

from axisloom.functions import cache as C
from axisloom.functions.node import Node, Resources, attribute, chain, gather, nest, node
from axisloom.functions.testing import replaced
from axisloom.plans.flow import Flow, UnusedInputs, VariantFlow
from axisloom.plans.types import Array, compatible, same
from axisloom.sources.sweep import Sweep, fixed_points, sweep_inputs


def parcels():
    """What it costs to send a box: its volume, its weight by volume, and a fee on both."""

    def volume(width, height, depth):
        return width * height * depth

    def weight(volume, density=2):
        return volume * density

    def fee(volume, weight, rate, surcharge=10):
        return rate * max(volume, weight) + surcharge

    return Flow([Node(fee, "fee"), Node(volume, "volume"), Node(weight, "weight")])


BOX = {"width": 2, "height": 3, "depth": 4}


def test_run_and_call():
    flow = parcels()
    assert flow("fee", **BOX, rate=5) == 250
    assert flow.run("fee", **BOX, rate=5, density=1, full=True) == {**BOX, "rate": 5, "density": 1, "volume": 24, "weight": 24, "fee": 130}
    assert flow.run(["volume", "weight"], **BOX) == (24, 48)
    assert flow.function("weight")(**BOX, density=0.5) == 12 and flow.function("weight").full(**BOX)["volume"] == 24
    assert flow.run("fee", volume=1, weight=0, rate=7) == 17  # intermediates cut the flow
    with pytest.raises(UnusedInputs):
        flow.run("volume", **BOX, colour="red")
    assert flow.run("volume", **BOX, colour="red", allow_unused=True) == 24
    with pytest.raises(ValueError, match="missing"):
        flow.run("volume", width=1, depth=2)


def test_graph():
    flow = parcels()
    assert flow.roots("fee") == ["density", "depth", "height", "rate", "surcharge", "width"] and flow.roots("volume") == sorted(BOX)
    assert flow.upstream("fee") == ["volume", "weight"] and flow.downstream("depth") == ["fee", "volume", "weight"] and flow.downstream("rate") == ["fee"]
    assert [[n.out[0] for n in level] for level in flow.generations()] == [["volume"], ["weight"], ["fee"]]
    box, rest = ("depth", "height", "width"), ("rate", "surcharge")
    assert set(flow.argument_sets("fee")) == {tuple(sorted(x)) for x in (("volume", "weight", *rest), ("volume", "density", *rest), (*box, "weight", *rest), (*box, "density", *rest))}
    assert [n.out for n in flow.leaves()] == [("fee",)] and [n.out for n in flow.sources()] == [("volume",)]
    assert flow.info()["required_inputs"] == ("depth", "height", "rate", "width") and flow.info()["optional_inputs"] == ("density", "surcharge")
    assert flow.defaults() == {"density": 2, "surcharge": 10}
    assert "digraph" in flow.dot() and "weight = weight(volume, density=2)" in flow.describe()


def test_precedence_and_changes():
    n = Node(lambda a, b=2: (a, b), "y", bound={"b": 9})
    assert n(a=1) == (1, 9) and n(a=1, b=5) == (1, 9)
    with pytest.raises(ValueError):
        n(a=1, q=2)
    m = Node(lambda a, b: a - b, "y", renames={"a": "x"}, defaults={"b": 1})
    assert m(x=5) == 4
    m.update_renames({"x": "z", "y": "w"})
    assert m.parameters == ("z", "b") and m.out == ("w",) and m(z=3) == 2
    m.update_renames({"a": "k"}, update_from="original")
    assert m.parameters == ("k", "b")
    with pytest.raises(ValueError):
        m.update_renames({"nothing": "x"})
    with pytest.raises(ValueError):
        Node(lambda a, a2: 0, "y", renames={"a2": "a"})


def test_scopes():
    flow = parcels()
    flow.update_scope("box", inputs=BOX, outputs=["volume"])
    assert flow.roots() == ["box.depth", "box.height", "box.width", "density", "rate", "surcharge"]
    assert flow.run("fee", box=BOX, rate=5) == 250
    flow.update_scope(None, inputs="*", outputs="*")
    assert flow.roots("volume") == sorted(BOX)


def test_algebra():
    flow = parcels()
    assert sorted(flow.sub(outputs=["weight"]).makers()) == ["volume", "weight"]
    assert sorted(flow.sub(inputs=["volume", "rate"], outputs=["fee"]).makers()) == ["fee", "weight"]
    with pytest.raises(ValueError):
        flow.sub(inputs=["weight"], outputs=["fee"])
    other = Flow([Node(lambda p: p, "q")])
    both = flow | other
    assert sorted(len(f.nodes) for f in both.split()) == [1, 3]
    with pytest.raises(ValueError):
        flow.split()
    fused = flow.copy()
    fused.nest(["volume", "weight"], ("volume", "weight"))
    assert fused("fee", **BOX, rate=5) == 250 and len(fused.nodes) == 2
    assert flow.simplified()("fee", **BOX, rate=5) == 250
    flow.replace(Node(lambda width, height, depth: max(width, height, depth) ** 3, "volume"))
    assert flow("weight", **BOX) == 128
    flow.drop("fee")
    assert "fee" not in flow
    with pytest.raises(ValueError):
        Flow([Node(lambda a: a, "b"), Node(lambda b: b, "a")])
    with pytest.raises(ValueError):
        Flow([Node(lambda a: a, "b"), Node(lambda c: c, "b")])
    with pytest.raises(ValueError):
        Flow([Node(lambda a=1: a, "b"), Node(lambda a=2: a, "c")])


def test_axes_in_flows():
    flow = Flow([Node(lambda a, b: a, "c"), Node(lambda c, d: c, "e"), Node(lambda e: e, "f")], check_types=False)
    flow.nodes[0].spec = None
    flow.add_axis("a", axis="i")
    flow.add_axis("b", axis="j")
    assert [str(s) for s in flow.specs()] == ["a[i], b[j] -> c[i, j]", "c[i, j] -> e[i, j]", "e[i, j] -> f[i, j]"]
    flow.add_axis("d", axis="i")
    assert str(flow["e"].spec) == "c[i, j], d[i] -> e[i, j]"
    flow.rename_axes({"i": "t"})
    assert flow.independent_axes("f") == ("t", "j")
    assert flow.shapes({"a": [1, 2], "b": [1, 2, 3], "d": [1, 2]})["f"] == (2, 3)
    made = Flow([Node(lambda: [1], "y", spec="... -> y[i]", kind="arrays"), Node(lambda y, z: y, "r", spec="z[i], y[i] -> r[i]")])
    assert made.independent_axes("r") == ()
    grown = Flow([Node(lambda x: [x], "y", spec="... -> y[i]", kind="arrays")])
    grown.add_axis("x", axis="k")
    assert str(grown["y"].spec) == "x[k] -> y[i, k]"
    whole = Flow([Node(lambda x: x, "y", spec="x[i, j] -> y[i, j]"), Node(lambda y: y, "s", kind="aggregate")])
    whole.add_axis("x", axis="k")
    assert str(whole["s"].spec) == "y[:, :, k] -> s[k]"
    inferred = Flow([Node(lambda n: n, "x", kind="arrays"), Node(lambda x: x, "y", spec="x[i] -> y[i]")])
    assert str(inferred["x"].spec) == "... -> x[i]"
    assert fixed_points(flow, "f", {"t": 2, "j": 1}) == [{"t": 0, "j": 0}, {"t": 1, "j": 0}]


def test_types():
    assert compatible(int, int) and not compatible(int, float) and compatible(int, int | str) and not compatible(int | str, int)
    assert compatible(list[int], list) and compatible(list[int], list[int]) and not compatible(list[int], list[str])
    assert compatible(Array[int], np.ndarray) and not compatible(Array[int], Array[str]) and compatible(Any, int)

    def f(x: int) -> int:
        return x

    def g(y: str) -> str:
        return y

    def h(y: Array[int]) -> int:
        return 0

    assert Flow([Node(f, "y", spec="x[i, j] -> y[i, j]")]).input_schema() == {"x": "array<array<bigint>>"}
    assert Flow([Node(f, "y")]).output_hints() == {"y": int} and Flow([Node(g, "z")]).input_hints() == {"y": str}
    with pytest.raises(TypeError):
        Flow([Node(f, "y"), Node(g, "z")])
    Flow([Node(f, "y", spec="x[i] -> y[i]"), Node(h, "z", kind="python", returns="int")])
    with pytest.raises(TypeError):
        Flow([Node(f, "y", spec="x[i] -> y[i]"), Node(f, "z", renames={"x": "y"}, kind="python", returns="int")])
    assert same(1, 1.0) is False and same(0.1 + 0.2, 0.3) and same({"a": np.arange(3)}, {"a": np.arange(3)})
    assert same([1, [2]], [1, [2]]) and same((1,), [1]) is False


def test_helpers():
    def first(x):
        return x + 1

    def second(y):
        return y * 2

    line = Flow(chain([first, second]))
    assert line.run(x=3) == 8
    assert gather(["a", "b"])(a=1, b=2) == {"a": 1, "b": 2}
    assert attribute("real", "z")(z=3 + 4j) == 3
    deco = node("y")(first)
    assert deco(x=1) == 2
    fused = nest([Node(first, "y"), Node(second, "z")], "z")
    assert fused(x=1) == 4 and fused.parameters == ("x",)
    with pytest.raises(ValueError):
        nest([Node(first, "y")])


def test_variants():
    nodes = [Node(lambda a: a, "b"), Node(lambda b: b + 1, "c", variant="one", variant_group="g"), Node(lambda b: b + 2, "c", variant="two", variant_group="g")]
    v = VariantFlow(nodes, default={"g": "one"})
    assert v.choose()("c", a=1) == 2 and v.choose("two")("c", a=1) == 3
    assert v.variants() == {"g": {"one", "two"}}
    with pytest.raises(ValueError):
        v.choose("three")
    f = lambda a: a
    merged = VariantFlow.merge({"x": Flow([Node(f, "b"), Node(lambda b: b, "c")]), "y": Flow([Node(f, "b"), Node(lambda b: -b, "c")])})
    assert merged.choose("y")("c", a=4) == -4 and len(merged.nodes) == 3


def test_sweeps():
    items = {"a": [1, 2], "b": [3, 4], "c": [5, 6]}
    assert len(Sweep(items).list()) == 8 and Sweep(items).list()[1] == {"a": 1, "b": 3, "c": 6}
    assert [tuple(r.values()) for r in Sweep(items, [("a", "b"), "c"])] == [(1, 3, 5), (1, 3, 6), (2, 4, 5), (2, 4, 6)]
    assert len(Sweep(items, exclude=lambda r: r["a"] == 1 and r["b"] == 3)) == 6
    s = Sweep({"a": [1]}, constants={"a": 9, "k": 2}, derivers={"z": lambda r: r["a"] + r["k"]})
    assert s.list() == [{"a": 1, "k": 2, "z": 3}]
    assert (Sweep({"a": [1]}) + Sweep({"b": [2]})).list() == [{"a": 1}, {"b": 2}]
    assert len(Sweep({"a": [1, 2]}).product(Sweep({"b": [1, 2]}), Sweep({"c": [1, 2, 3]}))) == 12
    assert Sweep({"a": [1, 1, 2], "c": [1, 2, 3]}).only(["a"]) == [{"a": 1}, {"a": 2}]
    with pytest.raises(ValueError):
        Sweep({"a": [1, 2], "b": [1]}, [("a", "b")])
    flow, inputs = sweep_inputs(Flow([Node(lambda a, b: a, "c")]), Sweep({"a": [1, 2], "b": [3]}))
    assert str(flow["c"].spec) == "a[sweep], b[sweep] -> c[sweep]" and inputs == {"a": [1, 2], "b": [3, 3]}


def test_caches(tmp_path):
    calls = []
    for cache in (C.Simple(), C.Recent(2), C.Weighted(2), C.Disk(tmp_path, 2, C.Simple())):
        calls.clear()
        data = [np.arange(3), np.arange(3), np.arange(4)]
        cache.clear()
        g = C.memoize(cache)(lambda x: calls.append(1) or int(np.sum(x)))
        assert [g(d) for d in data] == [3, 3, 6] and len(calls) == 2
    recent = C.Recent(2)
    for k in "abc":
        recent.put(k, k)
    assert "a" not in recent and recent.get("c") == "c"
    weighted = C.Weighted(2)
    weighted.put("a", 1, 10.0)
    weighted.put("b", 2, 0.1)
    weighted.get("a")
    weighted.put("c", 3, 5.0)
    assert "a" in weighted and "b" not in weighted
    assert C.as_key({"a": [1, {2}]}) == C.as_key({"a": [1, {2}]}) != C.as_key({"a": [1, {3}]})
    assert C.as_key([1]) != C.as_key((1,))


def test_resources():
    r = Resources(cpus=2, memory="2GB").updated(cpus=4, queue="x")
    assert r.cpus == 4 and r.extra == {"queue": "x"}
    assert r.over(Resources(gpus=1, extra={"y": 1})).gpus == 1 and r.over(Resources(extra={"y": 1})).extra == {"y": 1, "queue": "x"}
    top = Resources.most([Resources(cpus=1, memory="3GB", time="1:00:00"), Resources(cpus=8, memory="500MB", time="59:59")])
    assert (top.cpus, top.memory, top.time) == (8, "3GB", "1:00:00")
    with pytest.raises(ValueError):
        Resources(cpus=0)
    with pytest.raises(ValueError):
        Resources(memory="lots")


def test_replaced_bodies():
    flow = parcels()
    with replaced(flow, "volume", return_value=100) as mock:
        assert flow("weight", **BOX) == 200
    mock.assert_called_once_with(**BOX)
    assert flow("weight", **BOX) == 48
    with replaced(flow, "volume", lambda **_: 7):
        assert flow("weight", **BOX) == 14


def test_resources_of_arguments():
    by_size = Node(lambda n: n, "y", resources=lambda values: Resources(cpus=values["n"]))
    flow = Flow([by_size], resources=Resources(memory="2GB"))
    assert flow["y"].needs({"n": 4}) == Resources(cpus=4, memory="2GB")
    fused = nest([by_size, Node(lambda y: y, "z", resources=Resources(cpus=2))], "z")
    assert fused.needs({"n": 1}).cpus == 2 and fused.needs({"n": 9}).cpus == 9 and Node(lambda n: n, "y").needs() is None


def test_documentation():
    def area(width: int, height: int = 2) -> int:
        """The area of a sheet.

        width: of the sheet, in mm
        """
        return width * height

    rows = {r["name"]: r for r in Flow([Node(area, "area")]).documentation()}
    assert rows["width"] == {"name": "width", "role": "input", "type": "int", "default": None, "text": "of the sheet, in mm"}
    assert rows["height"]["default"] == 2 and rows["area"] == {"name": "area", "role": "output", "type": "int", "default": None, "text": "The area of a sheet."}
