"""Flows: graphs of nodes, and what can be asked of them and done to them without data."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Mapping
from graphlib import CycleError, TopologicalSorter
from typing import Any

from axisloom.functions.node import Node, Resources
from axisloom.plans.spec import UNKNOWN, ArrayRef, IndexSpec, axes_of, check_axes, reduced_axes, shape_of
from axisloom.plans.types import Array, Missing, compatible, same


def _type_name(hint: Any) -> str | None:
    return None if hint in (None, Missing) else getattr(hint, "__name__", str(hint))


class UnusedInputs(ValueError):
    """Values were given that nothing takes."""


class Flow:
    """Nodes joined by names: a parameter takes the output of that name, or is an input of the flow.

    Nodes are copied, so changes here don't reach other flows.
    """

    def __init__(self, nodes: Iterable[Node | tuple[Node, str]], *, check_types: bool = True, scope: str | None = None, name: str | None = None, description: str | None = None, resources: Resources | None = None) -> None:
        self.nodes: list[Node] = []
        self.check_types, self.name, self.description, self.resources = check_types, name, description, resources
        for n in nodes:
            self._place(*(n if isinstance(n, tuple) else (n, None)))
        if scope:
            self.update_scope(scope, inputs="*", outputs="*")
        self.validate()

    # the graph

    def _place(self, n: Node, spec: str | None = None) -> Node:
        n = n.copy(**({"spec": spec} if spec else {}))
        taken = {o for m in self.nodes for o in m.out} & set(n.out)
        if taken:
            raise ValueError(f"{sorted(taken)} are made already")
        if n.resources is not None or self.resources is not None:
            own, base = n.resources, self.resources
            n.resources = (lambda values: own(values).over(base)) if callable(own) else (own or Resources()).over(base)
        self.nodes.append(n)
        return n

    def add(self, n: Node, spec: str | None = None) -> Node:
        """Add a node; returns the flow's copy."""
        n = self._place(n, spec)
        try:
            self.validate()
        except Exception:
            self.nodes.remove(n)
            raise
        return n

    def drop(self, out: str) -> Node:
        """Take out the node that makes ``out``."""
        n = self.node(out)
        self.nodes.remove(n)
        return n

    def replace(self, new: Node, old: str | None = None) -> Node:
        """Put a node in the place of another, by default of the one with its outputs."""
        self.drop(old or new.out[0])
        return self.add(new)

    def node(self, out: str) -> Node:
        """The node that makes an output."""
        found = self.makers().get(out)
        if found is None:
            raise KeyError(f"nothing makes {out!r}; outputs are {sorted(self.makers())}")
        return found

    def __getitem__(self, out: str) -> Node:
        return self.node(out)

    def __contains__(self, out: str) -> bool:
        return out in self.makers()

    def __or__(self, other: Flow | Node) -> Flow:
        return self.join(other)

    def makers(self) -> dict[str, Node]:
        """Output name to node."""
        return {o: n for n in self.nodes for o in n.out}

    def before(self, n: Node) -> list[Node]:
        """Nodes that a node takes from directly."""
        makers = self.makers()
        return list({id(m): m for p in n.free if (m := makers.get(p)) is not None}.values())

    def _sorter(self) -> TopologicalSorter:
        at = {id(n): k for k, n in enumerate(self.nodes)}
        return TopologicalSorter({k: [at[id(m)] for m in self.before(n)] for k, n in enumerate(self.nodes)})

    def generations(self) -> list[list[Node]]:
        """Levels of nodes that need earlier levels only, each sorted by output."""
        sorter, levels = self._sorter(), []
        sorter.prepare()
        while sorter.is_active():
            ready = sorter.get_ready()
            levels.append(sorted((self.nodes[k] for k in ready), key=lambda n: n.out))
            sorter.done(*ready)
        return levels

    def order(self) -> list[Node]:
        """All nodes, each after those it needs."""
        return [n for level in self.generations() for n in level]

    def leaves(self) -> list[Node]:
        """Nodes whose outputs no other node takes."""
        used = {p for n in self.nodes for p in n.free}
        return [n for n in self.nodes if not used & set(n.out)]

    def sources(self) -> list[Node]:
        """Nodes that take from no other node."""
        return [n for n in self.nodes if not self.before(n)]

    def upstream(self, out: str) -> list[str]:
        """Outputs that an output needs, directly or not."""
        seen: list[str] = []
        stack = [self.node(out)]
        while stack:
            for m in self.before(stack.pop()):
                if not set(m.out) <= set(seen):
                    seen += m.out
                    stack.append(m)
        return sorted(seen)

    def downstream(self, name: str) -> list[str]:
        """Outputs that need a name, directly or not."""
        seen: set[str] = set()
        stack = [name]
        while stack:
            at = stack.pop()
            for n in self.nodes:
                if at in n.free and not set(n.out) <= seen:
                    seen |= set(n.out)
                    stack += n.out
        return sorted(seen)

    def roots(self, out: str | None = None) -> list[str]:
        """Sorted inputs that an output, or the flow, needs."""
        makers = self.makers()
        names = set(makers) if out is None else {out, *self.upstream(out)}
        return sorted({p for o in names for p in makers[o].free if p not in makers})

    def argument_sets(self, out: str) -> list[tuple[str, ...]]:
        """Every set of names from which an output can be computed."""
        makers = self.makers()
        found: set[tuple[str, ...]] = set()
        tried: set[frozenset[str]] = set()

        def given(computed: frozenset[str]) -> None:
            """What has to be given when these outputs are computed and no others."""
            if computed in tried:
                return
            tried.add(computed)
            needed, seen, stack = set(), set(), list(self.node(out).free)
            while stack:
                p = stack.pop()
                if p in computed and p not in seen:
                    seen.add(p)
                    stack += makers[p].free
                elif p not in computed:
                    needed.add(p)
            found.add(tuple(sorted(needed)))
            for p in needed & set(makers):
                given(computed | set(makers[p].out))

        given(frozenset())
        return sorted(found, key=lambda k: (len(k), k))

    def parts(self) -> list[list[Node]]:
        """Connected parts; nodes that share an input are connected."""
        left, out = list(self.nodes), []
        while left:
            group, names = [left.pop(0)], set()
            grown = True
            while grown:
                names = {x for n in group for x in (*n.free, *n.out)}
                more = [n for n in left if names & {*n.free, *n.out}]
                group += more
                left = [n for n in left if n not in more]
                grown = bool(more)
            out.append(group)
        return out

    # names, values, axes

    def defaults(self) -> dict[str, Any]:
        """Defaults of the flow's inputs."""
        makers = self.makers()
        return {p: n.defaults[p] for n in self.nodes for p in n.free if p in n.defaults and p not in makers}

    def input_hints(self) -> dict[str, Any]:
        """Annotations of the inputs; the first one counts."""
        out: dict[str, Any] = {}
        for n in self.order():
            for p, t in n.hints.items():
                if p in self.roots():
                    out.setdefault(p, t)
        return out

    def output_hints(self) -> dict[str, Any]:
        return {o: t for n in self.order() for o, t in n.out_hints.items()}

    def specs(self) -> list[IndexSpec]:
        """All specs, in order of evaluation."""
        return [n.spec for n in self.order() if n.spec is not None]

    def axes(self) -> dict[str, tuple[str | None, ...]]:
        """Axes of every indexed array."""
        return axes_of(self.specs())

    def reduced(self) -> dict[str, set[str]]:
        """Axes that some consumer reduces."""
        axes = self.axes()
        whole = [p for n in self.nodes for p in n.free if p in axes and (n.spec is None or p not in n.spec.names(made=False))]
        return reduced_axes(self.specs(), whole)

    def independent_axes(self, out: str) -> tuple[str, ...]:
        """Axes that run from the inputs through to an output, neither created nor reduced on the way."""
        spec = self.node(out).spec
        if spec is None:
            return ()
        way = self.sub(outputs=[out])  # what reads the output, or reduces it later, doesn't count
        created = {a for n in way.nodes if n.spec for a in n.spec.created}
        gone = {a for axes in way.reduced().values() for a in axes}
        return tuple(a for a in spec.axes if a not in created | gone)

    def shapes(self, inputs: Mapping[str, Any], internal: Mapping[str, tuple] | None = None) -> dict[str, tuple]:
        """Shapes of all indexed arrays, unknown sizes as ``"?"``."""
        axes = self.axes()
        made = self.makers()
        out = {k: shape_of(v, k)[: len(axes[k])] if not hasattr(v, "shape") or not callable(v.shape) else v.shape() for k, v in inputs.items() if k in axes and k not in made}
        for n in self.order():
            if n.spec is None:
                continue
            own = {**({o: n.internal_shape for o in n.out} if n.internal_shape else {}), **(internal or {})}
            shape, _ = n.spec.shape({i.name: out.get(i.name, (UNKNOWN,) * i.rank) for i in n.spec.inputs}, own)
            out |= dict.fromkeys(n.out, shape)
        return out

    # checks

    def validate(self) -> None:
        """Raise where names, defaults, axes or types don't fit."""
        try:
            self.generations()
        except CycleError as e:
            raise ValueError("the nodes form a cycle") from e
        seen: dict[str, Any] = {}
        makers = self.makers()
        for n in self.nodes:
            for p in n.free:
                if p in n.defaults and p not in makers:
                    if p in seen and same(seen[p], n.defaults[p]) is False:
                        raise ValueError(f"{p!r} has the defaults {seen[p]!r} and {n.defaults[p]!r}")
                    seen[p] = n.defaults[p]
        names = {x for n in self.nodes for x in (*n.parameters, *n.out)}
        clash = {x.split(".")[0] for x in names if "." in x} & names
        if clash:
            raise ValueError(f"{sorted(clash)} are both scopes and names")
        self._infer_sources()
        check_axes(self.specs())
        if self.check_types:
            self._check_types()

    def _infer_sources(self) -> None:
        """A node without a spec whose output others index creates those axes."""
        axes = self.axes()
        for n in self.nodes:
            if n.spec is None and any(o in axes for o in n.out):
                known = next(axes[o] for o in n.out if o in axes)
                named = tuple(a or f"axis_{k}" for k, a in enumerate(known))
                n.spec = IndexSpec((), tuple(ArrayRef(o, named) for o in n.out))
                n.inferred = True
                axes = self.axes()

    def _check_types(self) -> None:
        makers = self.makers()
        for n in self.nodes:
            for p, wanted in n.hints.items():
                source = makers.get(p)
                if source is None or p in n.bound or getattr(source, "inferred", False) or source.spec and source.spec.created:
                    continue
                given = source.out_hints.get(p, Missing)
                if given is Missing:
                    continue
                ref = n.spec.ref(p) if n.spec else None
                if source.spec is not None and (ref is None or None in ref.axes):
                    given = Array[given]
                if not compatible(given, wanted):
                    raise TypeError(f"{p!r} is {given} where {source.name} makes it and {wanted} where {n.name} takes it")

    # changing the flow

    def update_defaults(self, values: Mapping[str, Any]) -> None:
        """New defaults for inputs, wherever they are taken."""
        self._used(values, self.roots())
        for n in self.nodes:
            own = {k: v for k, v in values.items() if k in n.free}
            if own:
                n.update_defaults(own)
        self.validate()

    @staticmethod
    def _used(values: Mapping[str, Any], names: Iterable[str]) -> None:
        unknown = set(values) - set(names)
        if unknown:
            raise ValueError(f"nothing is called {sorted(unknown)}")

    def _names(self) -> set[str]:
        return {x for n in self.nodes for x in (*n.parameters, *n.out)}

    def update_renames(self, names: Mapping[str, str]) -> None:
        """Rename inputs and outputs everywhere."""
        self._used(names, self._names())
        for n in self.nodes:
            own = {k: v for k, v in names.items() if k in (*n.parameters, *n.out)}
            if own:
                n.update_renames(own)
        self.validate()

    def update_scope(self, scope: str | None, inputs: Any = None, outputs: Any = None, exclude: Iterable[str] = ()) -> None:
        """Put inputs and outputs under a scope."""
        made = set(self.makers())
        pick = lambda wanted, all_: set(all_) if wanted == "*" else set(wanted or ())
        chosen = (pick(inputs, self.roots()) | pick(outputs, made)) - set(exclude)
        if scope in self._names():
            raise ValueError(f"{scope!r} is a name already")
        bare = lambda n: n.split(".", 1)[-1]
        self.update_renames({n: f"{scope}.{bare(n)}" if scope else bare(n) for n in chosen})

    def rename_axes(self, names: Mapping[str, str]) -> None:
        """Rename axes everywhere."""
        self._used(names, {a for axes in self.axes().values() for a in axes if a})
        for n in self.nodes:
            n.update_axes(names)
        self.validate()

    def add_axis(self, *parameters: str, axis: str) -> None:
        """Index inputs by one more axis, last, and carry it through everything that follows from them.

        An axis that others have already zips with it; a new one makes a product. Consumers that
        took an array whole keep reducing its earlier axes.
        """
        before = self.axes()
        grown: set[str] = set()
        for p in parameters:
            if p in self.makers():
                raise ValueError(f"{p!r} is made by the flow; give an input")
            if p not in self.roots():
                raise ValueError(f"nothing takes {p!r}")
            if axis in before.get(p, ()):
                raise ValueError(f"{p!r} has the axis {axis!r} already")
            grown.add(p)
        for n in self.order():
            hit = [p for p in n.free if p in grown]
            if not hit:
                continue
            spec = n.spec
            refs = {r.name: r for r in spec.inputs} if spec else {}
            for p in hit:
                known = refs[p].axes if p in refs else (None,) * len(before.get(p, ()))
                refs[p] = ArrayRef(p, (*known, axis))
            old = spec.axes if spec else ()
            out = old if axis in old else (*old, axis)
            n.spec = IndexSpec(tuple(refs[p] for p in n.parameters if p in refs), tuple(ArrayRef(o, out) for o in n.out))
            if axis not in old:
                grown |= set(n.out)
        self.validate()

    # other flows

    def copy(self, **changes: Any) -> Flow:
        new = object.__new__(Flow)
        new.__dict__ = {**self.__dict__, **changes}
        new.nodes = [n.copy() for n in self.nodes]
        return new

    def join(self, *others: Flow | Node) -> Flow:
        """The nodes of several flows together."""
        return Flow([*self.nodes, *itertools.chain.from_iterable([o] if isinstance(o, Node) else o.nodes for o in others)], check_types=self.check_types, name=self.name)

    def split(self) -> list[Flow]:
        """A flow for each connected part; one part alone is an error."""
        parts = self.parts()
        if len(parts) < 2:
            raise ValueError("the flow is connected")
        return [Flow(p, check_types=self.check_types) for p in parts]

    def sub(self, inputs: Iterable[str] | None = None, outputs: Iterable[str] | None = None) -> Flow:
        """The nodes that outputs need, cut where inputs are given."""
        given = set(inputs or ())
        makers = self.makers()
        wanted = list(outputs) if outputs is not None else [o for n in self.leaves() for o in n.out]
        self._used(dict.fromkeys(given), self._names())
        keep: dict[int, Node] = {}
        stack = [o for o in wanted if o not in given]
        for o in stack:
            self.node(o)
        while stack:
            n = makers[stack.pop()]
            if id(n) not in keep:
                keep[id(n)] = n
                stack += [p for p in n.free if p in makers and p not in given]
        new = Flow([n for n in self.nodes if id(n) in keep], check_types=self.check_types, name=self.name)
        if inputs is not None:
            missing = set(new.roots()) - given - set(new.defaults())
            if missing:
                raise ValueError(f"{sorted(missing)} are needed too")
        return new

    def nest(self, outs: Iterable[str] | str, out: str | Iterable[str] | None = None) -> Node:
        """Fuse nodes, in place; ``"*"`` means all."""
        from axisloom.functions.node import nest

        chosen = list(self.nodes) if outs == "*" else list({id(self.node(o)): self.node(o) for o in outs}.values())
        if out is None:
            outside = {p for n in self.nodes if n not in chosen for p in n.free}
            made = [o for n in chosen for o in n.out]
            inner = {p for n in chosen for p in n.free}
            out = tuple(o for o in made if o in outside or o not in inner)
        fused = nest(chosen, out)
        self.nodes = [n for n in self.nodes if n not in chosen]
        self.nodes.append(fused)
        self.validate()
        return fused

    def simplified(self) -> Flow:
        """Nodes with the same root inputs that feed one another fused, where none has a spec."""
        new = self.copy()
        changed = True
        while changed:
            changed = False
            for n in new.order():
                takers = [m for m in new.nodes if set(n.out) & set(m.free)]
                if n.spec or len(takers) != 1 or takers[0].spec or n.kind != takers[0].kind:
                    continue
                m = takers[0]
                if new.roots(n.out[0]) == new.roots(m.out[0]):
                    new.nest([n.out[0], m.out[0]], m.out)
                    changed = True
                    break
        return new

    # scalars

    def evaluate(self, outs: Iterable[str], values: Mapping[str, Any]) -> dict[str, Any]:
        """Outputs from plain values (or Columns), each node at most once; given intermediates cut the flow."""
        makers, found, used = self.makers(), dict(values), set()

        def get(name: str, n: Node) -> Any:
            if name not in found:
                if name in makers:
                    call(makers[name])
                elif name in n.defaults:
                    return n.defaults[name]
                else:
                    raise ValueError(f"{name!r} is missing; {n.name} takes it")
            if name in values:
                used.add(name)
            return found[name]

        def call(n: Node) -> None:
            args = {p: get(p, n) for p in n.free}
            result = n(**args)
            for o in n.out:
                found.setdefault(o, n.pick(result, o))

        for o in outs:
            if o not in found:
                call(self.node(o))
        self._last_used = used
        return found

    def run(self, out: str | Iterable[str] | None = None, *, full: bool = False, allow_unused: bool = False, **values: Any) -> Any:
        """Evaluate outputs, by default the leaves, from plain values."""
        values = {f"{k}.{i}" if isinstance(v, dict) and self._is_scope(k) else k: x for k, v in values.items() for i, x in (v.items() if isinstance(v, dict) and self._is_scope(k) else [(None, v)])}
        outs = [o for n in self.leaves() for o in n.out] if out is None else [out] if isinstance(out, str) else list(out)
        for o in outs:
            if o in self.makers() and any(self.node(x).spec for x in (o, *self.upstream(o))):
                raise RuntimeError(f"{o!r} depends on indexed arrays; map the flow instead")
        found = self.evaluate(outs, values)
        unused = set(values) - self._last_used - set(outs)
        if unused and not allow_unused:
            raise UnusedInputs(f"nothing took {sorted(unused)}")
        if full:
            return found
        return found[outs[0]] if isinstance(out, str) or len(outs) == 1 else tuple(found[o] for o in outs)

    def _is_scope(self, name: str) -> bool:
        return any(x.startswith(f"{name}.") for x in self._names())

    def __call__(self, out: str | None = None, **values: Any) -> Any:
        return self.run(out, **values)

    def function(self, out: str | Iterable[str]) -> Any:
        """A plain function of the root inputs of an output."""

        def call(**values: Any) -> Any:
            return self.run(out, **values)

        call.roots = self.roots(out) if isinstance(out, str) else self.roots()
        call.full = lambda **values: self.run(out, full=True, **values)
        return call

    # arrays

    def map(self, spark: Any, inputs: Mapping[str, Any], **options: Any) -> Any:
        """Evaluate over arrays in Spark; see :func:`axisloom.plans.run.run_map`."""
        from axisloom.plans.run import run_map

        return run_map(self, spark, inputs, **options)

    def input_schema(self) -> dict[str, str]:
        """Spark types of the inputs by their annotations, nested in arrays once for each axis; others are left out."""
        plain = {int: "bigint", float: "double", str: "string", bool: "boolean", bytes: "binary"}
        axes, out = self.axes(), {}
        for name, hint in self.input_hints().items():
            if hint in plain:
                out[name] = plain[hint]
                for _ in axes.get(name, ()):
                    out[name] = f"array<{out[name]}>"
        return out

    # telling

    def info(self) -> dict[str, tuple[str, ...]]:
        """Inputs, outputs, and which inputs are required."""
        roots, optional = self.roots(), set(self.defaults())
        return {
            "inputs": tuple(roots),
            "outputs": tuple(sorted(self.makers())),
            "intermediate_outputs": tuple(sorted(set(self.makers()) - {o for n in self.leaves() for o in n.out})),
            "required_inputs": tuple(r for r in roots if r not in optional),
            "optional_inputs": tuple(r for r in roots if r in optional),
        }

    def describe(self) -> str:
        """The nodes in order, with specs, defaults and first lines of their documentation."""
        lines = [self.name or "flow", *([self.description] if self.description else [])]
        for n in self.order():
            doc = (getattr(n.body, "__doc__", None) or "").strip().split("\n")[0]
            shown = ", ".join(f"{p}={n.defaults[p]!r}" if p in n.defaults else p for p in n.free)
            lines.append(f"  {', '.join(n.out)} = {n.name}({shown})" + (f"  [{n.spec}]" if n.spec else "") + (f"  {doc}" if doc else ""))
        return "\n".join(lines)

    def documentation(self) -> list[dict[str, Any]]:
        """One entry for each input and output: its role, type, default, and the line about it in the documentation of a node."""
        found: dict[str, dict[str, Any]] = {}
        hints, defaults, makers = {**self.input_hints(), **self.output_hints()}, self.defaults(), self.makers()
        for n in self.order():
            text = (getattr(n.body, "__doc__", None) or "").strip()
            about = {m[1]: m[2] for m in re.finditer(r"^\s*(\w+)\s*(?:\([^)]*\))?\s*:\s*(\S.*)$", text, re.M)}
            for old, name in zip(n._originals, n.parameters, strict=True):
                if name not in makers and name not in n.bound:
                    entry = found.setdefault(name, {"name": name, "role": "input", "type": _type_name(hints.get(name)), "default": defaults.get(name), "text": ""})
                    entry["text"] = entry["text"] or about.get(old, "")
            for o in n.out:
                found[o] = {"name": o, "role": "output", "type": _type_name(hints.get(o)), "default": None, "text": text.split("\n")[0]}
        return list(found.values())

    def dot(self) -> str:
        """The graph in DOT."""
        lines = ["digraph flow {", "  rankdir=LR;"]
        makers = self.makers()
        lines += [f'  "{r}" [shape=box];' for r in self.roots()]
        for n in self.order():
            lines.append(f'  "{n.name}:{",".join(n.out)}" [shape=ellipse];')
            lines += [f'  "{makers[p].name + ":" + ",".join(makers[p].out) if p in makers else p}" -> "{n.name}:{",".join(n.out)}" [label="{p}"];' for p in n.free]
        return "\n".join([*lines, "}"])


class VariantFlow:
    """A flow some of whose outputs have several implementations, chosen by variant."""

    def __init__(self, nodes: Iterable[Node], default: str | Mapping[str | None, str] | None = None, **options: Any) -> None:
        self.nodes = [n.copy() for n in nodes]
        self.default, self.options = default, options
        if not any(n.variant for n in self.nodes):
            raise ValueError("no node has a variant; use Flow")

    def variants(self) -> dict[str | None, set[str]]:
        """Group to its variants."""
        out: dict[str | None, set[str]] = {}
        for n in self.nodes:
            for group, v in n.variant.items():
                out.setdefault(group, set()).add(v)
        return out

    def _choice(self, select: str | Mapping[str | None, str] | None) -> dict[str | None, str]:
        groups = self.variants()
        if select is None:
            return {}
        if isinstance(select, str):
            hits = [g for g, vs in groups.items() if select in vs]
            if len(hits) != 1:
                raise ValueError(f"{select!r} is a variant of {len(hits)} groups; name the group")
            return {hits[0]: select}
        for g, v in select.items():
            if v not in groups.get(g, set()):
                raise ValueError(f"group {g!r} has no variant {v!r}")
        return dict(select)

    def choose(self, select: str | Mapping[str | None, str] | None = None) -> Flow | VariantFlow:
        """The flow with these variants, on top of the default ones; still a variant flow while groups are open."""
        if select is None and self.default is None:
            raise ValueError("choose a variant, as there is no default")
        chosen = {**self._choice(self.default), **self._choice(select)}
        kept = [n for n in self.nodes if all(chosen.get(g, v) == v for g, v in n.variant.items())]
        left = [n for n in kept if any(g not in chosen for g in n.variant)]
        if left:
            return VariantFlow(kept, default=None, **self.options)
        return Flow([n.copy(variant={}) for n in kept], **self.options)

    @classmethod
    def merge(cls, flows: Mapping[str, Flow]) -> VariantFlow:
        """Flows as variants of one: nodes that all of them have alike stay common."""
        if len(flows) < 2:
            raise ValueError("merging takes two flows at least")
        alike = lambda a, b: (a.body, a.out, a.parameters, a.defaults, a.bound, str(a.spec), a.kind) == (b.body, b.out, b.parameters, b.defaults, b.bound, str(b.spec), b.kind)
        first = next(iter(flows.values()))
        common = [n for n in first.nodes if all(any(alike(n, m) for m in f.nodes) for f in flows.values())]
        own = [m.copy(variant={None: name}) for name, f in flows.items() for m in f.nodes if not any(alike(m, c) for c in common)]
        return cls([*common, *own])
