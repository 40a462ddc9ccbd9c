"""Run folders: versions of a manifest, and for each output batches of cells, each a table of its own.

A batch counts from the moment a manifest names it, and a new manifest stands beside the old one before
that goes. So a run that dies at any point leaves what the last manifest tells, and nothing is read twice.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisloom.functions.node import Node
from axisloom.operators.frame import AxisFrame, space
from axisloom.plans.spec import UNKNOWN, IndexSpec

MANIFEST = "manifest"
VERSION = 2


#: Storage kinds: how a frame is written to a folder and read back with its schema.
STORAGES: dict[str, tuple[Callable[[DataFrame, str, str], None], Callable[[SparkSession, str, str], DataFrame]]] = {}


def register_storage(kind: str, write: Callable[[DataFrame, str, str], None], read: Callable[[SparkSession, str, str], DataFrame]) -> None:
    """Add or replace a storage kind: ``write(df, path, mode)`` and ``read(spark, path, schema)``."""
    STORAGES[kind] = write, read


def storage(kind: str) -> tuple:
    """The functions of a storage kind."""
    if kind not in STORAGES:
        raise ValueError(f"there is no storage {kind!r}; there are {sorted(STORAGES)}")
    return STORAGES[kind]


for _format in ("parquet", "orc"):
    register_storage(_format, lambda df, path, mode, f=_format: df.write.format(f).mode(mode).save(path), lambda spark, path, schema, f=_format: spark.read.format(f).schema(schema).load(path))


class ResumeError(ValueError):
    """A run folder holds another run than the one that would resume it."""


def fingerprint(value: Any) -> str | None:
    """A digest of an input, or None where there is none."""
    if isinstance(value, (AxisFrame, DataFrame)):
        return None
    try:
        plain = value.tolist() if hasattr(value, "tolist") else list(value) if isinstance(value, range) else value
        return hashlib.sha256(json.dumps([type(value).__name__, plain], sort_keys=True).encode()).hexdigest()
    except (TypeError, ValueError):
        return None


def body_digest(n: Node) -> str:
    """A digest of a node's code."""
    try:
        text = n.body if isinstance(n.body, str) else inspect.getsource(n.body)
    except (OSError, TypeError):
        text = repr(getattr(getattr(n.body, "__code__", None), "co_code", n.name))
    return hashlib.sha256(text.encode()).hexdigest()


class RunFolder:
    """A folder that Spark reaches, on whatever file system."""

    def __init__(self, spark: SparkSession, path: str, kinds: str | Mapping[str, str] = "parquet") -> None:
        """``kinds`` names the storage of all outputs, or of each, with ``""`` for the others."""
        self.spark, self.path = spark, path.rstrip("/")
        self.kinds = {"": kinds} if isinstance(kinds, str) else {"": "parquet", **kinds}
        for kind in self.kinds.values():
            storage(kind)
        self.manifest: dict[str, Any] = {}

    # files through Hadoop, so that any store works

    def _fs(self, path: str) -> tuple[Any, Any]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _read_text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def _list(self, path: str) -> list[str]:
        """Names in a folder; none where it isn't there."""
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _write_text(self, path: str, text: str) -> None:
        """Write a new file whole: under another name first, then renamed."""
        fs, p = self._fs(path)
        _, part = self._fs(f"{path}.part")
        stream = fs.create(part, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        if not fs.rename(part, p):
            raise OSError(f"can't write {path}")

    # the manifest

    def load(self) -> dict[str, Any]:
        """The manifest as it stands."""
        found = self._versions()
        if not found:
            raise FileNotFoundError(f"{self.path} holds no run")
        self.manifest = json.loads(self._read_text(f"{self.path}/{MANIFEST}-{found[-1]}.json"))
        return self.manifest

    def _versions(self) -> list[int]:
        return sorted(int(m[1]) for name in self._list(self.path) if (m := re.fullmatch(rf"{MANIFEST}-(\d+)\.json", name)))

    def is_run(self) -> bool:
        """Whether the folder holds a run."""
        return bool(self._versions())

    def _save(self) -> None:
        self.manifest["updated"] = time.time()
        old = self._versions()
        self._write_text(f"{self.path}/{MANIFEST}-{old[-1] + 1 if old else 1}.json", json.dumps(self.manifest, indent=1))
        for k in old:
            self._delete(f"{self.path}/{MANIFEST}-{k}.json")

    def open(self, flow: Any, inputs: Mapping[str, Any], *, errors: str, resume: bool, validation: str) -> None:
        """Begin a run, or resume one that matches.

        Without ``resume`` an earlier run in the folder goes. A folder with anything else in it is refused and left as it is.
        """
        if validation not in ("auto", "strict", "skip"):
            raise ValueError(f"validation can't be {validation!r}")
        shapes: dict[str, Any] = {}
        try:
            shapes = {k: list(v) for k, v in flow.shapes({k: v for k, v in inputs.items() if not isinstance(v, (AxisFrame, DataFrame))}).items()}
        except (TypeError, ValueError):
            shapes = {}
        new = {
            "version": VERSION,
            "errors": errors,
            "specs": [str(s) for s in flow.specs()],
            "shapes": shapes,
            "inputs": {k: fingerprint(v) for k, v in inputs.items()},
            "bodies": {",".join(n.out): body_digest(n) for n in flow.order()},
            "outputs": {},
        }
        if not self.is_run():
            if self._list(self.path):
                raise ResumeError(f"{self.path} holds files, but no run")
            self.manifest = new | {"created": time.time()}
            self._save()
            return
        if not resume:
            self._delete(self.path)
            self.manifest = new | {"created": time.time()}
            self._save()
            return
        old = self.load()
        for key in ("errors", "specs", "shapes"):
            if old[key] != new[key]:
                raise ResumeError(f"{key} were {old[key]}, now {new[key]}")
        if validation != "skip":
            for k in {*old["inputs"], *new["inputs"]}:
                a, b = old["inputs"].get(k), new["inputs"].get(k)
                if a is None or b is None:
                    if validation == "strict":
                        raise ResumeError(f"input {k!r} can't be compared")
                elif a != b:
                    raise ResumeError(f"input {k!r} differs")
            if validation == "strict" and old["bodies"] != new["bodies"]:
                raise ResumeError("the code of a node differs")
        self.manifest["inputs"] = new["inputs"]

    # tables

    def table(self, name: str) -> str:
        return f"{self.path}/outputs/{name}"

    def stored(self, name: str) -> AxisFrame | None:
        """An output as far as it was written. Of a cell that failed and was computed again, the newer one."""
        meta = self.manifest["outputs"].get(name)
        if meta is None:
            return None
        batches = [storage(meta["kind"])[1](self.spark, f"{self.table(name)}/{b}", meta["schema"]) for b in meta["batches"]]
        df = batches[-1]
        for older in reversed(batches[:-1]):
            if meta["error"]:
                failed = F.col(f"`{meta['error']}`").isNotNull()
                older = older.filter(~failed).unionByName(older.filter(failed).join(df.select(*meta["axes"]), meta["axes"], "left_anti"))
            df = older.unionByName(df)
        return AxisFrame(df, name, tuple(meta["axes"]), dict(meta["sizes"]), meta["sparse"], meta["error"])

    def there(self, name: str) -> DataFrame | None:
        """Indices of the cells of an output that were written and didn't fail."""
        f = self.stored(name)
        if f is None:
            return None
        good = f.df.filter(F.col(f"`{f.error}`").isNull()) if f.error else f.df
        return good.select(*[f"`{a}`" for a in f.axes])

    def only_missing(self, n: Node, args: dict[str, Any]) -> dict[str, Any]:
        """Inputs of a node without the cells for which all its outputs are there; cells that failed are computed again.

        Works where one input has all mapped axes; a node that reduces, creates axes or has no axes
        is computed anew unless everything is there.
        """
        found = [self.there(o) for o in n.out]
        if n.spec is None or n.spec.created or not n.spec.mapped or any(f is None for f in found):
            return args
        axes = list(n.spec.mapped)
        there = found[0].select(*axes)
        for f in found[1:]:
            there = there.join(f.select(*axes), axes, "left_semi")
        for r in n.spec.inputs:
            f = args.get(r.name)
            if isinstance(f, AxisFrame) and set(axes) <= set(r.places):
                own = f.rename_axes({a: b for a, b in zip(f.axes, r.axes, strict=True) if b and a != b})
                args = {**args, r.name: own.with_df(own.df.join(there, axes, "left_anti"), sparse=True)}
                return args
        return args

    def write(self, n: Node, made: dict[str, AxisFrame]) -> dict[str, AxisFrame]:
        """Write a node's outputs, those there before kept; returns frames that read them back."""
        out = {}
        for o, f in made.items():
            known = self.manifest["outputs"].get(o)
            more = known is not None and n.spec is not None and n.spec.mapped and not n.spec.created
            kind = known["kind"] if known else self.kinds.get(o, self.kinds[""])
            new = f.df.join(self.there(o), list(f.axes), "left_anti") if more else f.df
            self._add(o, new, f, kind, known["batches"] if more else [])
            if known and not more:
                self._forget(o, known["batches"])
            out[o] = self.stored(o)
        return out

    def _add(self, name: str, df: DataFrame, f: AxisFrame, kind: str, before: list[str]) -> None:
        """Write a batch, then name it in the manifest."""
        batch = f"batch-{len(before)}-{uuid.uuid4().hex}"
        storage(kind)[0](df, f"{self.table(name)}/{batch}", "errorifexists")
        self.manifest["outputs"][name] = {"kind": kind, "axes": list(f.axes), "sizes": dict(f.sizes), "sparse": f.sparse, "error": f.error, "schema": _ddl(df), "batches": [*before, batch]}
        self._save()

    def _forget(self, name: str, batches: list[str]) -> None:
        for b in batches:
            self._delete(f"{self.table(name)}/{b}")

    # single cells

    def _at(self, name: str, key: tuple[int, ...]) -> DataFrame:
        f = self.outputs(name)
        if len(key) != len(f.axes):
            raise ValueError(f"{name!r} has the axes {f.axes}, not {len(key)} of them")
        return f.at(**dict(zip(f.axes, key, strict=True))).df

    def has(self, name: str, *key: int) -> bool:
        """Whether a cell was written and didn't fail."""
        f = self.outputs(name)
        found = self._at(name, key)
        return not (found.filter(F.col(f"`{f.error}`").isNull()) if f.error else found).isEmpty()

    def cell(self, name: str, *key: int) -> Any:
        """The value of a cell; an error where there is none. The filter reaches the scan."""
        row = self._at(name, key).select(f"`{name}`").first()
        if row is None:
            raise KeyError(f"{name!r} has no cell at {key}")
        return row[0]

    def put(self, name: str, values: DataFrame | Mapping[tuple[int, ...], Any]) -> None:
        """Add cells that aren't there yet, as one batch: a table of axes and value, or a few cells by index."""
        f = self.outputs(name)
        meta = self.manifest["outputs"][name]
        if not isinstance(values, DataFrame):
            values = self.spark.createDataFrame([(*k, v) for k, v in values.items()], ", ".join([*(f"`{a}` bigint" for a in f.axes), f"`{name}` {f.df.schema[name].dataType.simpleString()}"]))
        new = values.select(*[F.col(f"`{c}`").cast(f.df.schema[c].dataType) for c in (*f.axes, name)])
        if f.error:
            new = new.withColumn(f.error, F.lit(None).cast(f.df.schema[f.error].dataType))
        self._add(name, new.join(self.there(name), list(f.axes), "left_anti").select(*f.df.columns), f, meta["kind"], meta["batches"])

    def outputs(self, *names: str) -> Any:
        """Stored outputs: one name gives its frame, several a list, none a dict of all."""
        self.load()
        if not names:
            return {o: self.stored(o) for o in self.manifest["outputs"]}
        found = [self.stored(o) for o in names]
        if None in found:
            raise KeyError(f"not stored: {[o for o, f in zip(names, found, strict=True) if f is None]}")
        return found[0] if len(names) == 1 else found

    def write_input(self, f: AxisFrame) -> None:
        """Keep an input that was given as plain values, so that tables can be labelled with it."""
        f.df.write.mode("overwrite").parquet(f"{self.path}/inputs/{f.name}")  # the same values again where a run is resumed
        self.manifest.setdefault("arrays", {})[f.name] = {"axes": list(f.axes), "sizes": dict(f.sizes), "schema": _ddl(f.df)}
        self._save()

    def inputs(self) -> dict[str, AxisFrame]:
        """Inputs that were kept."""
        return {n: AxisFrame(self.spark.read.schema(m["schema"]).parquet(f"{self.path}/inputs/{n}"), n, tuple(m["axes"]), dict(m["sizes"])) for n, m in self.load().get("arrays", {}).items()}

    def to_table(self, *names: str) -> DataFrame:
        """Stored outputs, by default all, as one labelled table."""
        from axisloom.operators.table import assemble

        frames = {**self.inputs(), **self.outputs()}
        return assemble(frames, names or list(self.manifest["outputs"]), [IndexSpec.parse(t) for t in self.manifest["specs"]])

    def to_json(self, *names: str) -> dict[str, list[str]]:
        """Stored outputs as JSON rows, on the driver; meant for small ones."""
        found = self.outputs()
        return {n: [r[0] for r in found[n].df.selectExpr("to_json(struct(*))").collect()] for n in names or found}

    def missing(self, name: str) -> DataFrame:
        """Indices of an output's full space without a cell."""
        f = self.outputs(name)
        shape = self.manifest["shapes"].get(name)
        sizes = {a: int(n) if n != UNKNOWN else f.size(a) for a, n in zip(f.axes, shape or [UNKNOWN] * len(f.axes), strict=True)}
        return space(self.spark, sizes).join(f.df.select(*f.axes), list(f.axes), "left_anti")

    def status(self) -> DataFrame:
        """One row for each output of the run's specs: cells stored and failed, cells in all (null if not known), and a word for it."""
        self.load()
        rows = []
        for name, shape in self.manifest["shapes"].items():
            f = self.stored(name)
            total = None if UNKNOWN in shape else 1
            for n in shape if total else ():
                total *= n
            if name in self.manifest["inputs"]:
                continue
            counts = (0, 0) if f is None else tuple(f.df.agg(F.count("*"), F.count(f"`{f.error}`") if f.error else F.lit(0)).first())
            rows.append((name, counts[0] - counts[1], counts[1], total))
        df = self.spark.createDataFrame(rows, "output string, stored bigint, failed bigint, total bigint")
        word = F.when(F.col("stored") == 0, "missing").when(F.col("total").isNull() | (F.col("stored") >= F.col("total")), "complete").otherwise("incomplete")
        return df.withColumn("state", word)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def list_runs(spark: SparkSession, folder: str, most: int | None = None) -> list[dict[str, Any]]:
    """Manifests of the runs in a folder, the newest first."""
    top = RunFolder(spark, folder)
    fs, p = top._fs(folder)
    if not fs.exists(p):
        return []
    found = []
    for s in fs.listStatus(p):
        run = RunFolder(spark, s.getPath().toString())
        if run.is_run():
            found.append({"path": run.path, **run.load()})
    return sorted(found, key=lambda m: -m["updated"])[:most]


_SCRATCH: dict[str, str] = {}


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a run that nobody keeps: under ``spark.checkpoint.dir``, or a temporary one where the master is local."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        top = _SCRATCH.setdefault("top", "file://" + tempfile.mkdtemp(prefix="axisloom-"))
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
