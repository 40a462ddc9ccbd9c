"""Results as labelled dense arrays on the driver, for outputs that fit there."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np

from axisloom.operators.frame import AxisFrame
from axisloom.operators.table import coordinates
from axisloom.plans.spec import IndexSpec


@dataclass(frozen=True)
class Dataset:
    """Arrays by name, each with the axes it has; ``coords`` are the inputs that label axes."""

    coords: Mapping[str, tuple[tuple[str, ...], np.ndarray]]
    variables: Mapping[str, tuple[tuple[str, ...], np.ndarray]]

    @property
    def dims(self) -> dict[str, int]:
        """Sizes of all axes."""
        return {a: n for axes, x in (*self.coords.values(), *self.variables.values()) for a, n in zip(axes, x.shape, strict=True)}

    def select(self, name: str, **at: Any) -> Any:
        """A variable where coordinates, or axes without one, have these values."""
        axes, x = self.variables[name]
        index: list[Any] = [slice(None)] * len(axes)
        for label, value in at.items():
            if label in self.coords:
                (axis,), labels = self.coords[label]
                found = np.flatnonzero(labels == value)
                if not len(found):
                    raise KeyError(f"{label!r} is nowhere {value!r}")
                index[axes.index(axis)] = int(found[0])
            else:
                index[axes.index(label)] = value
        return x[tuple(index)]

    def to_xarray(self) -> Any:
        """The same as an ``xarray.Dataset``, where that package is installed."""
        import xarray

        return xarray.Dataset(dict(self.variables), {k: v for k, v in self.coords.items() if len(v[0]) == 1})


def dataset(frames: Mapping[str, AxisFrame], outputs: Iterable[str], specs: Iterable[IndexSpec] = ()) -> Dataset:
    """Outputs and the inputs that label them as dense arrays; missing cells are masked."""
    specs, outputs = list(specs), list(outputs)
    labels = dict.fromkeys(c for o in outputs for c in coordinates(specs, o) if c in frames and c not in outputs)
    arrays = {n: (frames[n].axes, np.ma.asanyarray(frames[n].to_numpy()) if frames[n].axes else np.array(frames[n].df.first()[0])) for n in (*labels, *outputs)}
    return Dataset({n: arrays[n] for n in labels}, {n: arrays[n] for n in outputs})
