"""The named steps of a pipeline."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from eventloom.config import merged
from eventloom.meta import Dataset


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[Dataset, dict], Dataset]
    defaults: dict
    multi: bool = False
    exports: bool = False
    #: Names that it takes beside those of its defaults; ``*`` for any.
    more: tuple[str, ...] = ()

    def params(self, given: dict) -> dict:
        """The given parameters over the defaults; those that the step doesn't know are warned of, as they have no effect."""
        for name in _unknown(given, self.defaults, (*self.more, "sortings")):
            warnings.warn(f"step {self.name!r}: unknown parameter {name!r}", stacklevel=3)
        return merged(given, self.defaults)


#: Parameters that are known where a default is optional.
OPTIONAL = {"bin_ms", "filter_band", "max_lag_ms", "max_distance_um", "require_multiple_sortings_match"}


def _unknown(given: dict, known: dict, more: tuple[str, ...]) -> list[str]:
    out = []
    for key, value in given.items():
        if key not in known:
            if "*" not in more and key not in more and key not in OPTIONAL:
                out.append(key)
        elif isinstance(value, dict) and isinstance(known[key], dict) and known[key]:
            out += [f"{key}:{x}" for x in _unknown(value, known[key], ())]
    return out


STEPS: dict[str, Step] = {}


def step(name: str, defaults: dict | None = None, multi: bool = False, exports: bool = False, more: tuple[str, ...] = ()) -> Callable:
    """Registers run(dataset, params) -> dataset.

    A step for single sortings gets the units of its category from all sortings at once (the sorting is a
    column); a ``multi`` step makes one sorting of many.
    """

    def put(run: Callable[[Dataset, dict], Dataset]) -> Callable[[Dataset, dict], Dataset]:
        if name in STEPS:
            raise ValueError(f"there are two steps {name!r}")
        STEPS[name] = Step(name, run, defaults or {}, multi, exports, more)
        return run

    return put


def find(key: str) -> Step:
    """The step of a pipeline key; a numeric suffix _N, which tells repeated steps apart, is left out."""
    from eventloom.modules import steps  # noqa: F401

    name = key if key in STEPS else re.sub(r"_\d+$", "", key)
    if name not in STEPS:
        raise ValueError(f"unknown step {key!r}: one of {', '.join(sorted(STEPS))}")
    return STEPS[name]
