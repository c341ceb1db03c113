"""Parameters: JSON with comments, nested dictionaries, defaults and units of time."""

from __future__ import annotations

import copy
import inspect
import json
from collections.abc import Callable
from pathlib import Path

DEFAULTS = Path(__file__).parent / "params"


def strip_comments(text: str) -> str:
    """text without // and /* */ comments; string literals are left alone."""
    out, k, inside = [], 0, False
    while k < len(text):
        two = text[k : k + 2]
        if inside:
            out.append(text[k])
            if text[k] == "\\" and k + 1 < len(text):
                out.append(text[k + 1])
                k += 1
            inside = text[k] != '"' or out[-2:-1] == ["\\"]
        elif two == "//":
            k = text.find("\n", k)
            if k < 0:
                break
            continue
        elif two == "/*":
            end = text.find("*/", k + 2)
            if end < 0:
                break
            k = end + 1
        else:
            out.append(text[k])
            inside = text[k] == '"'
        k += 1
    return "".join(out)


def loads(text: str, folder: str | None = None) -> dict:
    """Parameters of a text; $PARAMS_FOLDER in it stands for folder."""
    if folder is not None:
        text = text.replace("$PARAMS_FOLDER", str(folder).replace("\\", "\\\\"))
    return json.loads(strip_comments(text))


def load(path: str, folder: str | None = None) -> dict:
    """Parameters of a file; folder is by default the one it lies in."""
    return loads(Path(path).read_text(), str(folder if folder is not None else Path(path).resolve().parent))


def load_default(name: str, folder: str) -> dict:
    """One of the bundled parameter sets, by its name with or without params_ and .json."""
    name = name.removesuffix(".json").removeprefix("params_")
    path = DEFAULTS / f"params_{name}.json"
    if not path.exists():
        raise ValueError(f"no bundled parameters {name!r}: one of {', '.join(sorted(p.stem.removeprefix('params_') for p in DEFAULTS.glob('*.json')))}")
    return load(str(path), folder)


def flatten(nested: dict, sep: str = ":") -> dict:
    """One level with joined keys; empty dictionaries stay values."""
    out: dict = {}
    for key, value in nested.items():
        if isinstance(value, dict) and value:
            out |= {f"{key}{sep}{k}": v for k, v in flatten(value, sep).items()}
        else:
            out[key] = value
    return out


def unflatten(flat: dict, sep: str = ":") -> dict:
    out: dict = {}
    for key, value in flat.items():
        *path, last = str(key).split(sep)
        at = out
        for p in path:
            at = at.setdefault(p, {})
        at[last] = value
    return out


def merged(first: dict, second: dict) -> dict:
    """Both, first winning; dictionaries in both are merged likewise.  Keys of first come first."""
    out = copy.deepcopy(first)
    for key, value in second.items():
        if key not in out:
            out[key] = copy.deepcopy(value)
        elif isinstance(out[key], dict) and isinstance(value, dict):
            out[key] = merged(out[key], value)
    return out


def accepted(function: Callable, options: dict) -> dict:
    """The options that a function takes by name."""
    names = inspect.signature(function).parameters
    return {k: v for k, v in options.items() if k in names}


def fan_out(steps: dict) -> dict:
    """Steps in which each category key of several names joined by ; became one key for each, with its own copy."""
    out: dict = {}
    for step, categories in steps.items():
        if not isinstance(categories, dict):
            raise TypeError(f"step {step!r} needs a dictionary of categories")
        out[step] = {}
        for names, params in categories.items():
            if not isinstance(params, dict):
                raise TypeError(f"category {names!r} of step {step!r} needs a dictionary of parameters")
            for name in names.split(";"):
                out[step][name.strip()] = copy.deepcopy(params)
    return out


def elapsed(seconds: float) -> str:
    """A duration as text: the units that matter at its size."""
    if seconds < 1:
        return f"{seconds * 1e3:.0f}ms"
    if seconds < 60:
        whole = int(seconds)
        return f"{whole}s {(seconds - whole) * 1e3:.0f}ms"
    whole, parts = int(seconds), []
    for name, size in (("d", 86400), ("h", 3600), ("m", 60), ("s", 1)):
        if parts or whole >= size:
            parts.append(f"{whole // size}{name}")
        whole %= size
    return " ".join(parts)
