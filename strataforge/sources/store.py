"""Results as JSON: generic codecs for the dataclasses, a file for a profile and its analysis."""

from __future__ import annotations

import dataclasses
import enum
import json
import types
import typing
from pathlib import Path

from strataforge import models
from strataforge.models import AnalysisResult, ProfileResult

VERSION = 1


def encode(x):
    if isinstance(x, enum.Enum):
        return x.value
    if dataclasses.is_dataclass(x):
        return {f.name: encode(getattr(x, f.name)) for f in dataclasses.fields(x)}
    if isinstance(x, dict):
        return {k: encode(v) for k, v in x.items()}
    return [encode(v) for v in x] if isinstance(x, (list, tuple)) else x


def decode(kind, x):
    """x, as json gives it, as the annotated type. Unknown fields are ignored; an empty optional tuple is None."""
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (types.UnionType, typing.Union):
        inner = next(a for a in args if a is not type(None))
        return None if x is None or x == [] and typing.get_origin(inner) is tuple else decode(inner, x)
    if origin is tuple:
        return tuple(decode(args[0], v) for v in x) if args[-1] is Ellipsis else tuple(decode(a, v) for a, v in zip(args, x))
    if origin is dict:
        return {k: decode(args[1], v) for k, v in x.items()}
    if origin is list:
        return [decode(args[0], v) for v in x]
    if dataclasses.is_dataclass(kind):
        hints = typing.get_type_hints(kind, vars(models))
        return kind(**{f.name: decode(hints[f.name], x[f.name]) for f in dataclasses.fields(kind) if f.name in x})
    return kind(x) if isinstance(kind, type) and issubclass(kind, enum.Enum) else x


def save_results(path: str, profile_result: ProfileResult | None = None, analysis_result: AnalysisResult | None = None) -> None:
    data = {"version": VERSION}
    for name, part in (("profile_result", profile_result), ("analysis_result", analysis_result)):
        if part is not None:
            data[name] = encode(part)
    file = Path(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(json.dumps(data, indent=2))


def load_results(path: str) -> tuple[ProfileResult | None, AnalysisResult | None]:
    data = json.loads(Path(path).read_text())
    part = lambda name, kind: decode(kind, data[name]) if data.get(name) is not None else None
    return part("profile_result", ProfileResult), part("analysis_result", AnalysisResult)
