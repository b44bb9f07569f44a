"""Settings as nested dataclasses: YAML or dotted overrides, typed, unknown names refused."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


@dataclass
class Data:
    daily_days: int = 60
    minute_days: int = 20
    min_valid_fraction: float = 0.5
    universe_size: int = 1500
    universe_lookback: int = 20
    price_zscore: str = "joint"


@dataclass
class Signature:
    depth: int = 5
    stages: list = field(default_factory=lambda: [["coordinate_projection", {"size": 2}], "time", "basepoint"])
    window: str = "global"
    rescale: str = "post"
    transform: str = "logsignature"


@dataclass
class Labels:
    horizon: int = 20
    clip: float = 3.0
    precomputed_column: str = ""


@dataclass
class Training:
    lookback_years: int = 4
    validation_years: int = 1
    day_stride: int = 1
    epochs: int = 8
    patience: int = 3
    rate: float = 0.01
    hidden: int = 128
    heads: int = 4
    seed: int = 42


@dataclass
class Config:
    data: Data = field(default_factory=Data)
    signature: Signature = field(default_factory=Signature)
    labels: Labels = field(default_factory=Labels)
    training: Training = field(default_factory=Training)


def _typed(old: Any, new: Any, name: str) -> Any:
    if isinstance(old, bool):
        if isinstance(new, str):
            new = {"true": True, "false": False}.get(new.lower(), new)
        if not isinstance(new, bool):
            raise ValueError(f"{name} is true or false, not {new!r}")
        return new
    if isinstance(old, (int, float)):
        return type(old)(new)
    return new


def update(config: Any, values: dict, at: str = "") -> Any:
    known = {f.name for f in fields(config)}
    for k, v in values.items():
        name = f"{at}{k}"
        if k not in known:
            raise ValueError(f"unknown setting {name}; there are {sorted(known)}")
        old = getattr(config, k)
        if is_dataclass(old):
            update(old, v, f"{name}.")
        else:
            setattr(config, k, _typed(old, v, name))
    return config


def load(path: str | None = None, overrides: tuple[str, ...] = ()) -> Config:
    """Defaults, then a YAML file, then `section.name=value` overrides."""
    import yaml

    config = Config()
    if path:
        with open(path) as f:
            update(config, yaml.safe_load(f) or {})
    for o in overrides:
        name, eq, value = o.partition("=")
        if not eq:
            raise ValueError(f"an override is name=value, not {o!r}")
        nested: Any = yaml.safe_load(value)
        for part in reversed(name.split(".")):
            nested = {part: nested}
        update(config, nested)
    return config
