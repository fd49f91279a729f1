"""Settings: fixed defaults from ``defaults.toml``, overridden by YAML files and the environment."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Iterable, Mapping
from functools import cache, cached_property
from importlib import resources
from typing import Any

from polargrain.functions.rings import Rings

UNKNOWN = 255


@cache
def defaults() -> dict[str, dict[str, Any]]:
    return tomllib.loads(resources.files(__package__).joinpath("defaults.toml").read_text())


def _like(default: Any, value: Any) -> Any:
    """``value`` in the type of its default; texts come from the environment."""
    if isinstance(default, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    if isinstance(default, list):
        return tuple(float(v) for v in (value.split(",") if isinstance(value, str) else value))
    return type(default)(value)


class Settings:
    """Read-only values of one section, by name."""

    section = ""

    def __init__(self, **given: Any):
        known = defaults()[self.section]
        if unknown := given.keys() - known.keys():
            raise TypeError(f"no setting {sorted(unknown)} in {self.section}")
        self.__dict__.update({name: _like(default, given.get(name, default)) for name, default in known.items()})

    def __setattr__(self, name: str, value: Any) -> None:
        raise AttributeError(f"{self.section} settings are read-only")

    @classmethod
    def resolved(cls, sources: Iterable[Mapping[str, Any]]) -> Settings:
        """From several sources, of which the first that has a name wins."""
        chosen: dict[str, Any] = {}
        for source in sources:
            for name in defaults()[cls.section]:
                if source.get(name) is not None:
                    chosen.setdefault(name, source[name])
        return cls(**chosen)


class GridParams(Settings):
    section = "grid"

    @cached_property
    def rings(self) -> Rings:
        return Rings.fitted(self.r_min, self.r_max, self.dr_0, self.r_transition, self.alpha)

    @cached_property
    def edges(self) -> list[float]:
        return self.rings.borders()

    @cached_property
    def widths(self) -> list[float]:
        return [b - a for a, b in zip(self.edges, self.edges[1:], strict=False)]

    phase1_rings = property(lambda self: self.rings.even)
    phase2_rings = property(lambda self: self.rings.grown)
    n_rings = property(lambda self: len(self.rings))
    n_cells = property(lambda self: len(self.rings) * self.n_theta)

    @property
    def bytes_per_cell(self) -> int:
        """Two heights, a counter a class, the class, two more floats and a long."""
        return 2 * 4 + self.n_classes * 4 + 1 + 4 + 4 + 8


class TravParams(Settings):
    section = "traversability"


class MemoryParams(Settings):
    section = "memory"


class ProjectionParams(Settings):
    section = "projection"


class GroundParams(Settings):
    section = "ground"


class StreamParams(Settings):
    section = "stream"


class EngineConfig:
    """All sections as attributes of their names."""

    def __init__(self, **sections: Settings):
        for kind in Settings.__subclasses__():
            setattr(self, kind.section, sections.get(kind.section) or kind())


def merged(base: Mapping[str, Any], *updates: Mapping[str, Any]) -> dict[str, Any]:
    """Shallow merge, later values win."""
    out = dict(base)
    for u in updates:
        out.update(u)
    return out


def load_config(*yaml_paths: str, env: Mapping[str, str] | None = None, prefix: str = "POLARGRAIN") -> EngineConfig:
    """Defaults, then the files in order, then variables such as ``POLARGRAIN_GRID_R_MAX``.

    A file whose ``grid`` section lacks ``r_transition`` gets a uniform grid up to ``r_max``.
    """
    env, files = os.environ if env is None else env, {}
    for path in yaml_paths:
        import yaml

        with open(path) as f:
            read = yaml.safe_load(f) or {}
        files = {name: merged(files.get(name, {}), read[name]) if isinstance(read.get(name), dict) else files.get(name, {}) for name in files.keys() | read.keys()}
    if files.get("grid"):
        files["grid"].setdefault("r_transition", files["grid"].get("r_max", defaults()["grid"]["r_max"]))
    sections = {}
    for kind in Settings.__subclasses__():
        start = f"{prefix}_{kind.section}_".upper()
        named = {k[len(start) :].lower(): v for k, v in env.items() if k.startswith(start)}
        sections[kind.section] = kind.resolved((named, files.get(kind.section, {})))
    return EngineConfig(**sections)
