"""Pipeline configurations: YAML or dicts of components, checked, and the variables that a detector is to watch."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field, replace
from typing import Any

import yaml

from cinderlog.operators.templates import Templates

ANY_EVENT = "*"
_POSITION = re.compile(r"^var_(\d+)$")


class ConfigError(ValueError):
    """A configuration that can't be used."""


class TypeNotFound(ConfigError):
    pass


class MethodNotFound(ConfigError):
    pass


class MethodTypeMismatch(ConfigError):
    pass


@dataclass(frozen=True)
class Watched:
    """One variable: a position among a template's variables, or a header field; `name` is what alerts call it."""

    event: str  # an EventID, or ANY_EVENT
    instance: str
    name: str
    position: int | None = None
    params: tuple = ()

    @property
    def header(self) -> bool:
        return self.position is None


@dataclass
class Component:
    kind: str
    name: str
    method_type: str
    auto_config: bool = False
    params: dict[str, Any] = field(default_factory=dict)
    watched: list[Watched] = field(default_factory=list)
    persist: dict[str, Any] | None = None


def load(source: str | dict) -> dict:
    """A configuration from a YAML file or text, or a dict as it is."""
    if isinstance(source, dict):
        return source
    if "\n" not in source and source.endswith((".yaml", ".yml")):
        with open(source, encoding="utf-8") as f:
            return yaml.safe_load(f) or {}
    return yaml.safe_load(source) or {}


def component(config: dict, kind: str, name: str, method_type: str | None = None, allowed: set[str] | None = None, templates: Templates | None = None) -> Component:
    """The component `name` under `kind`; parameters may stand under `params` or beside it.

    allowed: names of parameters, any other being an error. templates: resolve named events and wildcards.
    """
    if kind not in config:
        raise TypeNotFound(kind)
    if name not in config[kind]:
        raise MethodNotFound(f"{kind}: {name}")
    given = dict(config[kind][name])
    found = given.pop("method_type", None)
    if method_type is not None and found != method_type:
        raise MethodTypeMismatch(f"{name}: {found} where {method_type} is needed")
    auto, params = bool(given.pop("auto_config", False)), given.pop("params", None)
    events, anywhere, persist = given.pop("events", None), given.pop("global", None), given.pop("persist", None)
    if params is None and events is None and anywhere is None and persist is None and not auto:
        warnings.warn(f"{name}: neither auto_config nor params, events, global or persist", stacklevel=2)
    if auto and params is not None:
        warnings.warn(f"{name}: auto_config overwrites events and params", stacklevel=2)
    given |= params or {}
    if allowed is not None and (odd := set(given) - allowed):
        raise ConfigError(f"{name}: unknown parameters {sorted(odd)}")
    watched = []
    for event, instances in (events or {}).items():
        number = templates.event(event) if templates else event
        for instance, data in instances.items():
            watched += _instance(str(number), instance, data, templates, number)
    for instance, data in (anywhere or {}).items():
        watched += [w for w in _instance(ANY_EVENT, instance, data, None, None) if w.header]
    return Component(kind, name, found or "", auto, given, watched, persist)


def _instance(event: str, instance: str, data: dict, templates: Templates | None, number: Any) -> list[Watched]:
    out = []
    for v in (data or {}).get("variables") or ():
        position = templates.position(number, v["pos"]) if templates else int(v["pos"])
        out.append(Watched(event, instance, v.get("name") or f"var_{position}", position, tuple(sorted((v.get("params") or {}).items()))))
    for h in (data or {}).get("header_variables") or ():
        out.append(Watched(event, instance, h["pos"], None, tuple(sorted((h.get("params") or {}).items()))))
    return out


def watched_variables(names: list[str], event: str | int = ANY_EVENT, instance: str = "instance") -> list[Watched]:
    """Watched variables by name: var_0, var_1 and so on are positions, all others header fields."""
    out = []
    for name in names:
        m = _POSITION.match(name)
        out.append(Watched(str(event), instance, name, int(m[1]) if m else None))
    return out


def to_dict(c: Component) -> dict:
    """The configuration that gives this component again."""
    events: dict[Any, dict[str, dict]] = {}
    anywhere: dict[str, dict] = {}
    for w in c.watched:
        key = int(w.event) if re.fullmatch(r"-?\d+", w.event) else w.event
        into = anywhere.setdefault(w.instance, {"params": {}}) if w.event == ANY_EVENT else events.setdefault(key, {}).setdefault(w.instance, {"params": {}})
        entry: dict[str, Any] = {"pos": w.name} if w.header else {"pos": w.position, "name": w.name}
        if w.params:
            entry["params"] = dict(w.params)
        into.setdefault("header_variables" if w.header else "variables", []).append(entry)
    out: dict[str, Any] = {"method_type": c.method_type, "auto_config": c.auto_config, "params": c.params}
    if events:
        out["events"] = events
    if anywhere:
        out["global"] = anywhere
    if c.persist is not None:
        out["persist"] = c.persist
    return {c.kind: {c.name: out}}


def dump(c: Component) -> str:
    return yaml.safe_dump(to_dict(c), sort_keys=False)


def configured(c: Component, watched: list[Watched]) -> Component:
    """c after auto-configuration: what it watches is new, all else stays."""
    return replace(c, auto_config=False, watched=watched)
