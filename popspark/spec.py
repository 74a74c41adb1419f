"""Declarative simulations: frozen blocks with defaults, strict keys, cross-checks and a fingerprint."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import MISSING, asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from .contracts import predictors, propagators

FORMATS = ("json", "markdown", "html")


class SpecError(ValueError):
    """A spec that cannot be run; the message begins with the place."""


def _need(holds: bool, place: str, message: str) -> None:
    if not holds:
        raise SpecError(f"{place}: {message}")


def _unique(values) -> bool:
    return len(set(values)) == len(values)


@dataclass(frozen=True)
class Population:
    source: str = "marginals"
    targets: str = "targets.json"
    microdata: str | None = None
    size: int = 20_000
    attributes: tuple[str, ...] = ("age_band", "sex", "education", "race", "marital")
    traits: tuple[str, ...] = ()

    def check(self, place: str) -> None:
        _need(self.source in ("marginals", "fixture"), place, "source is marginals or fixture")
        _need(self.size >= 1, place, "size is at least 1")
        _need(bool(self.attributes) and _unique(self.attributes), place, "attributes are unique, one at least")


@dataclass(frozen=True)
class Network:
    enabled: bool = False
    mean_degree: int = 8
    homophily: float = 0.7
    dimensions: tuple[str, ...] = ()

    def check(self, place: str) -> None:
        _need(0 <= self.homophily <= 1 and self.mean_degree >= 1, place, "homophily lies in 0 to 1, mean_degree is at least 1")


@dataclass(frozen=True)
class Dynamics:
    enabled: bool = False
    rounds: int = 3
    confidence: float = 0.25
    susceptibility: float = 0.2

    def check(self, place: str) -> None:
        _need(self.rounds >= 0 and 0 <= self.confidence <= 1 and 0 <= self.susceptibility <= 1, place, "rounds is not negative, the rest lies in 0 to 1")


@dataclass(frozen=True)
class World:
    network: Network = field(default_factory=Network)
    dynamics: Dynamics = field(default_factory=Dynamics)


@dataclass(frozen=True)
class Arm:
    id: str
    prompt: str


@dataclass(frozen=True)
class Scenario:
    question_id: str
    options: tuple[str, ...]
    prompt: str | None = None
    arms: tuple[Arm, ...] = ()
    context: str = ""

    def check(self, place: str) -> None:
        _need(len(self.options) >= 2 and _unique(self.options), place, "options are unique, two at least")
        _need(_unique([a.id for a in self.arms]), place, "arms have unique ids")
        _need(bool(self.prompt or self.arms), place, "a prompt or arms are required")

    def questions(self) -> dict[str, str]:
        """Arm id -> text; without arms the prompt is the arm 'default'."""
        return {a.id: a.prompt for a in self.arms} or {"default": self.prompt}


@dataclass(frozen=True)
class Provider:
    name: str = "stub"
    model: str = "stub"
    max_concurrency: int = 8
    max_tokens: int = 512
    effort: str = "low"
    cache_dir: str | None = None
    batch_size: int = 32

    def check(self, place: str) -> None:
        _need(min(self.max_concurrency, self.max_tokens, self.batch_size) >= 1, place, "max_concurrency, max_tokens and batch_size are at least 1")


@dataclass(frozen=True)
class Predictor:
    kind: str = "hybrid"
    archetypes: int = 300
    stratify_by: tuple[str, ...] = ("age_band", "education")
    propagator: str = "multinomial_logit"
    trait_noise: float = 0.05
    provider: Provider = field(default_factory=Provider)

    def check(self, place: str) -> None:
        _need(self.kind in predictors.names(), place, f"kind is one of {', '.join(predictors.names())}")
        _need(self.propagator in propagators.names(), place, f"propagator is one of {', '.join(propagators.names())}")
        _need(self.archetypes >= 1 and self.trait_noise >= 0, place, "archetypes is at least 1, trait_noise not negative")


@dataclass(frozen=True)
class Estimator:
    poststratify: bool = True
    dimensions: tuple[str, ...] = ("age_band", "education")
    mrp: bool = True
    draws: int = 2000
    level: float = 0.90

    def check(self, place: str) -> None:
        _need(self.draws >= 0 and 0 < self.level < 1, place, "draws is not negative, level lies between 0 and 1")


@dataclass(frozen=True)
class Limits:
    max_usd: float = 5.0
    max_calls: int = 5000


@dataclass(frozen=True)
class Output:
    dir: str = "artifacts"
    formats: tuple[str, ...] = FORMATS

    def check(self, place: str) -> None:
        _need(set(self.formats) <= set(FORMATS), place, f"formats are among {', '.join(FORMATS)}")


@dataclass(frozen=True)
class Spec:
    name: str
    scenario: Scenario
    seed: int = 0
    population: Population = field(default_factory=Population)
    world: World = field(default_factory=World)
    predictor: Predictor = field(default_factory=Predictor)
    estimator: Estimator = field(default_factory=Estimator)
    budget: Limits = field(default_factory=Limits)
    output: Output = field(default_factory=Output)

    def check(self, place: str) -> None:
        named = {"predictor.stratify_by": self.predictor.stratify_by, "estimator.dimensions": self.estimator.dimensions, "world.network.dimensions": self.world.network.dimensions}
        for where, dims in named.items():
            missing = sorted(set(dims) - set(self.population.attributes))
            _need(not missing, where, f"not among population.attributes: {', '.join(missing)}")

    def to_dict(self) -> dict[str, Any]:
        return json.loads(json.dumps(asdict(self)))

    def fingerprint(self) -> str:
        """The first 16 hex digits of the canonical JSON's SHA-256."""
        return hashlib.sha256(json.dumps(self.to_dict(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


_BLOCKS = {
    (Spec, "population"): Population, (Spec, "world"): World, (Spec, "scenario"): Scenario, (Spec, "predictor"): Predictor,
    (Spec, "estimator"): Estimator, (Spec, "budget"): Limits, (Spec, "output"): Output,
    (World, "network"): Network, (World, "dynamics"): Dynamics, (Predictor, "provider"): Provider,
}
_TYPES = {"int": int, "float": (int, float), "bool": bool, "str": str, "str | None": (str, type(None))}


def _build(cls, given: Any, place: str):
    _need(isinstance(given, Mapping), place or "spec", "is a mapping")
    known = {f.name: f for f in fields(cls)}
    unknown = sorted(set(given) - set(known))
    _need(not unknown, place or "spec", f"unknown keys: {', '.join(unknown)}")
    values = {}
    for name, f in known.items():
        at = f"{place}.{name}".lstrip(".")
        if name not in given:
            _need(f.default is not MISSING or f.default_factory is not MISSING, at, "is required")
            continue
        value = given[name]
        if (cls, name) in _BLOCKS:
            value = _build(_BLOCKS[cls, name], value, at)
        elif name == "arms":
            _need(isinstance(value, list | tuple), at, "is a list")
            value = tuple(_build(Arm, a, f"{at}.{i}") for i, a in enumerate(value))
        elif f.type.startswith("tuple"):
            _need(isinstance(value, list | tuple) and all(isinstance(x, str) for x in value), at, "is a list of strings")
            value = tuple(value)
        else:
            _need(isinstance(value, _TYPES[f.type]) and (f.type == "bool" or not isinstance(value, bool)), at, f"is {f.type}")
        values[name] = value
    made = cls(**values)
    if hasattr(made, "check"):
        made.check(place or "spec")
    return made


def from_dict(given: Mapping[str, Any]) -> Spec:
    return _build(Spec, given, "")


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise SpecError("YAML specs need PyYAML; JSON works without it") from e
    return yaml


def load(path: str | Path) -> Spec:
    text = Path(path).read_text(encoding="utf-8")
    return from_dict(json.loads(text) if str(path).endswith(".json") else _yaml().safe_load(text))


def dump(spec: Spec, path: str | Path) -> None:
    given = spec.to_dict()
    Path(path).write_text(json.dumps(given, indent=2) if str(path).endswith(".json") else _yaml().safe_dump(given, sort_keys=False), encoding="utf-8")


def merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """base with over on top; mappings are merged, anything else is replaced."""
    out = {k: merge(v, {}) if isinstance(v, Mapping) else v for k, v in base.items()}
    for k, v in over.items():
        out[k] = merge(out.get(k) if isinstance(out.get(k), Mapping) else {}, v) if isinstance(v, Mapping) else v
    return out


