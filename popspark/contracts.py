"""What a simulation is made of, as contracts, and the names under which specs find parts of a user's own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING, Protocol

from pyspark.sql import DataFrame, SparkSession

if TYPE_CHECKING:
    from .plans.predict import Question
    from .plans.simulate import Result
    from .sources.targets import Targets
    from .spec import Spec


class Synthesizer(Protocol):
    def __call__(self, spark: SparkSession, spec: Spec, targets: Targets, microdata: DataFrame | None) -> DataFrame:
        """agent_id, attributes, trait_*, weight."""


class Predictor(Protocol):
    def __call__(self, population: DataFrame, questions: Sequence[Question], spec: Spec, k: int) -> DataFrame:
        """question_id, agent_id, weight, p (k shares; null: no usable answer) for every agent and question; all have k options."""


class Propagator(Protocol):
    def __call__(self, population: DataFrame, sample: DataFrame, spec: Spec, levels: Mapping[str, Sequence[str]], k: int) -> DataFrame:
        """The population with p, from a sample of it with p: one question."""


class World(Protocol):
    def __call__(self, population: DataFrame, spec: Spec, k: int) -> DataFrame:
        """The population with p (agent_id, weight, p and more) after whatever moves it; the input is not changed."""


class Estimator(Protocol):
    def __call__(self, responses: DataFrame, spec: Spec, k: int) -> DataFrame:
        """question_id, option_ix, share of responses: question_id, agent_id, weight, p."""


class Scorer(Protocol):
    def __call__(self, rows: DataFrame) -> DataFrame:
        """Scores of rows of the grid: engine, question_id, option_ix, p, t, se."""


class Publisher(Protocol):
    def __call__(self, result: Result) -> str:
        """A report."""


@dataclass(frozen=True)
class Parts:
    """Parts that take the built-in ones' place in one run."""

    synthesizer: Synthesizer | None = None
    world: World | None = None
    estimator: Estimator | None = None


class Registry(dict):
    """name -> part of a user's own; built-in names and names in use are refused."""

    def __init__(self, built_in: Sequence[str]):
        super().__init__()
        self.built_in = tuple(built_in)

    def add(self, name: str, part) -> None:
        if name in self or name in self.built_in:
            raise ValueError(f"{name} is taken")
        self[name] = part

    def names(self) -> tuple[str, ...]:
        return (*self.built_in, *sorted(self))


#: Found by predictor.kind and predictor.propagator of a spec.
predictors = Registry(("hybrid", "llm", "classical", "prior", "uniform"))
propagators = Registry(("multinomial_logit", "cell_mean", "mean"))
