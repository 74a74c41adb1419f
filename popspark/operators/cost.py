"""What calls cost: totals on DataFrames, and a budget that is checked before a call."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: share of the input price for cache reads and writes, share of all prices in batches, dollars for a
# million input and output tokens of the offline model; other models' prices are passed in
CACHE_READ, CACHE_WRITE, BATCH = 0.1, 1.25, 0.5
PRICES: Mapping[str, tuple[float, float]] = {"stub": (0.0, 0.0)}


class BudgetExceeded(RuntimeError):
    """Raised before the call that would go past a budget."""


def _sum(name: str):
    return F.coalesce(F.sum(name), F.lit(0)).alias(name)


def totals(calls: DataFrame) -> DataFrame:
    """calls (model, cached, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens): a row a model; cached answers are free."""
    live = calls.withColumn("live", ~F.col("cached"))
    tokens = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]
    paid = live.withColumns({c: F.when(F.col("live"), F.col(c)).otherwise(0) for c in tokens})
    return paid.groupBy("model").agg(F.count_if("live").alias("calls"), F.count_if("cached").alias("cached_calls"), *[_sum(c) for c in tokens])


def dollars(totals_: DataFrame, prices: Mapping[str, tuple[float, float]] = PRICES, batch: bool = False) -> DataFrame:
    """totals with usd; a model without a price costs nothing."""
    price_in = price_out = F.lit(0.0)
    for model, (a, b) in prices.items():
        price_in = F.when(F.col("model") == model, float(a)).otherwise(price_in)
        price_out = F.when(F.col("model") == model, float(b)).otherwise(price_out)
    inputs = F.col("input_tokens") + CACHE_READ * F.col("cache_read_tokens") + CACHE_WRITE * F.col("cache_write_tokens")
    return totals_.withColumn("usd", (inputs * price_in + F.col("output_tokens") * price_out) / 1e6 * (BATCH if batch else 1.0))


@dataclass
class Meter:
    """Running totals of one run on the driver."""

    calls: int = 0
    cached_calls: int = 0
    input_tokens: int = 0
    output_tokens: int = 0
    usd: float = 0.0

    def record(self, calls: DataFrame, prices: Mapping[str, tuple[float, float]] = PRICES, batch: bool = False) -> None:
        """Adds a batch of calls; one aggregation, a row a model."""
        for r in dollars(totals(calls), prices, batch).collect():
            self.calls += r["calls"]
            self.cached_calls += r["cached_calls"]
            self.input_tokens += r["input_tokens"]
            self.output_tokens += r["output_tokens"]
            self.usd += r["usd"]

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class Budget:
    max_usd: float = 5.0
    max_calls: int = 5000

    def check(self, meter: Meter, calls: int = 0, usd: float = 0.0) -> None:
        if meter.calls + calls > self.max_calls:
            raise BudgetExceeded(f"{meter.calls} calls made, {calls} more would pass {self.max_calls}")
        if meter.usd + usd > self.max_usd:
            raise BudgetExceeded(f"${meter.usd:.4f} spent, ${usd:.4f} more would pass ${self.max_usd:.4f}")

    def remaining(self, meter: Meter) -> tuple[float, int]:
        return max(0.0, self.max_usd - meter.usd), max(0, self.max_calls - meter.calls)
