"""Rounding, clamping and money as column expressions."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default prices per million tokens.
INPUT_PER_MILLION = 0.042
OUTPUT_PER_MILLION = 0.0
# Models with other prices: name to (input, output).
MODEL_PRICES: dict[str, tuple[float, float]] = {}

# Result list size as a share of the units in scope.
RESULT_RATIO = 0.05
MIN_RESULTS = 5
MAX_RESULTS = 50


def clamp01(value: Column) -> Column:
    return F.when(F.isnan(value), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    )


def half_up(value: Column, scale: float, divisor: float | None = None) -> Column:
    """floor(value*scale + 0.5) / divisor: ties go up, as opposed to ``round``."""
    whole = F.floor(value * F.lit(float(scale)) + F.lit(0.5))
    return whole.cast("double") / F.lit(float(scale if divisor is None else divisor))


def percent_label(share: Column) -> Column:
    return F.concat(F.floor(share * 100.0 + 0.5).cast("string"), F.lit("%"))


def estimate_cost(input_tokens: Column, output_tokens: Column, model: Column) -> Column:
    price_in, price_out = F.lit(INPUT_PER_MILLION), F.lit(OUTPUT_PER_MILLION)
    for name, (per_in, per_out) in MODEL_PRICES.items():
        price_in = F.when(model == name, F.lit(per_in)).otherwise(price_in)
        price_out = F.when(model == name, F.lit(per_out)).otherwise(price_out)
    return (input_tokens / 1e6) * price_in + (output_tokens / 1e6) * price_out


def cost_of(input_tokens: float, output_tokens: float, model: str) -> float:
    per_in, per_out = MODEL_PRICES.get(model, (INPUT_PER_MILLION, OUTPUT_PER_MILLION))
    return (input_tokens / 1e6) * per_in + (output_tokens / 1e6) * per_out


def result_limit(units: Column) -> Column:
    scaled = F.floor(units * F.lit(RESULT_RATIO) + 0.5)
    return F.least(F.lit(MAX_RESULTS), F.greatest(F.lit(MIN_RESULTS), scaled)).cast("int")


def fixed(value: float, places: int) -> str:
    """Decimal text of the exact binary value, ties away from zero."""
    return str(Decimal(value).quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP))


def format_usd(amount: float) -> str:
    if amount == 0:
        return "$0"
    return "$" + fixed(amount, 5 if amount < 0.01 else 4)


def usd_text(amount: Column) -> Column:
    return F.when(amount == 0, F.lit("$0")).otherwise(
        F.concat(
            F.lit("$"),
            F.when(amount < 0.01, F.format_string("%.5f", amount)).otherwise(
                F.format_string("%.4f", amount)
            ),
        )
    )


def format_tokens(count: int) -> str:
    return f"{count:,}"
