"""Prices, pips, volumes and money as decimal Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE, MONEY = "decimal(18,8)", "decimal(38,10)"


def exact(value: Column | str, kind: str = PRICE) -> Column:
    """A decimal from text or decimals; use on columns that never were floats."""
    return (F.lit(value) if isinstance(value, str) else value).cast("string").cast(kind)


def require_no_floats(schema: T.StructType, columns: list[str]) -> None:
    bad = [f.name for f in schema.fields if f.name in columns and isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if bad:
        raise TypeError(f"floats where decimals are needed: {bad}")


def pips_to_price(pips: Column, pip_size: Column) -> Column:
    return pips * pip_size


def price_to_pips(distance: Column, pip_size: Column) -> Column:
    return distance / pip_size


def round_volume_down(volume: Column, step: Column) -> Column:
    return F.floor(volume / step) * step


def round_up(value: Column, quantum: Column) -> Column:
    """Costs to their quantum and stop distances to points: never less."""
    return F.ceil(value / quantum) * quantum


def half_even(value: Column, places: int) -> Column:
    return F.bround(value, places)


def tradable_volume(volume: Column, step: Column, least: Column) -> Column:
    """Rounded down to the step; null below the least volume."""
    v = round_volume_down(volume, step)
    return F.when(v >= least, v)


def pip_value_usd(contract: Column, pip_size: Column, price: Column, quote: Column) -> Column:
    per_pip = contract * pip_size
    return F.when(quote == "USD", per_pip).when(quote == "JPY", per_pip / price).otherwise(F.raise_error(F.concat(F.lit("no conversion for quote currency "), quote)).cast("double"))


def pnl(side: Column, volume: Column, entry: Column, exit_: Column, contract: Column) -> Column:
    return F.when(side == "buy", exit_ - entry).otherwise(entry - exit_) * volume * contract


def round_trip_commission(volume: Column, per_lot: Column) -> Column:
    return volume * per_lot


def volatility_bucket(ratio: Column) -> Column:
    return F.when(ratio < 0.5, "low").when(ratio > 1.5, "high").otherwise("normal")


def rule_amount(kind: Column, value: Column, capital: Column) -> Column:
    return F.when(kind == "percent_initial_capital", capital * value / 100).otherwise(value)
