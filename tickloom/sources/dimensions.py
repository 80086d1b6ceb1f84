"""Small configuration tables, checked on the driver: they fail closed."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame, SparkSession

INSTRUMENT = ("symbol", "point_size", "pip_size", "contract_size", "tick_size", "tick_value", "volume_min", "volume_step", "volume_max")


def _decimal(value, name: str) -> Decimal:
    if isinstance(value, float):
        raise TypeError(f"{name}: write decimals as text, not as floats")
    try:
        return Decimal(str(value))
    except InvalidOperation as e:
        raise ValueError(f"{name}: {value!r} is no decimal") from e


def instruments(spark: SparkSession, specs: list[dict]) -> DataFrame:
    rows = []
    for s in specs:
        missing = [k for k in (*INSTRUMENT, "quote_currency") if k not in s]
        if missing:
            raise ValueError(f"{s.get('symbol')}: missing {missing}")
        rows.append((s["symbol"], *[_decimal(s[k], k) for k in INSTRUMENT[1:]], s["quote_currency"]))
    kinds = ", ".join(f"{k} decimal(18,8)" for k in INSTRUMENT[1:])
    return spark.createDataFrame(rows, f"symbol string, {kinds}, quote_currency string")


def fee_schedules(spark: SparkSession, fees: list[dict], allow_unobserved_swaps: bool = False) -> DataFrame:
    """Fee rows; each names its evidence, and swaps that were never observed are
    refused unless allowed."""
    rows = []
    for f in fees:
        if not f.get("evidence"):
            raise ValueError(f"{f.get('symbol')}: fees without evidence")
        if not f.get("swaps_observed", False) and not allow_unobserved_swaps:
            raise ValueError(f"{f['symbol']}: swaps were not observed")
        rows.append((f["symbol"], _decimal(f["commission"], "commission"), _decimal(f["swap_long"], "swap_long"), _decimal(f["swap_short"], "swap_short"), list(f.get("triple_weekdays", [2])), list(f.get("holidays", []))))
    return spark.createDataFrame(rows, "symbol string, commission decimal(18,8), swap_long decimal(18,8), swap_short decimal(18,8), triple_weekdays array<int>, holidays array<string>")


def calendar(spark: SparkSession, events: list[dict]) -> DataFrame:
    """Scheduled events with native arrays of currencies and instruments."""
    cols = ("event_id", "scheduled_time", "affected_currencies", "affected_instruments", "restriction_status", "source", "available_at")
    return spark.createDataFrame([tuple(e[c] for c in cols) for e in events], "event_id string, scheduled_time timestamp_ntz, affected_currencies array<string>, affected_instruments array<string>, restriction_status string, source string, available_at timestamp_ntz")


def verified_rules(rules: dict[str, dict], needed: list[str]) -> dict[str, dict]:
    """The needed rules; an unknown or unverified one refuses."""
    bad = [n for n in needed if rules.get(n, {}).get("status") != "verified"]
    if bad:
        raise PermissionError(f"rules not verified: {bad}")
    return {n: rules[n] for n in needed}
