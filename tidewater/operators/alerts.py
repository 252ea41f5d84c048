"""Alert rules: grammar, evaluation, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import c


def compare(x: Column | str, op: Column | str, threshold: Column | str, tolerance: float = 1e-4) -> Column:
    """x op threshold, the operator being data; equality within ``tolerance``. Null for unknown operators."""
    a, o, b = c(x), c(op), c(threshold)
    equal = F.abs(a - b) < tolerance
    return F.when(o == ">", a > b).when(o == "<", a < b).when(o == ">=", a >= b).when(o == "<=", a <= b).when(o.isin("=", "=="), equal).when(o == "!=", ~equal)


def parse_command(text: Column | str) -> dict[str, Column]:
    """Parts of ``/set_alert indicator operator value "message"``, null where the text is no such command."""
    pattern = r'^/set_alert\s+(\w+)\s*(>=|<=|!=|==|=|>|<)\s*(-?[0-9]+(?:\.[0-9]+)?)(?:\s+"([^"]*)")?\s*$'
    part = lambda i: F.nullif(F.regexp_extract(c(text), pattern, i), F.lit(""))
    return {"indicator": part(1), "operator": part(2), "threshold": part(3).cast("double"), "message": part(4)}


# Phrases of watch requests in Korean and the operator they mean.
WATCH_PHRASES = (("이상", ">="), ("이하", "<="), ("초과", ">"), ("미만", "<"), ("넘으면", ">"), ("떨어지면", "<"), ("오르면", ">"), ("내리면", "<"), ("상승하면", ">"), ("하락하면", "<"), ("도달하면", ">="))


def parse_watch(text: Column | str) -> dict[str, Column]:
    """Indicator, number and operator of a free-form watch request: a name, a number (with 만 for ten thousand), and a phrase."""
    t = c(text)
    number = F.regexp_replace(F.regexp_extract(t, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "").try_cast("double")
    scale = F.when(t.rlike(r"[0-9][0-9,.]*\s*만"), 10_000.0).otherwise(1.0)
    op = F.coalesce(*[F.when(F.contains(t, F.lit(p)), o) for p, o in WATCH_PHRASES])
    return {"indicator": F.nullif(F.regexp_extract(t, r"^\s*([\p{L}_]+)", 1), F.lit("")), "threshold": number * scale, "operator": op}


def evaluate(metrics: DataFrame, rules: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Metrics (metric, value, ...) joined by name with the enabled rules that they trigger. Rules are a small dimension."""
    joined = metrics.join(rules.where("enabled"), "metric")
    return joined.where(compare("value", "operator", "threshold", tolerance))


def gate(accuracy: Column | str, probability: Column | str) -> Column:
    """The probability an alert needs rises as recent accuracy falls."""
    needed = F.when(c(accuracy) >= 0.8, 60.0).when(c(accuracy) >= 0.6, 70.0).when(c(accuracy) >= 0.4, 80.0).otherwise(90.0)
    return c(probability) >= needed


def risk_level(x: Column | str) -> Column:
    return F.when(c(x) >= 0.8, "CRITICAL").when(c(x) >= 0.6, "HIGH").when(c(x) >= 0.4, "MEDIUM").otherwise("LOW")
