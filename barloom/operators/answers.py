"""Structured fields out of free-form agent answers, in one pass over the column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import to_double
from barloom.functions.text import json_body
from barloom.sources.dims import DEFAULT_STYLE, STYLES


def _text(name: str, default: str = "") -> Column:
    return F.coalesce(F.get_json_object("_body", f"$.{name}"), F.lit(default))


def _number(name: str, default: float) -> Column:
    return F.coalesce(to_double(F.get_json_object("_body", f"$.{name}")), F.lit(default))


def _health() -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), _number("health_score", 50.0).cast("int")))


def fields(agent: str) -> dict[str, Column]:
    """Output fields and defaults per agent type."""
    if agent == "News-Sentiment":
        return {"sentiment_score": _number("sentiment_score", 0.0), "confidence": _number("confidence", 0.5), "key_theme": _text("key_theme")}
    if agent == "Technical-Forecaster":
        return {"direction": _text("direction", "sideways"), "confidence": _number("confidence", 0.5), "reasoning": _text("reasoning")}
    if agent == "Fundamentals":
        score = F.get_json_object("_body", "$.health_score").try_cast("double")
        health = F.when(score.isNull() | (score == 0), 50).otherwise(_health())
        return {"health_score": health, "key_strength": _text("key_strength"), "key_risk": _text("key_risk")}
    if agent == "Risk-Style":
        style = F.lower(_text("style", DEFAULT_STYLE))
        return {"style": F.when(style.isin(*STYLES), style).otherwise(DEFAULT_STYLE), "confidence": _number("confidence", 0.5), "reasoning": _text("reasoning")}
    if agent == "Portfolio-Decision":
        weights = F.from_json(F.get_json_object("_body", "$.weights"), "map<string,string>")
        return {"weights": weights, "rationale": _text("rationale")}
    raise ValueError(f"unknown agent {agent}")


def parse_agent_response(responses: DataFrame, agent: str, raw: str = "raw") -> DataFrame:
    """Add the agent's fields parsed from ``raw``; unusable text gives the defaults."""
    body = responses.withColumn("_body", json_body(F.col(raw)))
    return body.select(*[c for c in responses.columns if c != raw], *[c.alias(n) for n, c in fields(agent).items()])
