"""String and JSON column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
BUY_PATTERN = "purchase|buy|acquisition"
SELL_PATTERN = "sale|sell|disposal"
# ----------------------------------------------------------------------------


def is_buy(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(BUY_PATTERN), F.lit(False))


def is_sell(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike(SELL_PATTERN), F.lit(False))


def json_body(raw: Column) -> Column:
    """Text of the JSON object inside a free-form answer.

    A fenced block (tagged ``json`` first, else any fence) narrows the text; if
    what is left parses as an object it is the body, otherwise the widest
    ``{...}`` span is tried. NULL when neither parses.
    """
    text = F.trim(raw)
    tagged = F.element_at(F.split(F.element_at(F.split(text, "```json", 3), 2), "```", 2), 1)
    fenced = F.element_at(F.split(text, "```", 3), 2)
    inner = F.trim(
        F.when(F.contains(text, F.lit("```json")), tagged)
        .when(F.contains(text, F.lit("```")), fenced)
        .otherwise(text),
        F.lit(" \n\r\t"),
    )
    span = F.nullif(F.regexp_extract(inner, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(is_json_object(inner), inner).when(is_json_object(span), span)


def is_json_object(c: Column) -> Column:
    return F.coalesce(c.startswith("{") & F.try_parse_json(c).isNotNull(), F.lit(False))
