"""Actions of a model's answers: from a fenced block, else from the first whole JSON object, and whether they may be taken."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

FENCE = "```"
#: What ends the reasoning of a fenced answer, and actions that need no element, or one.
SUMMARY = "in summary"
STANDARD_ACTIONS = ("scroll", "press", "goto", "new_tab", "close_tab", "go_back", "go_forward", "tab_focus", "page_focus", "stop", "none")
ELEMENT_ACTIONS = ("click", "type", "hover")

PARSED = StructType([StructField("form", StringType()), StructField("action", StringType()), StructField("reasoning", StringType())])


def json_objects(text: str) -> Iterator[str]:
    """The outermost balanced objects of a text, in order. Braces within strings do not count; an object that never closes
    is none, but those within it are (a quote in it may then hide what follows). A text is walked through once."""
    opened: list[int] = []
    closed: list[tuple[int, int]] = []
    quoted, i = False, 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = bool(opened)  # quotes in the prose around objects open no string
        elif c == "{":
            opened.append(i)
        elif c == "}" and opened:
            start = opened.pop()
            while closed and closed[-1][0] > start:
                closed.pop()
            closed.append((start, i + 1))
        i += 1
    for start, end in closed:
        yield text[start:end]


def _plain(value: object) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def parsed(answer: str | None) -> tuple[str, str | None, str]:
    """fenced, json or none, the action (null for none) and the reasoning of an answer."""
    text = answer or ""
    before, opening, rest = text.partition(FENCE)
    action, closing, _ = rest.partition(FENCE)
    if opening and closing:
        at = text.lower().find(SUMMARY)
        return "fenced", action.strip(), (text[:at] if at > 0 else before).strip()
    for found in json_objects(text):
        try:
            document = json.loads(found)
        except ValueError:
            continue
        return "json", _plain(document.get("action", "")), _plain(document.get("reasoning", ""))
    return "none", None, ""


@F.pandas_udf(PARSED)
def parsed_response(answers: pd.Series) -> pd.DataFrame:
    """form, action and reasoning of each answer: the first closed fence decides, else the first whole JSON object that can
    be read; a missing field is ''. Without either the form is none and the action null."""
    return pd.DataFrame([parsed(a) for a in answers], columns=["form", "action", "reasoning"])


def response_status(form: Column, action: Column, valid: Column) -> Column:
    """ok, invalid_action or json_parse."""
    return F.when(form == "none", "json_parse").when(F.coalesce(valid, F.lit(False)), "ok").otherwise("invalid_action")


def listed_action(action: Column, admissible: Column) -> Column:
    """Whether the action is one of the admissible ones, as they are written."""
    return F.coalesce(F.array_contains(admissible, action), F.lit(False))


def element_action(action: Column, elements: Column) -> Column:
    """Whether an action names a standard verb, or one that takes an element whose id is among ``elements``."""
    own = F.trim(F.coalesce(action, F.lit("")))
    verb = F.when(F.contains(own, F.lit("[")), F.trim(F.split_part(own, F.lit("["), F.lit(1)))).otherwise(F.regexp_extract(own, r"^\S*", 0))
    element = F.nullif(F.regexp_extract(own, r"\[(\w+)\]", 1), F.lit(""))
    held = F.coalesce(F.array_contains(elements, element), F.lit(False))
    return verb.isin(*STANDARD_ACTIONS) | (verb.isin(*ELEMENT_ACTIONS) & held)
