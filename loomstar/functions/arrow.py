"""The few functions without a built-in form: match places and Python's JSON text, in Arrow batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstar.functions import fixed

#: What every mention has something of; texts without any need not go to Python.
MAY_NAME = r"/|:\\|def|func|const|class|interface|struct|import|from|require|E[0-9]|ERR_|Error|Exception|[a-f0-9]{7}|HEAD|main|master|develop"
MENTION = "array<struct<entity_type string, entity_text string, context_snippet string, position_start int, position_end int>>"


def mentions_of(text: str | None, kinds: tuple[str, ...] | None = None) -> list[tuple[str, str, str, int, int]]:
    found = []
    for kind, pattern in ENTITIES:
        if kinds is not None and kind not in kinds:
            continue
        for m in pattern.finditer(text or ""):
            own = next((g for g in m.groups() if g), m.group(0))
            line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
            unsure = kind == "git_ref" and own in ("HEAD", "main", "master") and not GIT.search(line)
            if len(own) >= 2 and not unsure:
                found.append((kind, own[:500], text[max(0, m.start() - 50) : m.end() + 50][:200], m.start(), m.end()))
    return found


ENTITIES = [(k, re.compile(v)) for k, v in fixed.ENTITY_PATTERNS.items()]
GIT = re.compile(fixed.GIT_WORD, re.IGNORECASE)


def all_mentions(texts: pd.Series) -> pd.Series:
    return texts.map(mentions_of)


def entity_mentions(text: Column | str, *kinds: str) -> Column:
    """Array of struct: what the text names (files, urls, functions, classes, packages, errors, git refs) and where; of these kinds only, if any are given."""
    return F.pandas_udf((lambda texts: texts.map(lambda t: mentions_of(t, kinds))) if kinds else all_mentions, MENTION)(text)


def python_json(text: str | None) -> str | None:
    try:
        return None if text is None else json.dumps(json.loads(text))
    except ValueError:
        return json.dumps(text)


def all_python_json(texts: pd.Series) -> pd.Series:
    return texts.map(python_json)


def as_python_json(text: Column | str) -> Column:
    """The text that Python writes for a JSON value (spaces after separators, escapes beyond ASCII)."""
    return F.pandas_udf(all_python_json, "string")(text)


def python_str(text: str | None) -> str | None:
    try:
        return None if text is None else str(json.loads(text))
    except ValueError:
        return text


def all_python_str(texts: pd.Series) -> pd.Series:
    return texts.map(python_str)


def as_python_str(text: Column | str) -> Column:
    """What Python's str() gives for a JSON value: {'a': None}, [1, 'b'], True; a text that isn't JSON stays."""
    return F.pandas_udf(all_python_str, "string")(text)


def python_texts(text: str | None) -> str | None:
    return None if text is None else " ".join(str(x.get("text", "")) for x in json.loads(text) if isinstance(x, dict))


def all_python_texts(texts: pd.Series) -> pd.Series:
    return texts.map(python_texts)


def as_python_texts(text: Column | str) -> Column:
    """The texts of a JSON array's objects with a space between, as Python's str() gives them."""
    return F.pandas_udf(all_python_texts, "string")(text)
