"""Lenient reading of model replies; Arrow batches, as JSON within prose is beyond regular expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)


def values_within(text: str, opening: str):
    """JSON values that begin at an opening brace of a text, each decoded from there; where none can be, the next brace is tried."""
    decoder = json.JSONDecoder(strict=False)
    for place in (m.start() for m in re.finditer(re.escape(opening), text)):
        try:
            yield decoder.raw_decode(text, place)[0]
        except ValueError:
            continue


def read_objects(text: str | None) -> list[dict]:
    """The objects of a reply: a list of them, one of them, or one that holds them under "examples".

    A fenced block stands for the reply. The whole text is read first, then its first list, then its first object.
    """
    if not text:
        return []
    fenced = FENCE.search(text)
    text = (fenced.group(1) if fenced else text).strip()
    tries = [lambda: json.loads(text, strict=False), lambda: next(values_within(text, "[")), lambda: next(values_within(text, "{"))]
    for attempt in tries:
        try:
            got = attempt()
        except (ValueError, StopIteration):
            continue
        if isinstance(got, dict):
            got = got["examples"] if isinstance(got.get("examples"), list) else [got]
        if isinstance(got, list) and (found := [x for x in got if isinstance(x, dict)]):
            return found
    return []


def read_object(text: str | None) -> dict:
    """The one object of a judge's reply; ValueError where there is none."""
    got = read_objects(text)
    if not got:
        raise ValueError("no JSON object in the reply")
    return got[0]


@F.pandas_udf(ArrayType(StringType()))
def reply_objects(text: pd.Series) -> pd.Series:
    """Each object of a reply as sorted compact JSON; an empty list for null and unreadable replies."""
    return text.map(lambda t: [json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":")) for x in read_objects(t)])


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """A JSON text with sorted keys; null where it can't be read."""

    def one(t: str | None) -> str | None:
        try:
            return json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False) if t else None
        except ValueError:
            return None

    return text.map(one)
