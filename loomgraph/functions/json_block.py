"""JSON out of free text (LM-1)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"```(?:json)?\s*\n(.*?)```", re.DOTALL)


def json_block(text: str | None) -> str | None:
    """The first fenced block that parses, else the first balanced {...} that does, as compact JSON; null if there is none."""
    text = text or ""
    for block in _FENCE.findall(text):
        try:
            return json.dumps(json.loads(block), ensure_ascii=False)
        except ValueError:
            continue
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            return json.dumps(decoder.raw_decode(text, at)[0], ensure_ascii=False)
        except ValueError:
            at = text.find("{", at + 1)
    return None


@F.pandas_udf(T.StringType())
def extract_json(texts: pd.Series) -> pd.Series:
    """`json_block` of a column; parsing at a place of the text has no built-in."""
    return texts.map(json_block)
