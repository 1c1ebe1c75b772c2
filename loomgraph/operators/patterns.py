"""Many patterns against many texts: an automaton over all needles reads each text once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: needles of one automaton; more go to several, which read the texts in turn
MOST_NEEDLES = 100_000


def found_in(rows: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """rows, once for each distinct needle that the text contains, with the needle in a column of that name.

    An empty needle is in every text; null texts and null needles meet nothing.
    """
    distinct = needles.select(F.col(needle).alias("needle")).where("needle IS NOT NULL").distinct()
    blocks = max(1, -(-distinct.count() // MOST_NEEDLES))
    out = None
    for k in range(blocks):
        some = [r["needle"] for r in distinct.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == k).collect()]
        found = _scan(rows, text, rows.sparkSession.sparkContext.broadcast(some), needle)
        out = found if out is None else out.unionByName(found)
    return out


def _scan(rows: DataFrame, text: str, needles, name: str) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        words = ahocorasick.Automaton()
        for w in needles.value:
            if w:
                words.add_word(w, w)
        everywhere = [""] if "" in needles.value else []
        if len(words):
            words.make_automaton()
        for batch in batches:
            at, met = [], []
            for k, t in enumerate(batch.column(text).to_pylist()):
                if t is not None:
                    here = everywhere + list({w for _, w in words.iter(t)} if len(words) and t else ())
                    at += [k] * len(here)
                    met += here
            taken = batch.take(pa.array(np.array(at, np.int64)))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(met, pa.string())], names=[*taken.schema.names, name])

    return rows.mapInArrow(scan, StructType([*rows.schema.fields, StructField(name, StringType())]))


def literal_of(pattern: str) -> str:
    """A text that every match of a regular expression contains: its longest run of plain characters outside of groups, or nothing."""
    runs, run, k, depth = [], "", 0, 0
    if "(?" in pattern and any(f in pattern for f in ("(?i", "(?x", "(?u", "(?s", "(?m")):
        return ""
    while k < len(pattern):
        c = pattern[k]
        plain = ""
        if c == "\\":
            k += 1
            escaped = pattern[k : k + 1]
            if escaped in ("Q", "E", "x", "u", "c", "0", "p", "P", "k") or escaped.isdigit():
                return ""  # what may hold more characters than one
            plain = "" if escaped.isalpha() else escaped
        elif c == "[":
            k += 1 + (pattern[k + 1 : k + 2] == "^")
            k += pattern[k : k + 1] == "]"
            inner = 1
            while k < len(pattern) and inner:
                k += pattern[k] == "\\"
                inner += (pattern[k : k + 1] == "[") - (pattern[k : k + 1] == "]")
                k += 1
            k -= 1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            return ""
        elif c not in ".^$*+?{}|":
            plain = c
        elif c == "{":
            k = pattern.find("}", k) if "}" in pattern[k:] else len(pattern)
        after = pattern[k + 1 : k + 2]
        if plain and depth == 0 and after not in ("*", "?", "{"):
            run += plain
        else:
            runs.append(run)
            run = ""
        if plain and after == "+":
            runs.append(run)
            run = ""
        k += 1
    return max([*runs, run], key=len)
