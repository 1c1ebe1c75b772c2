"""Definition and call scans of languages without a parser here (EX-R, EX-G, EX-T, EX-S): a documented subset.

Function definitions are found by line patterns and their ends by the first later line
whose indentation is not deeper and that closes or starts something; calls are names
before an opening bracket inside.  Generics over several lines, macros and nested
function values are not followed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from . import scripts, static_source

#: fixed values: definition patterns by language; group `name`, and `owner` where a line names it
DEFINITIONS = {
    "rust": re.compile(r"^(?P<indent>\s*)(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?P<async>async\s+)?(?:unsafe\s+)?fn\s+(?P<name>\w+)"),
    "go": re.compile(r"^(?P<indent>)func\s+(?:\(\s*\w+\s+\*?(?P<owner>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*[(\[]"),
    "typescript": re.compile(r"^(?P<indent>\s*)(?:export\s+)?(?:default\s+)?(?P<async>async\s+)?(?:function\s+(?P<name>\w+)|(?:const|let)\s+(?P<arrow>\w+)\s*=\s*(?:async\s*)?\([^)]*\)[^=]*=>)"),
    "starlark": re.compile(r"^(?P<indent>\s*)def\s+(?P<name>\w+)\s*\("),
    "shell": re.compile(r"^(?P<indent>\s*)(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*\{?"),
    "powershell": re.compile(r"^(?P<indent>\s*)function\s+(?P<name>[\w-]+)", re.IGNORECASE),
}
OWNERS = {"rust": re.compile(r"^impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)"), "typescript": re.compile(r"^(?:export\s+)?(?:abstract\s+)?class\s+(\w+)")}
_METHOD = re.compile(r"^(?P<indent>\s+)(?:public\s+|private\s+|protected\s+|static\s+)*(?P<async>async\s+)?(?P<name>\w+)\s*\([^)]*\)\s*(?::[^{]*)?\{")
_CALL = re.compile(r"([A-Za-z_][\w]*(?:(?:\.|::)[A-Za-z_]\w*)*)\s*\(")
_WORDS = frozenset("if for while switch match return fn func function def catch elif and or not in".split())
SEPARATOR = {"rust": "::"}


def module_of(lang: str, file: str) -> str:
    """Module of a file: slashes become the language's separator; Rust drops mod, lib and main."""
    parts = re.sub(r"\.[^./]+$", "", file).split("/")
    if lang == "rust":
        parts = [p for p in parts if p not in ("mod", "lib", "main")] or parts[-1:]
    return SEPARATOR.get(lang, ".").join(parts)


def scan(lang: str, file: str, source: str) -> Iterator[dict]:
    """Functions of a file, each followed by its calls; scripts by their syntax, or by lines where that can't be read."""
    if lang in scripts.READERS:
        try:
            yield from list(scripts.records(lang, file, source, module_of(lang, file)))
            return
        except (SyntaxError, ValueError, RecursionError):
            pass
    lines, sep, owner = source.split("\n"), SEPARATOR.get(lang, "."), None
    pattern, found = DEFINITIONS[lang], []
    for k, line in enumerate(lines):
        if lang in OWNERS and (o := OWNERS[lang].match(line)):
            owner = o[1]
        elif line[:1] == "}":
            owner = None
        m = pattern.match(line)
        if not m and lang == "typescript" and owner:
            m = _METHOD.match(line)
            if m and m["name"] in _WORDS:
                m = None
        if m:
            got = m.groupdict()
            name = got.get("name") or got.get("arrow")
            cls = got.get("owner") or (owner if m["indent"] else None)
            found.append((k, len(m["indent"]), name, cls, bool(got.get("async")), line.strip()[:200]))
    for k, indent, name, cls, is_async, signature in found:
        end = k
        for j in range(k + 1, len(lines)):
            text = lines[j]
            if text.strip() and len(text) - len(text.lstrip()) <= indent:
                end = j if text.strip()[0] in "})" else end
                break
            if text.strip():
                end = j
        qualname = f"{cls}{sep}{name}" if cls else name
        ident = f"{module_of(lang, file)}{sep}{qualname}"
        yield {"kind": "function", "file": file, "id": ident, "name": name, "qualname": qualname, "class_name": cls, "line_start": k + 1, "line_end": end + 1, "signature": signature, "is_async": is_async}
        for j in range(k + 1, end + 1):
            for c in _CALL.finditer(lines[j]):
                if c[1] not in _WORDS:
                    yield {"kind": "call", "file": file, "id": ident, "name": re.split(r"\.|::", c[1])[-1], "raw": c[1][:80], "line_start": j + 1}


SCHEMA = "kind string, file string, id string, name string, qualname string, class_name string, line_start int, line_end int, signature string, is_async boolean, raw string, lang string, ord long"
_COLUMNS = [p.split()[0] for p in SCHEMA.split(", ")]


def extract(files: DataFrame) -> DataFrame:
    """Records of files (lang, file, source) in the languages above; others give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for lang, file, source in zip(b["lang"], b["file"], b["source"], strict=True):
                found = scan(lang, file, source or "") if lang in DEFINITIONS else ()
                rows += [{**dict.fromkeys(_COLUMNS), **r, "lang": lang, "ord": k} for k, r in enumerate(found)]
            yield pd.DataFrame(rows, columns=_COLUMNS).astype(object)

    return static_source.spread(files.select("lang", "file", "source")).mapInPandas(run, SCHEMA)
