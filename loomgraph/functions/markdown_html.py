"""Markdown to HTML (SK-8): blocks by a fold over lines with a stack of open elements, spans inside of them, code by tokens.

Headings, paragraphs, nested lists, quotes, tables, rules, fenced code and raw `details`
blocks; text is escaped, so nothing of it becomes markup by itself.
"""

from __future__ import annotations

import re
from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ITEM = re.compile(r"^(\s*)([-*+]|\d+[.)])\s+(.*)$")
_FENCE = re.compile(r"^\s*(```+|~~~+)\s*([\w+-]*)\s*$")
_RAW = re.compile(r"^</?(?:details|summary)\b[^>]*>.*$")
_SPAN = re.compile(r"`([^`]+)`|\*\*(.+?)\*\*|\*([^*\s][^*]*)\*|\[([^\]]*)\]\(([^)\s]*)\)")
#: what the highlighter tells apart
_CODE = re.compile(
    r"(?P<c>#[^\n]*|//[^\n]*|/\*.*?\*/)|(?P<s>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<n>\b\d[\w.]*\b)"
    r"|(?P<k>\b(?:def|class|return|if|else|elif|for|while|in|import|from|as|with|try|except|fn|let|mut|pub|impl|struct|enum|match|func|package|type|var|const|function|async|await|new|None|True|False|null|true|false)\b)",
    re.DOTALL,
)


def spans(text: str) -> str:
    """Inline markup of a line: code, bold, italic, links; the rest is escaped."""
    out, at = [], 0
    for m in _SPAN.finditer(text):
        out.append(escape(text[at : m.start()]))
        if m[1] is not None:
            out.append(f"<code>{escape(m[1])}</code>")
        elif m[2] is not None:
            out.append(f"<strong>{spans(m[2])}</strong>")
        elif m[3] is not None:
            out.append(f"<em>{escape(m[3])}</em>")
        elif re.match(r"(?i)\s*(?:javascript|data|vbscript):", m[5]):
            out.append(escape(m[4]))
        else:
            out.append(f'<a href="{escape(m[5])}">{spans(m[4])}</a>')
        at = m.end()
    return "".join([*out, escape(text[at:])])


def highlighted(code: str) -> str:
    """Code with comments, strings, numbers and keywords marked."""
    out, at = [], 0
    for m in _CODE.finditer(code):
        out += [escape(code[at : m.start()]), f'<span class="{m.lastgroup}">{escape(m[0])}</span>']
        at = m.end()
    return "".join([*out, escape(code[at:])])


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def to_html(text: str | None) -> str:
    """The HTML of a Markdown text; an unclosed fence ends with the text."""
    out: list[str] = []
    stack: list[tuple[str, int]] = []  # open lists and quotes, with their indentation
    para: list[str] = []
    lines = (text or "").split("\n")

    def flush() -> None:
        if para:
            body = spans(" ".join(x.strip() for x in para))
            out.append(body if stack and stack[-1][0] != "blockquote" else f"<p>{body}</p>")
            para.clear()

    def shut(indent: int = -1, quote: bool = False) -> None:
        flush()
        while stack and (stack[-1][1] >= indent if stack[-1][0] != "blockquote" else not quote):
            kind, _ = stack.pop()
            out.append(f"</{kind}>" if kind == "blockquote" else f"</li></{kind}>")

    k = 0
    while k < len(lines):
        line = lines[k]
        k += 1
        indent = len(line) - len(line.lstrip())
        if m := _FENCE.match(line):
            flush()
            code = []
            while k < len(lines) and not (lines[k].strip().startswith(m[1]) and not lines[k].strip().strip(m[1][0])):
                code.append(lines[k][min(indent, len(lines[k]) - len(lines[k].lstrip())) :])
                k += 1
            k += 1
            if not indent:
                shut()
            out.append(f'<pre><code class="{escape(m[2] or "text")}">{highlighted(chr(10).join(code))}</code></pre>')
        elif not line.strip():
            flush()
            if k < len(lines) and not lines[k].startswith((" ", "\t")) and not _ITEM.match(lines[k]):
                shut()
        elif m := re.match(r"^(#{1,6})\s+(.*?)\s*#*$", line):
            shut()
            out.append(f"<h{len(m[1])}>{spans(m[2])}</h{len(m[1])}>")
        elif re.match(r"^\s*(?:-{3,}|\*{3,}|_{3,})\s*$", line):
            shut()
            out.append("<hr>")
        elif _RAW.match(line.strip()) and not indent:
            shut()
            m = re.match(r"^<summary>(.*)</summary>$", line.strip())
            out.append(f"<summary>{spans(m[1])}</summary>" if m else "</details>" if line.strip().startswith("</details") else "<details>" if line.strip().startswith("<details") else escape(line))
        elif m := _ITEM.match(line):
            flush()
            kind, depth = ("ul" if m[2] in "-*+" else "ol"), len(m[1])
            while stack and (stack[-1][0] == "blockquote" or stack[-1][1] > depth):
                old, _ = stack.pop()
                out.append(f"</{old}>" if old == "blockquote" else f"</li></{old}>")
            if stack and stack[-1] == (kind, depth):
                out.append("</li><li>")
            else:
                if stack and stack[-1][1] == depth:
                    out.append(f"</li></{stack.pop()[0]}>")
                stack.append((kind, depth))
                out.append(f"<{kind}><li>")
            para.append(m[3])
        elif line.startswith(">"):
            if not (stack and stack[-1][0] == "blockquote"):
                shut()
                stack.append(("blockquote", 0))
                out.append("<blockquote>")
            para.append(line[1:])
        elif "|" in line and k < len(lines) and re.match(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$", lines[k]) and "|" in lines[k]:
            shut()
            head = _cells(line)
            rows = []
            k += 1
            while k < len(lines) and "|" in lines[k] and lines[k].strip():
                rows.append(_cells(lines[k]))
                k += 1
            out.append("<table><tr>" + "".join(f"<th>{spans(c)}</th>" for c in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{spans(c)}</td>" for c in r) + "</tr>" for r in rows) + "</table>")
        else:
            if stack and stack[-1][0] == "blockquote" or stack and not indent and not para:
                shut()
            para.append(line)
    shut()
    return "".join(out)


@F.pandas_udf(T.StringType())
def html_of(texts: pd.Series) -> pd.Series:
    """`to_html` of a column: blocks depend on the lines before them, so whole Arrow batches go to Python."""
    return texts.map(to_html)


def pages(docs: DataFrame, title: str = "Stages") -> DataFrame:
    """SK-8: (id, html) of pages (id, title, text, before, after): a whole HTML page each, with links to the pages before and after."""
    link = lambda c, word: F.when(F.col(c).isNotNull(), F.concat(F.lit('<a href="'), c, F.lit(f'.html">{word}</a>')))
    nav = F.concat(F.lit("<nav>"), F.concat_ws(" ", link("before", "previous"), link("after", "next")), F.lit("</nav>"))
    safe = F.replace(F.replace(F.coalesce("title", "id"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    head = F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), safe, F.lit(f" — {title}</title></head><body>"))
    return docs.select("id", F.concat(head, nav, F.lit("<main>"), html_of(F.col("text")), F.lit("</main></body></html>")).alias("html"))


def changed_pages(made: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SK-9: (pages to write (id, html, sha1), ids to delete) against what is stored (id, sha1): a page is written only where its hash changed."""
    hashed = made.withColumn("sha1", F.sha1("html"))
    return hashed.join(stored.select("id", "sha1"), ["id", "sha1"], "left_anti").select("id", "html", "sha1"), stored.select("id").join(made.select("id"), "id", "left_anti")
