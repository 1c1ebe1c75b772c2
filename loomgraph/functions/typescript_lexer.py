"""A goal-directed lexer of TypeScript with a stack of modes.

What a slash, a brace or an angle bracket means depends on what stands before it: after an
operand a slash divides, elsewhere it opens a regular expression; a closing brace may end
a block, an object, a template's substitution or an expression in JSX, which what opened
it tells.  Templates and JSX text are modes of their own, between which expressions are
code again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

#: fixed values: words after which an operand comes; words whose brackets are followed by a statement
BEFORE_OPERAND = frozenset("return typeof instanceof in of new delete void throw case do else yield await extends default".split())
CONTROL = frozenset("if while for with".split())

_SKIP = re.compile(r"\s+|//[^\n]*|/\*.*?(?:\*/|\Z)", re.DOTALL)
_STRING = re.compile(r""""(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.DOTALL)
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_WORD = re.compile(r"[A-Za-z_$#@]?[A-Za-z_$]\w*|[_$]|[^\W\d]\w*")
_NUMBER = re.compile(r"\d[\w.]*")
_MARK = re.compile(r"=>|\.\.\.|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|\*\*=?|[=!]==?|[-+*/%^&|]=|.", re.DOTALL)
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.DOTALL)
_TAG = re.compile(r"<(?:/\s*)?(?:[A-Za-z_$][\w.$:-]*)?")
_ATTRIBUTE = re.compile(r"[^\s/>{\"'<=]+|=")
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$]\w*\s*(?:,|extends\b|=\s*[A-Za-z])")


def lex(text: str, jsx: bool = False) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the tokens: string, word, number or mark.

    Strings are also regular expressions, the text parts of templates and of JSX, and JSX
    tags; a substitution is between the marks `${` and `}`, an expression in JSX between
    braces.  What isn't closed ends with the text.
    """
    n, i = len(text), 0
    modes = ["code"]  # of each: code, template, tag, children
    opened: list[tuple[str, str]] = []  # brackets of code: the mark, and what it is
    operand, last, before_last, at_last = False, "", "", -1  # whether an operand has just ended; the marks before
    while i < n:
        mode = modes[-1]
        if mode == "template":
            end = _TEMPLATE.match(text, i).end()
            if text[end : end + 1] == "`":
                yield "string", i, end + 1
                modes.pop()
                i, operand, last = end + 1, True, "`"
            else:
                if end > i:
                    yield "string", i, end
                if end >= n:
                    return
                if text.startswith("${", end):
                    yield "mark", end, end + 2
                    modes.append("code")
                    opened.append(("${", "template"))
                    i, operand, last = end + 2, False, "${"
                else:  # a backslash ends the text
                    i = end + 1
            continue
        if mode == "children":
            end = i
            while end < n and text[end] not in "<{":
                end += 1
            if text[i:end].strip():
                yield "string", i, end
            i = end
            if i >= n:
                return
            if text[i] == "{":
                yield "mark", i, i + 1
                modes.append("code")
                opened.append(("{", "jsx"))
                i, operand, last = i + 1, False, "{"
                continue
            m = _TAG.match(text, i)
            if text.startswith("</", i):
                end = text.find(">", i)
                end = n if end < 0 else end + 1
                yield "string", i, end
                modes.pop()
                i, operand, last = end, True, ">"
            else:
                yield "string", i, m.end()
                modes.append("tag")
                i = m.end()
            continue
        m = _SKIP.match(text, i)
        if m:
            i = m.end()
            continue
        c = text[i]
        if mode == "tag":
            if text.startswith("/>", i):
                yield "string", i, i + 2
                modes.pop()
                i, operand, last = i + 2, True, ">"
            elif c == ">":
                yield "string", i, i + 1
                modes[-1] = "children"
                i += 1
            elif c == "{":
                yield "mark", i, i + 1
                modes.append("code")
                opened.append(("{", "jsx"))
                i, operand, last = i + 1, False, "{"
            elif c == "<":  # type arguments
                depth, end = 0, i
                while end < n:
                    depth += (text[end] == "<") - (text[end] == ">")
                    end += 1
                    if not depth:
                        break
                i = end
            elif c in "\"'":
                end = text.find(c, i + 1)
                end = n if end < 0 else end + 1
                yield "string", i, end
                i = end
            else:
                m = _ATTRIBUTE.match(text, i)
                end = m.end() if m else i + 1
                yield "string", i, end
                i = end
            continue
        # code
        if c in "\"'" and (m := _STRING.match(text, i)):
            yield "string", i, m.end()
            i, operand, last = m.end(), True, '"'
            continue
        if c == "`":
            start, end = i, _TEMPLATE.match(text, i + 1).end()
            if text[end : end + 1] == "`":
                yield "string", start, end + 1
                i, operand, last = end + 1, True, "`"
            else:
                yield "string", start, end
                if end >= n:
                    return
                modes.append("template")
                i = end
            continue
        if c == "/" and not operand and (m := _REGEX.match(text, i)):
            yield "string", i, m.end()
            i, operand, last = m.end(), True, "/"
            continue
        if c == "<" and jsx and not operand and (m := _TAG.match(text, i)) and (m.end() > i + 1 or text[i + 1 : i + 2] == ">") and not _GENERIC.match(text, i):
            yield "string", i, m.end()
            modes.append("tag")
            i = m.end()
            continue
        if m := _WORD.match(text, i):
            word = m[0]
            yield "word", i, m.end()
            operand = not (word in BEFORE_OPERAND and last not in (".", "?."))
            before_last, last, at_last = last, word, m.end()
            i = m.end()
            continue
        if m := _NUMBER.match(text, i):
            yield "number", i, m.end()
            i, operand, last = m.end(), True, "0"
            continue
        m = _MARK.match(text, i)
        mark = m[0]
        yield "mark", i, m.end()
        if mark in ("(", "[", "{"):
            what = ""
            if mark == "(":
                what = "control" if last in CONTROL and before_last not in (".", "?.") else ""
            elif mark == "{":
                what = "value" if not operand and last in ("(", ",", "=", ":", "[", "?", "&&", "||", "??", "return", "${", "!", "...") else "block"
            opened.append((mark, what))
            operand = False
        elif mark in (")", "]", "}"):
            top, what = opened.pop() if opened else ("", "")
            if mark == "}" and what in ("template", "jsx") and len(modes) > 1:
                modes.pop()
            operand = what not in ("control", "block")
        elif mark in ("+", "-") and last == mark and at_last == i and operand is False and before_last == "operand":
            operand = True  # a++ and a-- after their operand
        elif mark == "!" and operand and at_last == i:
            pass  # what is asserted not to be null stays an operand
        else:
            before_last = "operand" if operand else ""
            operand = False
            last, at_last = mark, m.end()
            i = m.end()
            continue
        before_last, last, at_last = last, mark, m.end()
        i = m.end()
