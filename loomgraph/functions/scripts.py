"""Starlark, shell and PowerShell by their syntax (EX-S): functions and the commands or calls in them.

Starlark is read by Python's own grammar, of which it is a part.  Shell and PowerShell have
a lexer each: a stack says whether code, a string or a substitution is read and whether
a word stands where a command begins; here-documents queue up and are passed over at the
line's end.  A command's name is its first word's last path segment.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

#: fixed values: words after which another command begins, and words that end or open what is none
SHELL_BEFORE = frozenset("if then else elif do while until ! { time".split())
SHELL_OTHER = frozenset("fi done esac } ]] for case select in function local declare typeset export readonly unset".split())
POWER_OTHER = frozenset("if else elseif foreach for while do until switch try catch finally return throw param begin process end break continue exit trap filter function class enum in data using default".split())


@dataclass
class Found:
    """A function: its name, first and last line, signature, and (name, line, raw) of what it calls."""

    name: str
    first: int
    last: int
    signature: str
    calls: list[tuple[str, int, str]] = field(default_factory=list)


def starlark(source: str) -> list[Found]:
    """Functions in order of their lines; those inside others as well, whose calls count for both."""
    out = []
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, ast.FunctionDef):
            lines = source.split("\n")
            body = node.body[0]
            if body.lineno > node.lineno:
                head = "\n".join(lines[node.lineno - 1 : body.lineno - 1])
            else:
                head = lines[node.lineno - 1].encode()[: body.col_offset].decode()
            f = Found(node.name, node.lineno, node.end_lineno, head.strip()[:200])
            calls = [c for b in node.body for c in ast.walk(b) if isinstance(c, ast.Call)]
            for c in sorted(calls, key=lambda c: (c.lineno, c.col_offset, -(c.end_col_offset or 0))):
                raw = ast.get_source_segment(source, c.func) or ""
                if name := raw.split(".")[-1].strip():
                    f.calls.append((name, c.lineno, raw[:80]))
            out.append(f)
    return sorted(out, key=lambda f: f.first)


_SHELL_WORD = re.compile(r"[^\s;&|()<>\"'`$\\#{}]+|[{}#]")
_HEREDOC = re.compile(r"<<(-?)\s*(?:\"([^\"\n]+)\"|'([^'\n]+)'|\\?([^\s;&|()<>]+))")
_FUNCTION = re.compile(r"(?:function\s+([^\s(){}]+)\s*(?:\(\s*\))?|([^\s(){}$\"'=;&|<>#]+)\s*\(\s*\))\s*(?=[{(\n])")
_ASSIGNED = re.compile(r"[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=")


def shell(source: str) -> list[Found]:
    """Functions of a shell script in order; commands in substitutions and quoted substitutions count, those in comments and here-documents don't."""
    out: list[Found] = []
    open_: list[tuple[Found, int]] = []  # functions and the depth of braces at which they end
    stack: list[str] = []  # what is inside: ) of a group or substitution, " of a string, ` of a substitution, }} of an expansion, )) of arithmetic
    heredocs: list[tuple[str, bool]] = []
    i, n, line, braces, begins, cases = 0, len(source), 1, 0, True, 0
    assigning = -1  # the depth at which an assignment's value is read: another word may follow and begin a command
    while i < n:
        c = source[i]
        if stack and stack[-1] == '"' and c not in '"\\$`\n':
            i += 1
            continue
        if c == "\n":
            line += 1
            i += 1
            if not (stack and stack[-1] == '"'):
                begins, assigning = True, -1
                for end, tabs in heredocs:
                    while i < n:
                        stop = source.find("\n", i)
                        stop = n if stop < 0 else stop
                        text = source[i:stop]
                        i, line = min(n, stop + 1), line + 1
                        if (text.lstrip("\t") if tabs else text) == end:
                            break
                heredocs = []
        elif c == "\\":
            line += source[i + 1 : i + 2] == "\n"
            i += 2
        elif c == '"':
            if stack and stack[-1] == '"':
                stack.pop()
                begins = False
            else:
                stack.append('"')
            i += 1
        elif c == "'":
            stop = source.find("'", i + 1)
            stop = n if stop < 0 else stop + 1
            line += source.count("\n", i, stop)
            i, begins = stop, False
        elif source.startswith("$((", i) or (source.startswith("((", i) and begins):
            stop = source.find("))", i)
            stop = n if stop < 0 else stop + 2
            line += source.count("\n", i, stop)
            i, begins = stop, False
        elif source.startswith("$(", i):
            stack.append(")")
            i, begins = i + 2, True
        elif source.startswith("${", i):
            depth, j = 0, i + 1
            while j < n:
                depth += (source[j] == "{") - (source[j] == "}")
                j += 1
                if not depth:
                    break
            line += source.count("\n", i, j)
            i, begins = j, False
        elif c == "`":
            if "`" in stack:
                while stack and stack.pop() != "`":
                    pass
                begins = False
            else:
                stack.append("`")
                begins = True
            i += 1
        elif stack and stack[-1] == '"':
            i += 1
        elif c == "#" and (i == 0 or source[i - 1] in " \t\n;&|("):
            stop = source.find("\n", i)
            i = n if stop < 0 else stop
        elif c in " \t\r":
            if assigning == len(stack):
                begins, assigning = True, -1
            i += 1
        elif source.startswith("<<", i) and not source.startswith("<<<", i) and (m := _HEREDOC.match(source, i)):
            heredocs.append((m[2] or m[3] or m[4], bool(m[1])))
            i = m.end()
        elif c in "<>":
            m = re.compile(r"[<>]+&?\s*").match(source, i)
            i = m.end()
            word = re.compile(r"[^\s;&|()<>\"'$]+").match(source, i)
            i = word.end() if word else i
        elif c in ";&|":
            i, begins, assigning = i + 1, True, -1
        elif c == "(":
            stack.append(")")
            i, begins = i + 1, True
        elif c == ")":
            if stack and stack[-1] == ")":
                stack.pop()
                begins = False
            else:
                begins = True  # a pattern of a case
            i += 1
        elif begins and (m := _FUNCTION.match(source, i)):
            stop = source.find("{", m.end())
            f = Found(m[1] or m[2], line, line, source[i : stop if 0 <= stop else m.end()].strip()[:200])
            out.append(f)
            open_.append((f, braces))
            i = m.end()
        else:
            m = _SHELL_WORD.match(source, i)
            if not m:  # a dollar sign and a name
                i += 1
                begins = False
                continue
            word = m[0]
            if begins and _ASSIGNED.match(word):
                i = i + _ASSIGNED.match(word).end()
                if source[i : i + 1] == "(":  # an array
                    stack.append(")")
                    i += 1
                    begins = False
                else:
                    begins, assigning = False, len(stack)
                continue
            i = m.end()
            if begins and word == "{":
                braces += 1
            elif begins and word == "}":
                braces -= 1
                while open_ and braces <= open_[-1][1]:
                    open_.pop()[0].last = line
                begins = False
            elif begins and word == "case":
                cases, begins = cases + 1, False
            elif begins and word == "esac":
                cases, begins = cases - 1, False
            elif begins and word in SHELL_BEFORE:
                pass
            elif begins and (word in SHELL_OTHER or word in ("[", "[[")):
                begins = False
            elif begins:
                rest = re.compile(r"[^\s;&|()<>]*").match(source, i)[0]
                if cases and re.compile(r"[^\s;&()<>]*\s*\)").match(source, i) and not (stack and stack[-1] == ")"):
                    begins = False  # a pattern
                    continue
                name = (word + rest).split("/")[-1]
                if open_ and name:
                    open_[-1][0].calls.append((name, line, (word + rest)[:80]))
                i, begins = i + (len(rest) if rest and rest[0] not in "\"'`$" else 0), False
    for f, _ in open_:
        f.last = line
    return out


_POWER = re.compile(
    r"(?P<comment><#.*?(?:#>|\Z)|#[^\n]*)|(?P<string>@'\n.*?\n'@|@\"\n.*?\n\"@|'(?:''|[^'])*'|\"(?:``|`\"|\"\"|[^\"])*\")|(?P<variable>[$@][\w:]+(?:\.\w+)*|\$\{[^}]*\})|(?P<word>[A-Za-z_][\w-]*(?:[./\\:][\w-]+)*)|(?P<number>\d[\w.]*)|(?P<line>\n)|(?P<mark>[^\s\w])",
    re.DOTALL,
)


def powershell(source: str) -> list[Found]:
    """Functions of a PowerShell script in order, with the commands in them."""
    out: list[Found] = []
    open_: list[tuple[Found, int]] = []
    line, seen, depth, begins, named, glued = 1, 0, 0, True, False, -1
    for m in _POWER.finditer(source):
        line += source.count("\n", seen, m.start())
        seen = m.start()
        kind, text = m.lastgroup, m[0]
        if kind == "comment":
            continue
        if kind == "line":
            begins = source[m.start() - 1 : m.start()] != "`"
        elif kind == "mark":
            depth += (text == "{") - (text == "}")
            if text == "}":
                while open_ and depth <= open_[-1][1]:
                    open_.pop()[0].last = line
            begins = text in "{;|(=&" or (text == "}" and begins)
        elif kind == "word":
            if named:
                named = False
                stop = source.find("{", m.end())
                f = Found(text, line, line, f"function {source[m.start() : stop if stop >= 0 else m.end()].strip()}"[:200])
                out.append(f)
                open_.append((f, depth))
            elif begins and text.lower() in ("function", "filter"):
                named = True
                continue
            elif begins and text.lower() in POWER_OTHER:
                continue
            elif begins and open_ and m.start() != glued and source[m.end() : m.end() + 1] not in ("(", "=") and not text.startswith("-"):
                open_[-1][0].calls.append((re.split(r"[/\\]", text)[-1], line, text[:80]))
            begins = False
        else:
            begins = False
        glued = m.end() if text == "-" else -1
    for f, _ in open_:
        f.last = line
    return out


READERS = {"starlark": starlark, "shell": shell, "powershell": powershell}


def records(lang: str, file: str, source: str, module: str) -> Iterator[dict]:
    """A record each function, followed by those of its calls."""
    for f in READERS[lang](source):
        ident = f"{module}.{f.name}"
        yield {"kind": "function", "file": file, "id": ident, "name": f.name, "qualname": f.name, "class_name": None, "line_start": f.first, "line_end": f.last, "signature": f.signature, "is_async": False}
        for name, line, raw in f.calls:
            yield {"kind": "call", "file": file, "id": ident, "name": name, "raw": raw, "line_start": line}
