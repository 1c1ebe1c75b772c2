"""Rust, Go and TypeScript extraction (EX-R, EX-G, EX-T): functions, symbols and call forms of source files.

No parser of these languages is installed, so each has a small one here: a lexer with
matched brackets, a reader of the items of a file or block, and a walk over a body that
finds calls.  A call is told as a form (bare name, path, own method, method of an own
attribute, method of a name, macro, other) with its parts; `resolve.resolve_forms` turns
forms and symbols into edges by joins.  Files are read in Arrow batches, a file a row;
one that can't be read yields one `error` record and stops nothing.

Subset: macros are leaves, closures and nested functions are scopes of their own and not
followed, generics in calls (turbofish) leave a call unresolved.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from . import typescript_lexer

#: fixed values: types that say nothing about whose method is called
PLAIN_TYPES = {
    "rust": frozenset("i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 bool char str String Vec Box Option Result HashMap HashSet BTreeMap Rc Arc RefCell Cell Mutex RwLock Cow".split()),
    "go": frozenset("int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr float32 float64 complex64 complex128 byte rune string bool error any".split()),
    "typescript": frozenset("number string boolean any unknown void never object Array Promise Map Set Record Date Object".split()),
}
SEPARATOR = {"rust": "::", "go": ".", "typescript": "."}
EXTENSIONS = {"rust": (".rs",), "go": (".go",), "typescript": (".tsx", ".ts")}
#: fixed values: words that are never called
KEYWORDS = {
    "rust": frozenset("as async await break const continue dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct trait type union unsafe use where while yield".split()),
    "go": frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()),
    "typescript": frozenset("if for while switch catch return typeof new delete void in of do else case throw yield await async function class extends with instanceof".split()),
}
RECORDS = (
    "kind string, lang string, file string, module string, id string, name string, qualname string, class_name string, line_start int, line_end int, signature string, is_async boolean, is_method boolean, "
    "decorators array<string>, used_self_attrs_read array<string>, used_self_attrs_written array<string>, params_types map<string,string>, owner string, target string, "
    "form string, head string, line int, is_await boolean, raw string"
)
_STRINGS = {
    "rust": r"""b?r(?P<hash>#*)".*?"(?P=hash)|b?"(?:\\.|[^"\\])*"|b?'(?:\\(?:x..|u\{[^}]*\}|.)|[^'\\\n])'|'[A-Za-z_]\w*""",
    "go": r"""`[^`]*`|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""",
}
_LEXERS = {
    lang: re.compile(rf"//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<string>{strings})|(?P<word>[A-Za-z_$#@]?[A-Za-z_$]\w*|_)|(?P<number>\d[\w.]*)|(?P<mark>::|->|=>|\.\.\.|\.\.=?|:=|<-|\?\.|[-+*/%^&|]=|[=!]==?|&&|\|\||[^\s\w])", re.DOTALL)
    for lang, strings in _STRINGS.items()
}
_ASSIGNS = frozenset("= += -= *= /= %= ^= &= |= :=".split())
_CLOSING = {"(": ")", "[": "]", "{": "}", "${": "}"}


def _tokens(lang: str, text: str, jsx: bool) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the tokens of a source text."""
    if lang == "typescript":
        yield from typescript_lexer.lex(text, jsx)
        return
    for m in _LEXERS[lang].finditer(text):
        if m.lastgroup and m.lastgroup != "hash" or m["string"]:
            yield "string" if m["string"] else "word" if m["word"] else "number" if m["number"] else "mark", m.start(), m.end()


class Source:
    """Tokens of a file: text, kind, start offset and line of each, and the partner of each bracket."""

    def __init__(self, lang: str, text: str, jsx: bool = False):
        self.lang, self.source = lang, text
        self.text: list[str] = []
        self.kind: list[str] = []
        self.start: list[int] = []
        self.line: list[int] = []
        line, seen = 1, 0
        for kind, start, end in _tokens(lang, text, jsx):
            line += text.count("\n", seen, start)
            seen = start
            self.text.append(text[start:end])
            self.kind.append(kind)
            self.start.append(start)
            self.line.append(line)
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for k, t in enumerate(self.text):
            if self.kind[k] == "mark" and t in _CLOSING:
                stack.append(k)
            elif self.kind[k] == "mark" and t in ")]}" and stack and _CLOSING[self.text[stack[-1]]] == t:
                self.match[stack[-1]] = k
                self.match[k] = stack.pop()

    def __len__(self) -> int:
        return len(self.text)

    def at(self, k: int) -> str:
        """A token's text; nothing beyond the file, and never a string's."""
        return self.text[k] if 0 <= k < len(self.text) and self.kind[k] != "string" else ""

    def is_word(self, k: int) -> bool:
        return 0 <= k < len(self.text) and self.kind[k] == "word"

    def between(self, a: int, b: int) -> str:
        """Source text from token a up to and with token b."""
        return self.source[self.start[a] : self.start[b] + len(self.text[b])]

    def end_line(self, k: int) -> int:
        return self.line[k] + self.text[k].count("\n")

    def after(self, k: int) -> int:
        """The token after k, or after its bracket's partner."""
        return self.match.get(k, k) + 1 if self.at(k) in _CLOSING else k + 1

    def find(self, k: int, end: int, *marks: str) -> int:
        """The first of the marks outside brackets from k on, or end."""
        while k < end and self.at(k) not in marks:
            k = self.after(k)
        return min(k, end)

    def past_angles(self, k: int) -> int:
        """The token after balanced angle brackets that open at k; k itself if none do."""
        if self.at(k) != "<":
            return k
        depth = 0
        while k < len(self):
            depth += (self.at(k) == "<") - (self.at(k) == ">")
            k = self.after(k)
            if depth == 0:
                return k
        return k

    def pieces(self, a: int, b: int, *marks: str) -> Iterator[tuple[int, int]]:
        """Ranges between separators outside brackets and angle brackets."""
        first, k, depth = a, a, 0
        while k < b:
            depth = max(0, depth + (self.at(k) == "<") - (self.at(k) == ">"))
            if self.at(k) in marks and depth == 0:
                if k > first:
                    yield first, k
                first = k + 1
            k = self.after(k)
        if b > first:
            yield first, b


@dataclass
class Function:
    """A function item: its own tokens (first to last), parameters and body as ranges between brackets."""

    name: str
    first: int
    last: int
    params: tuple[int, int]
    body: tuple[int, int] | None
    owner: str | None = None
    prefix: str = ""
    is_async: bool = False
    is_method: bool = False
    decorators: tuple[str, ...] = ()
    me: str | None = None  # the name that stands for the own object
    signature: str = ""


# --- types -------------------------------------------------------------------------


def core_type(s: Source, a: int, b: int) -> str | None:
    """The name that a type's tokens stand for, without references, generics and the path before it."""
    if s.lang == "go":
        words = [k for k in range(a, b) if s.is_word(k) and s.text[k] not in KEYWORDS["go"] and s.at(k + 1) != "."]
        plain = all(s.at(k) in ("*", "[", "]", ".", "...") or s.is_word(k) or s.kind[k] == "number" for k in range(a, b))
        return (s.text[words[0 if plain else -1]] if words else None) or None
    while a < b and (s.at(a) in ("&", "&&", "mut", "*", "const") or s.text[a].startswith("'")):
        a += 1
    k, name = a, None
    while k < b and s.is_word(k) and s.text[k] not in ("dyn", "impl", "fn", "for", "readonly"):
        name = s.text[k]
        k = s.past_angles(k + 1) if s.at(k + 1) == "<" else k + 1
        if s.at(k) not in ("::", "."):
            if s.lang == "typescript" and s.at(k) == "[":
                break  # T[] is an array of T
            return name
        k += 1
    return next((s.text[j] for j in range(a, b) if s.is_word(j) and s.text[j] not in KEYWORDS[s.lang] and s.text[j] not in ("mut", "readonly") and (s.lang != "rust" or s.text[j] not in PLAIN_TYPES["rust"] or s.text[j][:1].isupper())), None)


def telling(s: Source, a: int, b: int) -> str | None:
    name = core_type(s, a, b)
    return name if name and name not in PLAIN_TYPES[s.lang] else None


def param_types(s: Source, f: Function) -> dict[str, str]:
    out: dict[str, str] = {}
    if s.lang == "go":
        names: list[str] = []
        for a, b in s.pieces(*f.params, ","):
            if b - a == 1:
                names.append(s.text[a])  # shares the type of a later one
                continue
            names.append(s.text[a])
            kind = telling(s, a + 1, b)
            out |= dict.fromkeys(names, kind) if kind else {}
            names = []
        return out
    for a, b in s.pieces(*f.params, ","):
        while s.at(a) in ("mut", "public", "private", "protected", "readonly", "...", "@"):
            a += 1
        colon = s.find(a, b, ":")
        name = colon - 1 if s.at(colon - 1) == "?" else colon
        if colon < b and s.is_word(a) and name - (s.at(colon - 1) == "?") >= a and (colon == a + 1 or s.at(a + 1) == "?"):
            kind = telling(s, colon + 1, s.find(colon, b, "="))
            if kind:
                out[s.text[a]] = kind
    return out


# --- items -------------------------------------------------------------------------


class Reader:
    """Reads a file's items: its functions and the symbols by which calls are resolved."""

    def __init__(self, lang: str, file: str, text: str):
        self.lang, self.file, self.s = lang, file, Source(lang, text, file.endswith(".tsx"))
        self.sep, self.module = SEPARATOR[lang], module_of(lang, file)
        self.functions: list[Function] = []
        self.symbols: list[tuple[str, str | None, str, str]] = []  # kind, owner, name, target
        {"rust": self.rust, "go": self.go, "typescript": self.typescript}[lang](0, len(self.s))

    def symbol(self, kind: str, name: str, target: str, owner: str | None = None) -> None:
        self.symbols.append((kind, owner, name, target))

    def field(self, owner: str, name: str, a: int, b: int) -> None:
        kind = telling(self.s, a, b)
        if kind:
            self.symbol("field", name, kind, owner)

    # rust

    def rust(self, k: int, end: int, prefix: str = "", owner: str | None = None, bodies: bool = False) -> None:
        s, attributes = self.s, []
        while k < end:
            first = k
            if s.at(k) == "#":
                k = s.after(k + 1 if s.at(k + 1) == "[" else k + 2)
                attributes.append(s.between(first, k - 1))
                continue
            while s.at(k) in ("pub", "async", "const", "unsafe", "extern", "default") or s.kind[k] == "string":
                if s.at(k) == "const" and s.at(k + 1) not in ("fn", "async", "unsafe", "extern"):
                    break
                k = s.after(k + 1) if s.at(k) == "pub" and s.at(k + 1) == "(" else k + 1
                if k >= end:
                    return
            word = s.at(k)
            if word == "fn":
                k = self.rust_function(first, k, prefix, owner, tuple(attributes), bodies)
            elif word == "use":
                stop = s.find(k, end, ";")
                self.rust_use(k + 1, stop, "")
                k = stop + 1
            elif word in ("struct", "enum", "trait", "mod") or word == "union" and s.is_word(k + 1):
                name, stop = s.at(k + 1), s.find(s.past_angles(k + 2), end, "{", ";")
                inside = (stop + 1, s.match.get(stop, stop + 1))
                if word == "mod":
                    if s.at(stop) == "{":
                        self.rust(*inside, prefix=f"{prefix}{name}::")
                else:
                    self.symbol("type", name, "")
                    if word == "trait" and s.at(stop) == "{":
                        self.rust(*inside, prefix=prefix, owner=name, bodies=True)
                    elif word in ("struct", "union") and s.at(stop) == "{":
                        for a, b in s.pieces(*inside, ","):
                            while s.at(a) == "#":
                                a = s.after(a + 1)
                            a = s.after(a + 1) if s.at(a) == "pub" and s.at(a + 1) == "(" else a + (s.at(a) == "pub")
                            if s.at(a + 1) == ":":
                                self.field(name, s.text[a], a + 2, b)
                k = s.after(stop)
            elif word == "impl":
                at = s.past_angles(k + 1)
                stop = s.find(at, end, "{", ";")
                limit = s.find(at, stop, "where")
                fors = [j for j in range(at, limit) if s.at(j) == "for" and s.at(j + 1) != "<"]
                name = core_type(s, fors[0] + 1 if fors else at, limit)
                if name and s.at(stop) == "{":
                    self.rust(stop + 1, s.match.get(stop, end), prefix=prefix, owner=name)
                k = s.after(stop)
            else:
                stop = s.find(k, end, ";", "{")
                k = s.after(stop)
            attributes = []

    def rust_function(self, first: int, k: int, prefix: str, owner: str | None, attributes: tuple[str, ...], bodies: bool) -> int:
        s = self.s
        opening = s.past_angles(k + 2)
        closing = s.match.get(opening, opening)
        stop = s.find(closing + 1, len(s), "{", ";")
        end = s.match.get(stop, stop) if s.at(stop) == "{" else min(stop, len(s) - 1)
        if not s.is_word(k + 1) or s.at(opening) != "(" or bodies and s.at(stop) != "{":
            return s.after(stop)
        own = next(s.pieces(opening + 1, closing, ","), (0, 0))
        head = s.find(closing + 1, stop, "where")
        is_async = any(s.at(j) == "async" for j in range(first, k))
        returns = f" -> {s.between(closing + 2, head - 1)}" if s.at(closing + 1) == "->" and head > closing + 2 else ""
        f = Function(
            s.text[k + 1], first, end, (opening + 1, closing), (stop + 1, end) if s.at(stop) == "{" else None, owner, prefix, is_async,
            owner is not None and any(s.at(j) == "self" for j in range(*own)), attributes, "self", f"{'async ' if is_async else ''}fn {s.text[k + 1]}{s.between(opening, closing)}{returns}",
        )
        self.functions.append(f)
        self.symbol("method" if owner else "free", f.name, "", owner)
        return end + 1

    def rust_use(self, a: int, b: int, base: str) -> None:
        s = self.s
        for first, last in s.pieces(a, b, ","):
            brace = s.find(first, last, "{")
            if brace < last:
                self.rust_use(brace + 1, s.match.get(brace, last), base + "".join(s.text[first:brace]))
                continue
            alias = s.find(first, last, "as")
            path = base + "".join(s.text[first:alias])
            if not path.endswith(("*", "::self")):
                local = s.at(alias + 1) if alias < last else path.split("::")[-1]
                self.symbol("import", local, path)

    # go

    def go(self, k: int, end: int) -> None:
        s = self.s
        while k < end:
            word = s.at(k)
            if word == "import":
                grouped = s.at(k + 1) == "("
                stop = s.match.get(k + 1, end) if grouped else k + 4
                for j in range(k + 1, min(stop, end)):
                    if s.kind[j] == "string" and (grouped or j <= k + 2):
                        path = s.text[j].strip('"`')
                        named = s.line[j - 1] == s.line[j] and j - 1 > k and (s.is_word(j - 1) or s.at(j - 1) in (".", "_"))
                        self.symbol("import", s.text[j - 1] if named else path.split("/")[-1], path)
                k = s.after(k + 1) if grouped else k + 2 + (s.kind[min(k + 1, end - 1)] != "string")
            elif word == "type":
                grouped = s.at(k + 1) == "("
                j, stop = (k + 2, s.match.get(k + 1, end)) if grouped else (k + 1, end)
                while j < stop and s.is_word(j):
                    j = self.go_type(j, stop)
                    if not grouped:
                        break
                k = stop + 1 if grouped else j
            elif word == "func":
                k = self.go_function(k)
            else:
                k = s.after(k)

    def line_end(self, k: int, end: int) -> int:
        """The first token of a later line, brackets skipped."""
        s, last = self.s, k
        while k < end and s.line[k] == s.end_line(last):
            last = s.match.get(k, k) if s.at(k) in _CLOSING else k
            k = last + 1
        return k

    def go_type(self, k: int, end: int) -> int:
        s, name = self.s, self.s.text[k]
        self.symbol("type", name, "")
        stop = self.line_end(k, end)
        brace = next((j for j in range(k + 1, stop) if s.at(j) == "struct" and s.at(j + 1) == "{"), None)
        if brace is not None and s.at(k + 1) in ("struct", "["):
            j, last = brace + 2, s.match.get(brace + 1, end)
            while j < last:
                after = min(self.line_end(j, last), s.find(j, last, ";"))
                names = [j]
                while s.at(names[-1] + 1) == "," and s.is_word(names[-1] + 2):
                    names.append(names[-1] + 2)
                kind = names[-1] + 1
                until = next((x for x in range(kind, after) if s.kind[x] == "string"), after)
                if until > kind and s.at(kind) != "." and s.is_word(j):
                    for x in names:
                        self.field(name, s.text[x], kind, until)
                j = after + (s.at(after) == ";")
        return stop

    def go_function(self, k: int) -> int:
        s, first, owner, me = self.s, k, None, None
        k += 1
        if s.at(k) == "(":
            closing = s.match.get(k, k)
            named = s.is_word(k + 1) and s.at(k + 2) not in (".", ")", "[")
            me = s.text[k + 1] if named else None
            angle = s.find(k + 1 + named, closing, "[")  # type parameters of the receiver
            owner = core_type(s, k + 1 + named, angle if angle > k + 1 + named else closing)
            k = closing + 1
            if not owner:
                return k
        name = k
        k = s.after(k + 1) if s.at(k + 1) == "[" else k + 1
        if not s.is_word(name) or s.at(k) != "(":
            return k
        closing = s.match.get(k, k)
        stop = closing + 1
        while stop < len(s) and s.line[stop] == s.end_line(stop - 1) and s.at(stop) != "{":
            stop = s.after(stop + 1) if s.at(stop) in ("struct", "interface") and s.at(stop + 1) == "{" else s.after(stop)
        body = (stop + 1, s.match.get(stop, len(s) - 1)) if s.at(stop) == "{" and s.line[stop] == s.end_line(stop - 1) else None
        f = Function(s.text[name], first, body[1] if body else stop - 1, (k + 1, closing), body, owner, "", False, owner is not None, (), me)
        f.signature = s.between(first, stop - 1)[:200]
        self.functions.append(f)
        self.symbol("method" if owner else "free", f.name, "", owner)
        return f.last + 1

    # typescript

    def typescript(self, k: int, end: int) -> None:
        s, decorators = self.s, []
        while k < end:
            first = k
            if s.at(k).startswith("@") and len(s.at(k)) > 1:
                k = s.after(k + 1) if s.at(k + 1) == "(" else k + 1
                decorators.append(s.between(first, k - 1))
                continue
            while s.at(k) in ("export", "default", "declare", "abstract", "async"):
                k += 1
            word = s.at(k)
            if word == "import":
                k = self.typescript_import(k)
            elif word == "function" and s.is_word(k + 1 + (s.at(k + 1) == "*")):
                name = k + 1 + (s.at(k + 1) == "*")
                begin = first
                while s.at(begin) in ("export", "default", "declare"):
                    begin += 1
                k = self.typescript_function(begin, name, s.past_angles(name + 1), None, tuple(decorators))
            elif word == "class" and s.is_word(k + 1):
                stop = s.find(s.past_angles(k + 2), end, "{")
                self.symbol("type", s.text[k + 1], "")
                self.typescript_class(s.text[k + 1], stop + 1, s.match.get(stop, end))
                k = s.after(stop)
            elif word in ("const", "let", "var") and s.is_word(k + 1):
                stop = self.statement_end(k, end)
                for a, b in s.pieces(k + 1, stop, ","):
                    self.typescript_value(a, a, b, None, ())
                k = stop
            else:
                k = s.after(k)
            decorators = []

    def statement_end(self, k: int, end: int) -> int:
        """Where a statement ends: its semicolon, or a line break after which no operator goes on."""
        s = self.s
        while k < end:
            if s.at(k) == ";":
                return k + 1
            k = s.after(k)
            going = ("=", "=>", ":", ",", ".", "?", "+", "-", "*", "/", "&&", "||", "|", "&", "??", "(", "[", "<", "?.")
            if k < end and s.line[k] > s.end_line(k - 1) and s.at(k - 1) not in going and s.at(k) not in going[:-3] and s.at(k) not in ("(", "[", "{", ";"):
                return k
        return k

    def typescript_import(self, k: int) -> int:
        s = self.s
        j, names, space = k + 1, [], None
        while j < len(s) and s.kind[j] != "string" and s.at(j) != ";":
            if s.at(j) == "{":
                names += s.pieces(j + 1, s.match.get(j, j + 1), ",")
            elif s.at(j) == "*" and s.at(j + 1) == "as":
                space = s.at(j + 2)
            j = s.after(j)
        if j < len(s) and s.kind[j] == "string":
            source = s.text[j].strip("\"'")
            for a, b in names:
                a += s.at(a) == "type" and b - a > 1 and s.at(a + 1) != "as"
                self.symbol("import", s.text[b - 1], f"{source}::{s.text[a]}")
            if space:
                self.symbol("import", space, source)
        return j + 1

    def typescript_function(self, first: int, name: int, opening: int, owner: str | None, decorators: tuple[str, ...]) -> int:
        """A function or method whose parameters open at `opening`."""
        s = self.s
        closing = s.match.get(opening, opening)
        stop = closing + 1
        if s.at(stop) == ":":
            stop += 1
            while stop < len(s) and s.at(stop) not in ("{", ";") or s.at(stop) == "{" and s.at(stop - 1) in (":", "|", "&", "=>", "is"):
                stop = s.past_angles(stop) if s.at(stop) == "<" else s.after(stop)
        if s.at(stop) != "{":
            return self.statement_end(stop, len(s))  # a declaration without a body
        end = s.match.get(stop, len(s) - 1)
        self.typescript_made(s.text[name], first, end, (opening + 1, closing), (stop + 1, end), owner, any(s.at(j) == "async" for j in range(first, name)), decorators, stop)
        return end + 1

    def typescript_made(self, name: str, first: int, last: int, params: tuple[int, int], body: tuple[int, int], owner: str | None, is_async: bool, decorators: tuple[str, ...], until: int) -> None:
        s = self.s
        f = Function(name, first, last, params, body, owner, "", is_async, owner is not None, decorators, "this")
        f.signature = s.source[s.start[first] : s.start[until]].strip()[:200]
        self.functions.append(f)
        self.symbol("method" if owner else "free", name, "", owner)

    def typescript_value(self, first: int, name: int, end: int, owner: str | None, decorators: tuple[str, ...]) -> bool:
        """Whether a name's value is a function, which is then recorded."""
        s = self.s
        equals = s.find(name, end, "=")
        k = equals + 1
        if equals >= end:
            return False
        is_async = s.at(k) == "async"
        k = s.past_angles(k + is_async)
        if s.at(k) == "function":
            opening = s.find(k, end, "(")
            stop = s.find(opening, end, "{")
            params = (opening + 1, s.match.get(opening, opening + 1))
        else:
            params = (k + 1, s.match.get(k, k + 1)) if s.at(k) == "(" else (k, k + 1)
            arrow = s.find(k if s.at(k) == "(" else k + 1, end, "=>")
            if arrow >= end or s.at(k) != "(" and not s.is_word(k) or s.at(k) != "(" and arrow != k + 1:
                return False
            stop = arrow + 1
        if stop >= end:
            return False
        last = s.match.get(stop, end - 1) if s.at(stop) == "{" else end - 1 - (s.at(end - 1) == ";")
        body = (stop + 1, last) if s.at(stop) == "{" else (stop, last + 1)
        self.typescript_made(s.text[name], first, last, params, body, owner, is_async, decorators, stop)
        return True

    def typescript_class(self, cls: str, k: int, end: int) -> None:
        s, decorators = self.s, []
        while k < end:
            first = k
            if s.at(k).startswith("@") and len(s.at(k)) > 1:
                k = s.after(k + 1) if s.at(k + 1) == "(" else k + 1
                decorators.append(s.between(first, k - 1))
                continue
            modifiers = ("public", "private", "protected", "static", "readonly", "async", "abstract", "override", "declare", "get", "set", "*")
            while s.at(k) in modifiers and s.at(k + 1) not in ("(", "=", ":", ";", "<"):
                k += 1
            opening = s.past_angles(k + 1 + (s.at(k + 1) in ("?", "!")))
            if s.is_word(k) and s.at(opening) == "(":
                if s.at(k) == "constructor":
                    for name, kind in param_types(s, Function("", k, k, (opening + 1, s.match.get(opening, opening + 1)), None)).items():
                        self.symbol("field", name, kind, cls)
                k = self.typescript_function(first, k, opening, cls, tuple(decorators))
            elif s.is_word(k):
                stop = min(self.statement_end(k, end), end)
                if not self.typescript_value(first, k, stop, cls, tuple(decorators)):
                    colon = k + 1 + (s.at(k + 1) in ("?", "!"))
                    if s.at(colon) == ":":
                        self.field(cls, s.text[k], colon + 1, min(s.find(colon, stop, "=", ";"), stop))
                k = stop
            else:
                k = s.after(k)
            decorators = []


# --- bodies ------------------------------------------------------------------------


def own_attributes(s: Source, f: Function) -> tuple[list[str], list[str]]:
    """Attributes of the own object that a body reads, and those that it assigns."""
    read, written = set(), set()
    if f.body and f.owner and f.me and f.is_method:
        for k in range(*f.body):
            if s.at(k) == f.me and s.at(k - 1) not in (".", "::") and s.at(k + 1) in (".", "?.") and s.is_word(k + 2):
                read.add(s.text[k + 2])
                after = k + 3
                while s.lang == "go" and s.at(after) == "," and s.is_word(after + 1):
                    after = s.find(after + 1, f.body[1], ",", "=", ";", "{")
                if s.at(after) in _ASSIGNS:
                    written.add(s.text[k + 2])
    return sorted(read), sorted(written)


def _closure_end(s: Source, k: int, end: int) -> int | None:
    """Where a closure or nested function that starts at k ends; None: none starts there."""
    word = s.at(k)
    if s.lang == "rust":
        if word == "fn" and s.is_word(k + 1):
            stop = s.find(k, end, "{", ";")
            return s.after(stop)
        if word in ("|", "||") and (s.at(k - 1) in ("(", ",", "=", "{", "}", ";", "=>", "move", "return", "&&", "[", ":", "else") or k == 0):
            body = k + 1 if word == "||" else s.find(k + 1, end, "|") + 1
            if s.at(body) == "->":
                body = s.find(body, end, "{")
            return s.after(body) if s.at(body) == "{" else s.find(body, end, ",", ";", ")", "]", "}")
    elif s.lang == "go":
        if word == "func":
            return s.after(s.find(k, end, "{"))
    else:
        if word == "function":
            return s.after(s.find(k, end, "{"))
        if word == "=>":
            return s.after(k + 1) if s.at(k + 1) == "{" else s.find(k + 1, end, ",", ";", ")", "]", "}")
    return None


def _patterns(s: Source, a: int, b: int) -> set[int]:
    """Tokens of a Rust body that are patterns, in which brackets call nothing."""
    out: set[int] = set()
    for k in range(a, b):
        if s.at(k) == "let" or s.at(k) == "for" and s.at(k + 1) != "<":
            out |= set(range(k, s.find(k + 1, b, "=", ";", "in", ":")))
        elif s.at(k) == "match":
            j = s.find(k + 1, b, "{") + 1
            stop = s.match.get(j - 1, b)
            while j < stop:
                arrow = s.find(j, stop, "=>")
                out |= set(range(j, s.find(j, arrow, "if")))
                j = s.after(arrow + 1) if s.at(arrow + 1) == "{" else s.find(arrow + 1, stop, ",")
                j += s.at(j) == ","
    return out


def _chain_start(s: Source, k: int, first: int) -> int:
    """The first token of the expression of names, calls and members that ends at k."""
    while k >= first:
        if s.at(k) in (")", "]") and k in s.match:
            k = s.match[k]
            if s.is_word(k - 1) and s.at(k - 1) not in KEYWORDS[s.lang] or s.at(k - 1) in (")", "]", "?", "!", ">"):
                k -= 1
                continue
            return k
        if s.at(k) in ("?", "!"):
            k -= 1
            continue
        if s.at(k) == ">":  # generic arguments
            depth = 0
            while k >= first:
                depth += (s.at(k) == ">") - (s.at(k) == "<")
                k -= 1
                if depth == 0:
                    break
            k -= s.at(k) == "::"
            continue
        if s.at(k - 1) in (".", "::", "?.") and k - 1 > first:
            k -= 2
            continue
        return k
    return first


def calls_of(s: Source, f: Function) -> list[dict]:
    """The calls of a body in source order, an outer one before those in its arguments."""
    if not f.body:
        return []
    a, b = f.body
    patterns = _patterns(s, a, b) if s.lang == "rust" else set()
    found, k = [], a
    skip: list[tuple[int, int]] = []  # scopes of their own
    if s.lang == "typescript":
        for j in range(a, b):
            if s.at(j) == "=>":
                skip.append((j, _closure_end(s, j, b) or j))
    while k < b:
        inner = _closure_end(s, k, b) if s.at(k) != "=>" or s.lang == "typescript" else None
        if inner is not None:
            k = max(inner, k + 1)
            continue
        if s.lang == "rust" and s.at(k) == "#" and s.at(k + 1) == "[":
            k = s.after(k + 1)
            continue
        if s.lang == "rust" and s.is_word(k) and s.at(k + 1) == "!" and s.at(k + 2) in _CLOSING and k not in patterns:
            first = k
            while s.at(first - 1) == "::" and s.is_word(first - 2):
                first -= 2
            name, last = "".join(s.text[first : k + 1]), s.match.get(k + 2, k + 2)
            found.append((s.start[first], -last, {"form": "macro", "head": None, "name": name, "raw": name[:80], "line": s.line[first], "is_await": s.at(last + 1) == "." and s.at(last + 2) == "await"}))
            k = last + 1
            continue
        tagged = s.lang == "typescript" and s.kind[k] == "string" and s.text[k].startswith("`") and k > a and s.is_word(k - 1) and s.start[k - 1] + len(s.text[k - 1]) == s.start[k]
        if (s.at(k) == "(" or tagged) and k > a and k - 1 not in patterns:
            call = _call(s, f, k, a)
            if call:
                found.append(call)
        k += 1
    return [c for _, _, c in sorted(found, key=lambda c: c[:2])]


def _call(s: Source, f: Function, k: int, first: int) -> tuple[int, int, dict] | None:
    """The call whose arguments open at k: (start, -end, form); None if these brackets call nothing."""
    name = k - 1
    if s.lang == "typescript" and s.at(name) == ">" and _opens_generic(s, name) is not None:
        name = _opens_generic(s, name) - 1  # type arguments of a call
    generic = s.at(name) == ">" and s.lang == "rust"
    word = s.is_word(name) and s.text[name] not in KEYWORDS[s.lang]
    if not word and not generic and s.at(name) not in (")", "]"):
        return None
    if generic and (s.at(_chain_start(s, name, first)) in KEYWORDS["rust"] or "::" not in s.text[_chain_start(s, name, first) : name]):
        return None
    if s.lang == "typescript" and s.at(_chain_start(s, name, first) - 1) == "new":
        return None
    last = s.match.get(k, k)
    if s.lang == "typescript" and s.at(last + 1) == "=>":
        return None  # parameters of an arrow function
    if s.at(name) in (")", "]") and not word and (s.match.get(name) is None or not (s.is_word(s.match[name] - 1) or s.at(s.match[name] - 1) in (")", "]")) or s.at(s.match[name] - 1) in KEYWORDS[s.lang]):
        if s.lang != "typescript" or s.at(s.match.get(name, 0)) != "(":
            return None
    start = _chain_start(s, name, first)
    raw = s.between(start, name)
    tokens = [s.text[j] for j in range(start, name + 1)]
    dots = [t if t != "?." else "." for t in tokens]
    form: dict = {"form": "other", "head": None, "name": raw[:80]}
    if word and len(tokens) == 1:
        form = {"form": "bare", "head": None, "name": tokens[0]}
    elif word and set(dots[1::2]) == {"::"} and all(s.is_word(j) for j in range(start, name + 1, 2)):
        form = {"form": "path", "head": "::".join(tokens[:-2:2]), "name": tokens[-1]}
    elif word and set(dots[1::2]) == {"."} and all(s.is_word(j) for j in range(start, name + 1, 2)):
        mine = f.me is not None and tokens[0] == f.me and f.owner is not None
        if len(tokens) == 3:
            form = {"form": "self" if mine else "member", "head": tokens[0], "name": tokens[2]}
        elif len(tokens) == 5 and mine:
            form = {"form": "self_attr", "head": tokens[2], "name": tokens[4]}
    awaited = s.at(last + 1) == "." and s.at(last + 2) == "await" if s.lang == "rust" else s.lang == "typescript" and s.at(start - 1) == "await"
    return s.start[start], -last, {**form, "raw": raw[:80], "line": s.line[start], "is_await": awaited}


def _opens_generic(s: Source, k: int) -> int | None:
    """Where type arguments that close at k open; None if the mark is no bracket."""
    depth = 0
    for j in range(k, max(-1, k - 64), -1):
        depth += (s.at(j) == ">") - (s.at(j) == "<")
        if depth == 0:
            return j if s.is_word(j - 1) else None
        if s.at(j) in (";", "{", "}", "(", ")", "&&", "||"):
            return None
    return None


# --- records -----------------------------------------------------------------------


def module_of(lang: str, file: str) -> str:
    """Module of a file: slashes become the language's separator; Rust drops mod, lib and main."""
    stem = next((file.removesuffix(e) for e in EXTENSIONS[lang] if file.endswith(e)), file)
    parts = stem.split("/")
    if lang == "rust":
        return "::".join(p for p in parts if p not in ("", "mod", "lib", "main")) or "::".join(parts)
    return ".".join(parts)


def records(lang: str, file: str, text: str, kinds: Collection[str] | None = None) -> list[dict]:
    """All records of a file: kinds function, call, free, method, type, field, import; of some kinds only those, less being read for them."""
    reader = Reader(lang, file, text)
    told, called = kinds is None or "function" in kinds, kinds is None or "call" in kinds
    s, base = reader.s, {"lang": lang, "file": file, "module": reader.module}
    out = [{**base, "kind": kind, "owner": owner, "name": name, "target": target} for kind, owner, name, target in reader.symbols]
    for f in reader.functions if told or called else ():
        cls = f"{f.prefix}{f.owner}" if f.owner else None
        qualname = f"{cls}{reader.sep}{f.name}" if cls else f"{f.prefix}{f.name}"
        ident, types = f"{reader.module}{reader.sep}{qualname}", param_types(s, f)
        if told:
            read, written = own_attributes(s, f)
            out.append(
                {
                    **base, "kind": "function", "id": ident, "name": f.name, "qualname": qualname, "class_name": cls, "owner": f.owner, "line_start": s.line[f.first], "line_end": s.end_line(f.last),
                    "signature": f.signature, "is_async": f.is_async, "is_method": f.is_method, "decorators": list(f.decorators), "used_self_attrs_read": read, "used_self_attrs_written": written, "params_types": types,
                }
            )
        if called:
            out += [{**base, "kind": "call", "id": ident, "class_name": cls, "owner": f.owner, "params_types": types, **c} for c in calls_of(s, f)]
    return out if kinds is None else [r for r in out if r["kind"] in kinds]


def balanced(lang: str, text: str, jsx: bool = False) -> bool:
    """Whether all brackets have partners."""
    s = Source(lang, text, jsx)
    return all(k in s.match for k in range(len(s)) if s.kind[k] == "mark" and s.text[k] in ("(", ")", "[", "]", "{", "}", "${"))


def spans(lang: str, text: str, name: str) -> list[tuple[int, int]]:
    """Line spans of the statements and blocks in the body of the first function with that last name (EX-X2)."""
    reader = Reader(lang, "x", text)
    s, leaf = reader.s, re.split(r"::|\.", name)[-1]
    f = next((f for f in reader.functions if f.name == leaf and f.body), None)
    out: set[tuple[int, int]] = set()

    def block(a: int, b: int) -> None:
        first = k = a
        while k < b:
            if s.at(k) == "{" and k in s.match:
                block(k + 1, s.match[k])
            nested = s.at(k) == "{"
            k = s.after(k)
            stop = s.at(k - 1) == ";" or nested and s.at(k) not in ("else", ".", "?", ",", ")") or s.lang != "rust" and k < b and s.line[k] > s.end_line(k - 1) and s.at(k - 1) not in (",", "(", "=", "+", ".") and s.at(k) != "."
            if stop or k >= b:
                out.add((s.line[first], s.end_line(min(k, b) - 1)))
                first = k

    if f:
        block(*f.body)
    return sorted(out)


#: Arrow types of the records' columns
ARROW = {
    "string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string()),
}
BATCH = 10_000  # records of an Arrow batch, but for those of its last file


def spread(files: DataFrame) -> DataFrame:
    """Files dealt out by name: a table of few bytes is one task otherwise, however long its files take to read."""
    spark = files.sparkSession
    return files.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), "file")


def mapped(files: DataFrame, columns: list[str], schema: str, found: Callable[..., list[dict]]) -> DataFrame:
    """Records that `found` gives of each file's columns, the file's `ord` last; rows have file_ord and ord besides."""
    schema = f"{schema}, file_ord long, ord long"
    kinds = pa.schema([(p.split()[0], ARROW[p.split()[1]]) for p in re.split(r",\s*(?![^<]*>)", schema)])

    def batch(rows: list[dict]) -> pa.RecordBatch:
        for r in rows:
            if r.get("params_types") is not None:
                r["params_types"] = list(r["params_types"].items())
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in kinds], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for b in batches:
            for *parts, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [{**r, "file_ord": at, "ord": k} for k, r in enumerate(found(*parts))]
                if len(rows) >= BATCH:
                    yield batch(rows)
                    rows = []
        yield batch(rows)

    return spread(files.select(*columns, "ord")).mapInArrow(run, schema)


def extract(files: DataFrame, kinds: Collection[str] | None = None) -> DataFrame:
    """Records of files (lang, file, source, ord) in the three languages, of all kinds or the named ones; others give none.

    Rows carry file_ord and ord, their order in all that are given.  A null source is an empty file.
    """

    def found(lang: str, file: str, source: str | None) -> list[dict]:
        if lang not in SEPARATOR:
            return []
        try:
            return records(lang, file, source or "", kinds)
        except (IndexError, KeyError, ValueError, RecursionError) as e:
            return [{"kind": "error", "lang": lang, "file": file, "raw": f"{type(e).__name__}: {e}"[:200]}] if kinds is None or "error" in kinds else []

    return mapped(files, ["lang", "file", "source"], RECORDS, found)
