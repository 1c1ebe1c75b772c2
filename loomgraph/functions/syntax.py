"""The syntax gate of Rust, Go and TypeScript (EX-X4): a recogniser with recovery.

Tokens are read once.  Words that open an item are followed through a table of what must
come after them; elsewhere operators are checked by their binding: one that only joins two
operands needs one on each side.  After an error reading goes on behind the next semicolon
or brace, so that all errors of a file are told.  What macros hold is not read, and what
the rules don't know is taken to be right.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from .static_source import KEYWORDS, Source, _CLOSING

#: fixed values: operators that stand between two operands and nowhere else
BINARY = {
    "rust": frozenset("/ % ^ == != <= >= += -= *= /= %= ^= &= |=".split()) | {"="},
    "go": frozenset("/ % == != <= >= += -= *= /= %= ^= &= |= := && ||".split()) | {"="},
    "typescript": frozenset("% ^ == != === !== <= >= += -= *= /= %= ^= &= |= && || ?? **".split()) | {"=", "/"},
}
#: what no operator can follow: openings, separators, other operators
_NO_LEFT = frozenset("( [ { , ; ${ => -> :: . ?. + - * / % ^ == != === !== <= >= += -= *= /= %= ^= &= |= := = && || ?? ~".split())
_NO_RIGHT = frozenset(") ] } , ;".split())


def errors(lang: str, text: str, jsx: bool = False) -> list[tuple[int, str]]:
    """(line, what is wrong) of a source text; none where it can be read."""
    s = Source(lang, text, jsx)
    found = [(s.line[k], f"{s.text[k]} without a partner") for k in range(len(s)) if s.kind[k] == "mark" and (s.text[k] in _CLOSING or s.text[k] in ")]}") and k not in s.match]
    found += _quotes(s)
    hidden = _macros(s) if lang == "rust" else set()
    k = 0
    while k < len(s):
        if k in hidden:
            k += 1
            continue
        rule = _RULES[lang].get(s.at(k)) if _opens(s, k) else None
        wrong = rule(s, k) if rule else None
        if wrong is None:
            wrong = _operator(s, k, hidden)
        if wrong:
            found.append((s.line[k], wrong))
            while k < len(s) and s.at(k) not in (";", "{", "}"):
                k += 1
        k += 1
    return sorted(set(found))


def _opens(s: Source, k: int) -> bool:
    """Whether a word may open an item here: it is no member, key or name."""
    if not s.is_word(k) or s.at(k - 1) in (".", "?.", "::", "#", "fn", "func", "function") and k:
        return False
    return not (s.lang == "typescript" and (s.at(k + 1) in (":", "=", ",", "?", ")", "]", "}", ".", ";", "=>") or s.at(k + 1) == "(" and s.at(k) != "function"))


def _quotes(s: Source) -> Iterator[tuple[int, str]]:
    """Marks that are quotes: strings that don't end."""
    for k in range(len(s)):
        if s.kind[k] == "mark" and s.text[k] in ("\"", "'", "`"):
            yield s.line[k], "a string without an end"


def _macros(s: Source) -> set[int]:
    """Tokens inside Rust macros and attributes."""
    out: set[int] = set()
    for k in range(len(s)):
        at = k + 2 if s.at(k) == "!" and s.is_word(k - 1) and s.at(k + 1) not in _CLOSING and s.is_word(k + 1) else k + 1
        if (s.at(k) == "!" and s.is_word(k - 1) or s.at(k) == "#") and s.at(at) in _CLOSING and at in s.match:
            out |= set(range(at + 1, s.match[at]))
    return out


def _operator(s: Source, k: int, hidden: set[int]) -> str | None:
    t = s.at(k)
    if s.kind[k] != "mark" or t not in BINARY[s.lang]:
        return None
    left, right = s.at(k - 1) if k else ";", s.at(k + 1) if k + 1 < len(s) else ";"
    left_is_token = k > 0 and s.kind[k - 1] != "string"
    if left in ("+", "-") and s.at(k - 2) == left and s.start[k - 1] == s.start[k - 2] + 1:
        return None  # a++ and a--
    after_word = left_is_token and s.is_word(k - 1) and left in ("let", "const", "var", "return", "if", "while", "match", "in", "mut", "case") and (s.lang != "typescript" or s.at(k - 2) not in (".", "?."))
    if left_is_token and left in _NO_LEFT or after_word or not k:
        return f"{t} without a left side"
    if k + 1 >= len(s) or s.kind[k + 1] != "string" and (right in _NO_RIGHT or right in BINARY[s.lang] and right != "/"):
        return f"{t} without a right side"
    return None


def _bracketed(s: Source, k: int, opening: str) -> int | None:
    """The token after a bracket that opens at k, or None."""
    return s.match[k] + 1 if s.at(k) == opening and k in s.match else None


def _named(s: Source, k: int) -> bool:
    return s.is_word(k) and (s.text[k] not in KEYWORDS[s.lang] or s.lang == "typescript" and s.text[k] in ("of", "as"))


# what must follow the words that open items -----------------------------------------


def _rust_fn(s: Source, k: int) -> str | None:
    if s.at(k + 1) == "(":  # a type
        return None
    if not _named(s, k + 1):
        return "fn without a name"
    after = _bracketed(s, s.past_angles(k + 2), "(")
    if after is None:
        return "fn without parameters"
    stop = s.find(after, len(s), "{", ";", "}")
    return None if s.at(after) in ("{", ";", "->", "where") and s.at(stop) in ("{", ";") else "fn without a body"


def _rust_let(s: Source, k: int) -> str | None:
    if s.at(k + 1) in ("=", ";", ":", ")", "}") or k + 1 >= len(s):
        return "let without a pattern"
    if s.at(k - 1) in ("if", "while", "&&", "("):
        return None
    stop = s.find(k + 1, len(s), ";", "}")
    return None if s.at(stop) == ";" else "let without an end"


def _rust_named(s: Source, k: int) -> str | None:
    if s.at(k) == "union" and not s.is_word(k + 1):
        return None
    if not _named(s, k + 1):
        return f"{s.at(k)} without a name"
    stop = s.find(s.past_angles(k + 2), len(s), "{", ";", "(", "}")
    return None if s.at(stop) in ("{", ";", "(") else f"{s.at(k)} without a body"


def _rust_impl(s: Source, k: int) -> str | None:
    if k and s.at(k - 1) not in ("}", ";", "]", "unsafe", "{", "default"):
        return None  # a type
    stop = s.find(s.past_angles(k + 1), len(s), "{", ";", "}")
    return None if s.at(stop) == "{" and stop > k + 1 else "impl without a type or body"


def _rust_use(s: Source, k: int) -> str | None:
    stop = s.find(k + 1, len(s), ";", "}")
    return None if s.at(stop) == ";" and stop > k + 1 else "use without an end"


def _go_func(s: Source, k: int) -> str | None:
    at = k + 1
    if k and s.line[k - 1] == s.line[k] and s.at(k - 1) not in ("}", ";"):
        return None  # a literal or a type
    if s.at(at) == "(":
        at = _bracketed(s, at, "(")
        if at is None:
            return "func without parameters"
        if not _named(s, at) or s.at(at + 1) not in ("(", "["):
            return None  # a literal or a type
    elif not _named(s, at):
        return "func without a name"
    at = s.after(at + 1) if s.at(at + 1) == "[" else at + 1
    return None if _bracketed(s, at, "(") is not None else "func without parameters"


def _go_named(s: Source, k: int) -> str | None:
    return None if s.is_word(k + 1) or s.at(k + 1) == "(" and s.at(k) != "package" or s.at(k) == "type" and s.at(k - 1) == "(" else f"{s.at(k)} without a name"


def _go_import(s: Source, k: int) -> str | None:
    string = lambda j: j < len(s) and s.kind[j] == "string"
    return None if s.at(k + 1) == "(" or string(k + 1) or string(k + 2) else "import without a path"


def _ts_function(s: Source, k: int) -> str | None:
    at = k + 1 + (s.at(k + 1) == "*")
    at += s.is_word(at)
    after = _bracketed(s, s.past_angles(at), "(")
    if after is None:
        return "function without parameters"
    return None if s.at(after) in ("{", ":", ";") or after >= len(s) or s.line[after] > s.line[after - 1] else "function without a body"


def _ts_class(s: Source, k: int) -> str | None:
    stop = s.find(s.past_angles(k + 1 + (s.is_word(k + 1) and s.at(k + 1) not in ("extends", "implements"))), len(s), "{", ";", "}")
    return None if s.at(stop) == "{" else "class without a body"


def _ts_variable(s: Source, k: int) -> str | None:
    if s.at(k) == "const" and s.at(k + 1) == "enum":
        return None
    return None if s.is_word(k + 1) or s.at(k + 1) in ("{", "[") else f"{s.at(k)} without a name"


def _ts_import(s: Source, k: int) -> str | None:
    stop = k + 1
    while stop < len(s) and s.kind[stop] != "string" and s.at(stop) not in (";", "="):
        stop = s.after(stop)
    return None if stop < len(s) and (s.kind[stop] == "string" or s.at(stop) == "=") else "import without a source"


_RULES: dict[str, dict[str, Callable[[Source, int], str | None]]] = {
    "rust": {"fn": _rust_fn, "let": _rust_let, "struct": _rust_named, "enum": _rust_named, "trait": _rust_named, "mod": _rust_named, "union": _rust_named, "impl": _rust_impl, "use": _rust_use},
    "go": {"func": _go_func, "package": _go_named, "type": _go_named, "var": _go_named, "const": _go_named, "import": _go_import},
    "typescript": {"function": _ts_function, "class": _ts_class, "const": _ts_variable, "let": _ts_variable, "var": _ts_variable, "import": _ts_import},
}
