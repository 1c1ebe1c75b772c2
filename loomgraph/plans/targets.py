"""Targets (SC-24, PL-5, PL-7, PL-9): what a code base is, where its artifacts lie, and how it is told to a planner."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from ..sources.discover import LANGUAGES


@dataclass(frozen=True)
class Target:
    """A code base: its language (or auto), globs, skipped directories, and candidate places of its source and handbook."""

    name: str
    language: str = "auto"
    globs: tuple[str, ...] = ()
    ignores: tuple[str, ...] = ()
    places: dict[str, tuple[str, ...]] = field(default_factory=dict)
    facts: dict[str, str] = field(default_factory=dict)

    def extension(self) -> str:
        """PL-9: the extension of the first glob, else that of the language."""
        for g in self.globs:
            stem, dot, ext = g.rpartition(".")
            if dot and ext.isalnum():
                return f".{ext}"
        return LANGUAGES[self.language]["ext"][0] if self.language in LANGUAGES else ".py"


_TARGETS: dict[str, Target] = {}


def put(target: Target) -> Target:
    _TARGETS[target.name] = target
    return target


def target(name: str) -> Target:
    """A registered target; an unknown one is a KeyError that names those there are."""
    if name not in _TARGETS:
        raise KeyError(f"{name}: not one of {', '.join(sorted(_TARGETS))}")
    return _TARGETS[name]


def place(t: Target, what: str, exists: Callable[[str], bool], resolvers: Iterable[Callable[[Target], str | None]] = ()) -> str:
    """SC-24: where something of a target lies: an environment variable LOOMGRAPH_<NAME>_<WHAT> first, then what a resolver tells, then the first candidate that exists."""
    told = os.environ.get(f"LOOMGRAPH_{t.name}_{what}".upper().replace("-", "_"))
    if told:
        return told
    for resolve in resolvers:
        found = resolve(t)
        if found:
            return found
    for candidate in t.places.get(what, ()):
        if exists(candidate):
            return candidate
    raise FileNotFoundError(f"no {what} of {t.name}: {', '.join(t.places.get(what, ())) or 'no candidates'}")


def supported() -> list[str]:
    """PL-9: languages that are discovered."""
    return sorted(LANGUAGES)


def context_block(t: Target) -> str:
    """PL-7: a short text that tells a writer about the code base."""
    lines = [f"Project: {t.name}", f"Language: {t.language}", *(f"{k}: {v}" for k, v in sorted(t.facts.items()) if v)]
    return "\n".join(lines)


def package(layouts: Iterable[dict[str, str]], exists: Callable[[str], bool]) -> dict[str, str]:
    """PL-5: part to path of the first layout all of whose parts exist; an error names what each lacks."""
    lacks = []
    for layout in layouts:
        missing = sorted(part for part, path in layout.items() if not exists(path))
        if not missing:
            return dict(layout)
        lacks.append(", ".join(missing))
    raise FileNotFoundError("no complete layout; missing: " + "; ".join(lacks))
