"""License scans by template-markup matching.

A template is the wording of a license or notice, one file each in the folder
`templates`, with two kinds of markup: `[[...]]` holds wording that
may be absent, `{{n}}` stands for up to n words of any kind, `{{a|b}}` for one of
the given words.  Templates are compiled to automata over words: a state is a place
in the template, optional regions are skips, replaceable regions are unrolled loops.
A text place is accepted when all mandatory wording is there, exactly and in order;
for others the share of the mandatory wording that was read before the first departure
is told.

Words are lower-cased runs of letters, digits and bytes beyond ASCII; all words are
hashed in numpy, phrases and the automata's first two words are found by comparing
hashes, and only such places are run through an automaton.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import ALNUM, Words, chunks, word_hash

#: fixed values: phrases and their labels
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
_MARKUP = re.compile(r"\[\[(.*?)\]\]|\{\{(.*?)\}\}|([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)", re.DOTALL)


def templates() -> dict[str, str]:
    """The wording by label."""
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "templates").glob("*.txt"))}


class Automaton:
    """States 0..n-1; edges: (word hashes or None for any word) to the next states; `final` accepts; `read`: mandatory words before each state."""

    def __init__(self, template: str):
        self.steps: list[list[tuple[frozenset[int] | None, int]]] = []
        self.skips: dict[int, set[int]] = {}
        self.read = [0]
        self.final = self._add(template.lower(), 0, 1)
        self.steps.append([])
        self.mandatory = self.read[-1]

    def _step(self, words: frozenset[int] | None, counts: int) -> None:
        self.steps.append([(words, len(self.steps) + 1)])
        self.read.append(self.read[-1] + counts)

    def _add(self, text: str, at: int, counts: int) -> int:
        for optional, replaced, word in _MARKUP.findall(text):
            if optional:
                after = self._add(optional, at, 0)
                self.skips.setdefault(at, set()).add(after)
                at = after
            elif replaced.isdigit():
                for _ in range(int(replaced)):
                    self._step(None, 0)
                end = at + int(replaced)
                for k in range(at, end):
                    self.skips.setdefault(k, set()).add(end)
                at = end
            else:
                self._step(frozenset(word_hash(w) for w in (replaced.split("|") if replaced else [word])), counts)
                at += 1
        return at

    def closure(self, states: set[int]) -> set[int]:
        found, stack = set(states), list(states)
        while stack:
            for s in self.skips.get(stack.pop(), ()):
                if s not in found:
                    found.add(s)
                    stack.append(s)
        return found

    def starts(self) -> list[tuple[frozenset[int], int]]:
        """(hashes, place) of the first mandatory fixed words, place counted from the start; a leading replaceable region is not searched for."""
        return [(words, to) for s in self.closure({0}) for words, to in self.steps[s] if words is not None]

    def run(self, words: list[int]) -> tuple[int, float]:
        """The most words accepted from the first word on, 0 for none, and the share of the mandatory words that was read."""
        states, best = self.closure({0}), 0
        read = max(self.read[s] for s in states)
        for k, w in enumerate(words):
            states = self.closure({to for s in states for accepted, to in self.steps[s] if accepted is None or w in accepted})
            if not states:
                break
            read = max(read, *(self.read[s] for s in states)) if len(states) > 1 else max(read, self.read[next(iter(states))])
            if self.final in states:
                best = k + 1
        return best, 1.0 if best else min(read, self.mandatory - 1) / max(1, self.mandatory)


class Matcher:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [([word_hash(w) for w in p.split()], label) for p, label in phrases.items()]
        self.automata = []
        for label, template in templates.items():
            a = Automaton(template)
            first = {h for words, _ in a.starts() for h in words}
            # the words that may follow a first one, where the template fixes them
            second: set[int] | None = set()
            for s in a.closure({to for _, to in a.starts()}):
                for words, _ in a.steps[s]:
                    second = None if words is None or second is None else second | words
            self.automata.append((label, a, np.array(sorted(first), np.uint64), None if second is None else np.array(sorted(second), np.uint64)))

    def scan(self, words: Words) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int, str]], np.ndarray]:
        """Phrase places (doc, first word in the document, label), accepted template places (doc, first word, words, label), and each document's largest share read."""
        h, n = words.hash, len(words)
        places, accepted, shares = [], [], np.zeros(len(words.first) - 1)
        for phrase, label in self.phrases:
            at = np.flatnonzero(h[: n - len(phrase) + 1] == np.uint64(phrase[0])) if n >= len(phrase) else np.zeros(0, np.int64)
            for k, w in enumerate(phrase[1:], 1):
                at = at[(h[at + k] == np.uint64(w)) & (words.doc[at + k] == words.doc[at])]
            places += [(int(d), int(a), label) for d, a in zip(words.doc[at], at - words.first[words.doc[at]], strict=True)]
        following = np.concatenate([h[1:], np.zeros(1, np.uint64)])
        for label, automaton, first, second in self.automata:
            near = np.isin(h, first) if len(first) > 1 else h == first[0]
            at = np.flatnonzero(near)
            if second is not None:
                at = at[np.isin(following[at], second)]
            longest = 2 * len(automaton.steps)
            for a in at.tolist():
                d = int(words.doc[a])
                size, share = automaton.run(h[a : min(int(words.first[d + 1]), a + longest)].tolist())
                shares[d] = max(shares[d], share)
                if size:
                    accepted.append((d, a - int(words.first[d]), size, label))
        return places, accepted, shares


def _scanned(batches: Iterator[pa.RecordBatch], matcher: Matcher) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        words = Words(batch.column("text"), ALNUM)
        docs = batch.num_rows
        n_words = np.diff(words.first)
        base: list[list] = [[] for _ in range(docs)]
        more: list[list] = [[] for _ in range(docs)]
        places, accepted, shares = matcher.scan(words)
        for d, a, label in places:
            base[d].append((a, label))
        for d, a, size, label in accepted:
            more[d].append((a, size, label))
        join = lambda found: ",".join(sorted(set(found)))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(n_words.astype(np.int64)), pa.array([len(x) for x in base], pa.int64()),
                pa.array([min((a for a, _ in x), default=None) for x in base], pa.int64()),
                pa.array([max((a for a, _ in x), default=None) for x in base], pa.int64()),
                pa.array([join(label for _, label in x) for x in base]),
                pa.array([join([label for _, label in x] + [label for *_, label in y]) for x, y in zip(base, more, strict=True)]),
                pa.array([max(share, 0.5) if x else share for x, share in zip(base, shares.tolist(), strict=True)]),
                pa.array([[{"first": a, "words": s, "label": label} for a, s, label in sorted(y)] for y in more], pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("label", pa.string())]))),
            ],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
        )


def license_scan(docs: DataFrame) -> DataFrame:
    """Phrases and accepted templates of every whole text.

    docs: doc_id, text; other columns are ignored.  A null text is empty.  Result:
    doc_id, n_words, n_base (phrase places), first_word, last_word (least and largest
    start, else null), base_labels, labels, score (the largest share of a template's
    mandatory wording that was read, 1 if it was accepted; 0.5 at least with a phrase)
    and matches, the accepted places; of templates that start alike all are told.
    Repeated rows are scanned each; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(Matcher(PHRASES, templates()))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        lambda it: _scanned(it, sent.value),
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "matches array<struct<first: long, words: long, label: string>>",
    )
