"""Personal data: fixed patterns, and a semi-Markov conditional random field.

The patterns give the base findings.  Beside them the field looks at what has digits, a
sign or word for `at` and `dot`, or a form of address: the text around becomes tokens,
runs of tokens are candidate segments, and a segment is scored as a whole, by its shape,
digit count, check sums, what stands at its ends and the cue words before it, once for each
type.  A segmentation's score is the sum over its segments and over pairs of successive
types; all tokens outside have none.  Dynamic programming over tokens, with segments of
at most LONGEST tokens, chooses boundaries and types together.

The field is trained here by the likelihood of whole segmentations (forward and backward
sums) on findings made by rule from a fixed seed.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import chunks

#: fixed values: the base kinds in their order, and their patterns; what can't begin inside a run is tried at its start only
BASE = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: types of the field's findings, named model_<type>
TYPES = ("email", "ip", "card", "phone", "id", "iban", "birth", "name")
KINDS = (*BASE, *(f"model_{t}" for t in TYPES))
LONGEST, WIDEST, NEAR = 15, 48, 64  # most tokens and characters of a segment; characters read on both sides
SLOTS = 1 << 15  # rows of the weights
CAUTION = 1.0  # a segment's score is lowered by it, so that it must be likelier than nothing by a factor e
EXAMPLES, EPOCHS = 2400, 4

TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Mme Monsieur Madame Señor Señora Sra"
#: cue words (lower case) and what they are cues of
CUES = {
    w: kind
    for kind, words in {
        "phone": "phone tel telephone call fax mobile cell telefon handy téléphone portable teléfono móvil llame",
        "card": "card visa mastercard amex credit kreditkarte carte tarjeta",
        "id": "ssn social passport national identity tax taxpayer id steuernummer ausweis sécu passeport dni nif pasaporte licence",
        "iban": "iban account konto compte cuenta",
        "birth": "born birth dob birthday geboren geburtsdatum né née naissance nacido nacida nacimiento",
        "email": "email mail write contact",
        "ip": "ip host address client",
        "name": "name " + TITLES.lower(),
        "not": "isbn version order invoice ref sku price total page year build issue serial tracking eur usd",
    }.items()
    for w in words.split()
}
TRIGGER = re.compile(rf"[0-9]{{2}}|@|[\s(\[](?:dot|DOT|punkt|punto|point)[\s)\]]|(?<!\w)(?:{TITLES.replace(' ', '|')})\.? (?=[^\W\d_])|(?<!\w)[Nn]ame(?: is|:) ")
#: a group of hexadecimal digits beside a colon is one token
TOKEN = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{1,4}(?=:)|(?<=:)[0-9a-fA-F]{1,4}(?![0-9A-Za-z])|[0-9]+|[^\W\d_]+|.", re.DOTALL)
_AT, _DOT = {"at", "AT", "@"}, {"dot", "DOT", "punkt", "punto", "point", "."}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' findings, leftmost and not overlapping in each kind, by kind and start."""
    found, end = [], 0
    if "@" in text:
        for m in LOCAL.finditer(text):
            start = max(m.start(), end)
            if start < m.end() - 1 and (d := DOMAIN.match(text, m.end())):
                end = d.end()
                found.append((start, end, "email"))
    found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = re.sub(r"[ -]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


# candidate segments ------------------------------------------------------------------


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Places around what triggers the field, those that touch together."""
    start = end = -1
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - NEAR), min(len(text), m.end() + NEAR)
        if a > end:
            if end >= 0:
                yield start, end
            start = a
        end = b
    if end >= 0:
        yield start, end


def tokens(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text, start, end)]


def _is(token: str) -> str:
    """d digits, a letters, s space, n other white space, p anything else; of digits only ASCII ones."""
    c = token[0]
    return "d" if "0" <= c <= "9" else "a" if c.isalpha() else "s" if c == " " else "n" if c.isspace() else "p"


def segments(toks: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """(first token, token after the last) of the candidate segments, by end: numbers in groups, codes, addresses, names after a form of address."""
    kinds = [_is(t) for _, _, t in toks]
    out = set()
    n = len(toks)
    for i in range(n):
        t = toks[i][2]
        # digits in groups, with hexadecimal and capital ones in codes
        opens = kinds[i] == "d" or (t in "+(" and i + 1 < n and kinds[i + 1] == "d")
        code = kinds[i] == "a" and i + 1 < n and ((len(t) == 2 and t.isupper() and kinds[i + 1] == "d") or (len(t) <= 4 and (kinds[i + 1] == "d" or toks[i + 1][2] == ":")))
        if (opens or code) and not (i and (kinds[i - 1] == "d" or (kinds[i - 1] == "a" and kinds[i] == "d" and len(toks[i - 1][2]) > 4))):
            digits, apart, last_space = 0, 0, False
            for j in range(i, min(n, i + LONGEST)):
                u, k = toks[j][2], kinds[j]
                if k == "n" or toks[j][1] - toks[i][0] > WIDEST or (k == "p" and u not in "+().-/:") or (k == "a" and not (len(u) <= 4 and (u.isupper() or all(c in "0123456789abcdef" for c in u)))):
                    break
                if k in "sp":
                    apart += 1
                    if apart > 2 or (k == "s" and last_space):
                        break
                    last_space = k == "s"
                    continue
                apart, last_space = 0, False
                colon = ":" in ((toks[j + 1][2] if j + 1 < n else ""), (toks[j - 1][2] if j else ""))
                digits += len(u) if k == "d" or colon else 0
                if digits >= 6 and (k == "d" or code or colon) and not (j + 1 < n and kinds[j + 1] in "da"):
                    out.add((i, j + 1))
        # words joined by at and dot
        if t in _AT and i:
            left = i - 1
            while left > 0 and toks[left][2] in " ([":
                left -= 1
            first = left
            while first > 0 and (kinds[first - 1] in "da" or toks[first - 1][2] in "._-+") and toks[i][0] - toks[first - 1][0] < WIDEST:
                first -= 1
            if kinds[left] in "da":
                right, dots = i + 1, 0
                while right < n and right - first < LONGEST + 6 and kinds[right] != "n":
                    u = toks[right][2]
                    if u in _DOT and (u != "." or (t != "at" and right + 1 < n and kinds[right + 1] in "da")):
                        dots += 1
                    elif kinds[right] in "da":
                        before = "".join(x[2] for x in toks[i + 1 : right]).strip(" )]([")
                        if dots and (before.endswith(".") or before.split(" ")[-1].strip("()[]") in _DOT):
                            out.update((s, right + 1) for s in range(max(first, right + 1 - LONGEST), left + 1) if kinds[s] in "da" and toks[right][1] - toks[s][0] <= WIDEST)
                        elif dots:
                            break
                    elif u not in " ()[]-":
                        break
                    right += 1
        # capitalised words after a form of address or `name`
        if kinds[i] == "a" and t[0].isupper() and i >= 2 and toks[i - 1][2] == " ":
            back = i - 2
            while back > 0 and toks[back][2] in ".: ":
                back -= 1
            if CUES.get(toks[back][2].lower()) == "name" or (toks[back][2] == "is" and back >= 2 and toks[back - 2][2].lower() == "name"):
                j = i
                for _ in range(3):
                    out.add((i, j + 1))
                    if j + 2 < n and toks[j + 1][2] == " " and kinds[j + 2] == "a" and toks[j + 2][2][0].isupper():
                        j += 2
                    else:
                        break
    return sorted(out, key=lambda s: (s[1], s[0]))


def features(toks: list[tuple[int, int, str]], i: int, j: int) -> list[int]:
    """Rows of the weights that a whole segment takes."""
    part = [t for _, _, t in toks[i:j]]
    kinds = [_is(t) for t in part]
    whole = "".join(part)
    digits = "".join(t for t, k in zip(part, kinds, strict=True) if k == "d")
    shape = "".join(str(len(t)) if k == "d" else ("A" if t.isupper() else "a") if k == "a" else "_" if k == "s" else t for t, k in zip(part, kinds, strict=True))
    words = [t.lower() for _, _, t in toks[max(0, i - 8) : i] if t[0].isalpha()][-3:]
    cue = next((CUES[w] for w in reversed(words) if w in CUES), "-")
    before, after = (toks[i - 1][2][-1] if i else ""), (toks[j][2][0] if j < len(toks) else "")
    edge = lambda c: "" if not c else _is(c) if c.isalnum() or c.isspace() else c
    apart = "".join(sorted({t for t, k in zip(part, kinds, strict=True) if k not in "da"}))
    groups = kinds.count("d")
    checks = f"{luhn(digits) if digits.isdigit() and len(digits) > 11 else ''}{_iban(whole)}{_date(part, kinds)}"
    named = [
        "bias", f"s{shape}", f"sc{shape}|{cue}", f"c{cue}", f"n{len(digits)}", f"nc{len(digits)}|{cue}", f"g{groups}|{apart}", f"gc{groups}|{cue}|{apart}", f"k{checks}", f"kn{checks}|{len(digits)}|{apart}",
        f"b{edge(before)}", f"a{edge(after)}", f"ba{edge(before)}{edge(after)}|{apart}", f"f{edge(part[0][0])}{edge(part[-1][-1])}", f"l{kinds.count('a')}|{groups > 0}|{apart}", f"w{words[-1] if words and words[-1] in CUES else ''}",
        f"at{any(t in _AT for t in part)}{any(t in _DOT for t in part)}|{sum(t in _DOT for t in part)}", f"x{edge(before)}|{kinds.count('a')}|{edge(after)}|{cue}",
    ]
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) % SLOTS for f in named]


def _iban(whole: str) -> str:
    code = whole.replace(" ", "")
    if not (15 <= len(code) <= 34 and code.isascii() and code.isalnum() and code[:2].isalpha() and code[2:4].isdigit()):
        return "-"
    return str(int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1)


def _date(part: list[str], kinds: list[str]) -> str:
    n = [t for t, k in zip(part, kinds, strict=True) if k == "d"]
    if len(n) != 3 or len(part) != 5 or part[1] != part[3] or part[1] not in "./- ":
        return "-"
    y, *rest = n if len(n[0]) == 4 else n[::-1]
    return str(len(y) in (2, 4) and all(1 <= len(r) <= 2 and 1 <= int(r) <= 31 for r in rest) and min(map(int, rest)) <= 12)


# the field ---------------------------------------------------------------------------


class Field:
    """Weights of segments (a row each feature, a column each type) and of successive types (0: none before)."""

    def __init__(self) -> None:
        self.w = np.zeros((SLOTS, len(TYPES)))
        self.t = np.zeros((len(TYPES) + 1, len(TYPES)))

    def scores(self, rows: np.ndarray, caution: float = 0.0) -> np.ndarray:
        return self.w[rows].sum(1) - caution

    def best(self, ends: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int, int]]:
        """(first token, token after the last, type) of the segmentation of highest score; ends: segments by end."""
        states = [(0, np.r_[0.0, np.full(len(TYPES), -np.inf)], None)]  # place, best score by last type, how it came
        at = lambda place: next(s for s in reversed(states) if s[0] <= place)
        k = 0
        while k < len(ends):
            stop = ends[k][1]
            held = states[-1]
            value, came = held[1].copy(), [(held, y, None) for y in range(len(TYPES) + 1)]
            while k < len(ends) and ends[k][1] == stop:
                start = at(ends[k][0])
                ways = start[1][:, None] + self.t
                last = ways.argmax(0)
                for y in range(len(TYPES)):
                    v = ways[last[y], y] + scores[k, y]
                    if v > value[y + 1]:
                        value[y + 1], came[y + 1] = v, (start, int(last[y]), (*ends[k], y))
                k += 1
            states.append((stop, value, came))
        out, state = [], states[-1]
        y = int(state[1].argmax())
        while state[2] is not None:
            state, y, segment = state[2][y]
            if segment:
                out.append(segment)
        return out[::-1]

    def expected(self, ends: list[tuple[int, int]], scores: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log sum over all segmentations, and the probability of each segment with each type and of each pair of types."""
        places = sorted({0, *(e for _, e in ends)})
        where = [max(p for p in range(len(places)) if places[p] <= s) for s, _ in ends]
        stop = [places.index(e) for _, e in ends]
        n, m = len(places), len(TYPES)
        alpha = np.full((n, m + 1), -np.inf)
        alpha[0, 0] = 0
        for p in range(1, n):
            alpha[p] = alpha[p - 1]
            for k in [k for k in range(len(ends)) if stop[k] == p]:
                into = np.logaddexp.reduce(alpha[where[k]][:, None] + self.t, 0) + scores[k]
                alpha[p, 1:] = np.logaddexp(alpha[p, 1:], into)
        total = np.logaddexp.reduce(alpha[-1])
        beta = np.full((n, m + 1), -np.inf)
        beta[-1] = 0
        for p in range(n - 1, -1, -1):
            if p + 1 < n:
                beta[p] = beta[p + 1]
            for k in [k for k in range(len(ends)) if where[k] == p]:
                beta[p] = np.logaddexp(beta[p], np.logaddexp.reduce(self.t + scores[k] + beta[stop[k], 1:], 1))
        each, pairs = np.zeros((len(ends), m)), np.zeros_like(self.t)
        for k in range(len(ends)):
            p = np.exp(alpha[where[k]][:, None] + self.t + scores[k] + beta[stop[k], 1:] - total)
            each[k] = p.sum(0)
            pairs += p
        return float(total), each, pairs

    def fit(self, examples: list[tuple[list, np.ndarray, list]]) -> None:
        """examples: segments by end, their feature rows, and the true (segment, type) pairs; AdaGrad on the likelihood."""
        gw, gt = np.full(self.w.shape, 1e-3), np.full(self.t.shape, 1e-3)
        for epoch in range(EPOCHS):
            for k in np.random.default_rng(epoch).permutation(len(examples)).tolist():
                ends, rows, truth = examples[k]
                if not ends:
                    continue
                _, each, pairs = self.expected(ends, self.scores(rows))
                last = 0
                for s, y in truth:
                    each[s, y] -= 1
                    pairs[last, y] -= 1
                    last = y + 1
                used, back = np.unique(rows, return_inverse=True)
                g = np.zeros((len(used), len(TYPES)))
                np.add.at(g, back.reshape(rows.shape), each[:, None, :])
                g += 1e-3 * self.w[used]
                gw[used] += g * g
                self.w[used] -= 0.15 * g / np.sqrt(gw[used])
                gt += pairs * pairs
                self.t -= 0.05 * pairs / np.sqrt(gt)


def made(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with personal data and what only looks like it, and (start, end, type) of the former."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    d = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    low = lambda a=2, b=8: "".join(pick("aeiou" if k % 2 else "bcdfghlmnprst") for k in range(int(rng.integers(a, b + 1))))
    title = lambda: low(3, 8).title()
    words = lambda k: " ".join(low() for _ in range(k))
    cues = {k: [w for w, c in CUES.items() if c == k] for k in {*CUES.values()}}
    lead = lambda k: pick([f"{pick(cues[k])}{pick([': ', ' ', '. ', ' is ', ' no. '])}", f"{pick(cues[k]).title()}: "])

    def iban() -> str:
        country, rest = pick(["DE", "FR", "ES", "GB"]), d(18)
        check = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
        code = f"{country}{check:02d}{rest}"
        return code if rng.random() < 0.4 else " ".join(code[k : k + 4] for k in range(0, len(code), 4))

    def date(year: int) -> str:
        day, month, sep = rng.integers(1, 29), rng.integers(1, 13), pick("./-")
        return pick([f"{day:02d}{sep}{month:02d}{sep}{year}", f"{year}-{month:02d}-{day:02d}", f"{day}{sep}{month}{sep}{year}"])

    at, dot = lambda: pick([" at ", " (at) ", " [at] ", "(at)", " AT ", " @ "]), lambda: pick([" dot ", " (dot) ", " [dot] ", " DOT "])
    hexes = lambda k, sep, n: sep.join("".join(pick("0123456789abcdef") for _ in range(n)) for _ in range(k))
    phones = [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"00{d(2)} {d(2)} {d(7)}", lambda: f"0{d(2)}/{d(7)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"{d(3)}.{d(3)}.{d(4)}"]
    personal = {
        0: lambda: ("", f"{low()}{pick(['.', '_', ''])}{low()}{at()}{low()}{dot()}{pick(['com', 'org', 'de', 'net'])}"),
        1: lambda: (lead("ip") if rng.random() < 0.5 else "", pick([hexes(8, ":", 4), hexes(6, ":", 2)])),
        2: lambda: (lead("card"), pick([f"{d(4)} {d(6)} {d(5)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}"])),
        3: lambda: (lead("phone") if rng.random() < 0.6 else "", pick(phones[:2])()) if rng.random() < 0.5 else (lead("phone"), pick(phones)()),
        4: lambda: (lead("id") if rng.random() < 0.7 else "", f"{d(3)}-{d(2)}-{d(4)}") if rng.random() < 0.6 else (lead("id"), pick([d(9), f"{d(8)}", f"{d(2)} {d(3)} {d(3)} {d(3)}"])),
        5: lambda: (lead("iban") if rng.random() < 0.5 else "", iban()),
        6: lambda: (lead("birth"), date(int(rng.integers(1930, 2012)))),
        7: lambda: (pick([f"{pick(TITLES.split())}{pick(['', '.'])} ", "name: ", "Name: ", "name is "]), " ".join(title() for _ in range(int(rng.integers(1, 3))))),
    }
    harmless = [
        lambda: d(int(rng.integers(2, 22))), lambda: d(16), lambda: f"{lead('not')}{d(int(rng.integers(5, 14)))}", lambda: f"{lead('not')}{d(3)}-{d(3)}-{d(4)}", lambda: date(int(rng.integers(1950, 2030))),
        lambda: f"{rng.integers(1, 999)}.{d(3)}.{d(3)},{d(2)}", lambda: f"{d(1)},{d(3)}.{d(2)}", lambda: hexes(1, "", int(rng.integers(8, 40))), lambda: f"v{d(1)}.{d(2)}.{d(1)}", lambda: f"{d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
        lambda: " ".join(d(int(rng.integers(1, 5))) for _ in range(int(rng.integers(3, 8)))), lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"{d(4)}/{d(4)}", lambda: f"{low()} at {low()}", lambda: f"{low()} at {low()}.{pick(['com', 'org'])}", lambda: f"{low()} dot {low()} at {low()}",
        lambda: f"AB{d(int(rng.integers(4, 9)))}", lambda: f"{d(3)}.{d(3)}.{d(3)}.{d(3)}", lambda: f"{low()}@{d(2)}", lambda: f"{pick(cues['phone'])} {low()} {d(4)}", lambda: f"{d(4)}-{d(4)}", lambda: f"{hexes(1, '', 8)}-{hexes(3, '-', 4)}-{hexes(1, '', 12)}",
        lambda: f"{low()}{d(2)} {d(3)}", lambda: f"{pick(cues['id'])} {low()} {d(3)} {low()} {d(5)}",
    ]
    out = []
    for _ in range(n):
        text, truth = words(int(rng.integers(0, 6))), []
        for _ in range(int(rng.integers(1, 4))):
            text += pick([" ", ". ", ", ", "\n", " ("]) if text else ""
            if rng.random() < 0.5:
                kind = int(rng.integers(len(TYPES)))
                before, found = personal[kind]()
                truth.append((len(text) + len(before), len(text) + len(before) + len(found), kind))
                text += before + found
            else:
                text += pick(harmless)()
            text += pick([" ", ". ", ", ", "\n", ") "]) + words(int(rng.integers(1, 6)))
        out.append((text, truth))
    return out


def _candidates(text: str, start: int, end: int, base: list[tuple[int, int, str]]) -> tuple[list, list, np.ndarray]:
    """Tokens, segments that don't touch base findings, and their feature rows."""
    toks = tokens(text, start, end)
    ends = segments(toks)
    if base and ends:
        taken = np.zeros(end - start + 1, np.int64)
        for a, b, _ in base:
            taken[max(a - start, 0) + 1 : max(b - start, 0) + 1] = 1
        np.cumsum(taken, out=taken)
        ends = [(i, j) for i, j in ends if taken[toks[j - 1][1] - start] == taken[toks[i][0] - start]]
    return toks, ends, np.array([features(toks, i, j) for i, j in ends], np.int64)


@functools.cache
def field() -> Field:
    """The trained field; the same in every process, as seeds are fixed."""
    examples = []
    for text, truth in made(EXAMPLES, 1):
        base = base_spans(text)
        toks, ends, rows = _candidates(text, 0, len(text), base)
        place = {(toks[i][0], toks[j - 1][1]): k for k, (i, j) in enumerate(ends)}
        examples.append((ends, rows, [(place[a, b], y) for a, b, y in truth if (a, b) in place]))
    out = Field()
    out.fit(examples)
    return out


def spans_of(text: str, model: Field) -> list[tuple[int, int, str]]:
    """All spans of a text: base findings and the field's, which don't overlap them, by kind and start."""
    base = base_spans(text)
    found = list(base)
    by_start = sorted(base)
    begins = [a for a, _, _ in by_start]
    reach = list(accumulate((b for _, b, _ in by_start), max))  # the furthest end so far
    for start, end in regions(text):
        # very long regions are cut where no segment crosses
        for a, b in _cuts(text, start, end):
            near = by_start[bisect_right(reach, a) : bisect_left(begins, b)]
            toks, ends, rows = _candidates(text, a, b, near)
            if ends:
                found += [(toks[i][0], toks[j - 1][1], f"model_{TYPES[y]}") for i, j, y in model.best(ends, model.scores(rows, CAUTION))]
    return sorted(found, key=lambda s: (KINDS.index(s[2]), s[0]))


def _cuts(text: str, start: int, end: int, most: int = 20_000) -> Iterator[tuple[int, int]]:
    """Parts of about `most` characters, cut after line ends, which no segment has inside; the whole if there are none."""
    while end - start > most:
        cut = text.find("\n", start + most, end)
        if cut < 0:
            break
        yield start, cut + 1
        start = cut + 1
    yield start, end


def named(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span, overlapping ones together, replaced by its kind in brackets."""
    out, at = [], 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{kind.removeprefix('model_')}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def pii_scan(docs: DataFrame) -> DataFrame:
    """Every row of docs with pii_spans (kind:start:end by kind and start, comma-joined) and masked_text.

    docs: any columns with text; a null text is empty and has no spans.  Places are code
    points, ends exclusive.  Columns of the two names are replaced; repeated rows are
    scanned each; an empty table gives no rows.  Of segmentations with equal scores the one
    found first counts.
    """
    model = docs.sparkSession.sparkContext.broadcast(field())
    columns = [c for c in docs.columns if c not in ("pii_spans", "masked_text")]
    schema = docs.select(*columns).schema.add("pii_spans", "string").add("masked_text", "string")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = [spans_of(t, model.value) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([named(s) for s in found], pa.string()), pa.array([masked(t, s) for t, s in zip(texts, found, strict=True)], pa.string())],
                names=[*batch.schema.names, "pii_spans", "masked_text"],
            )

    return docs.select(*columns).mapInArrow(scan, schema)


def findings(scanned: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of a `pii_scan`, from its spans.

    A row each for every row, repeated ones too.  Without findings counts are 0, spans is
    empty and base_sha256 that of nothing.
    """
    spans = F.filter(F.split("pii_spans", ","), lambda s: s != "")
    base = F.filter(spans, lambda s: ~s.startswith("model_"))
    count = lambda kind: F.size(F.filter(spans, lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *(count(k) for k in BASE), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.col("pii_spans").alias("spans"))


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(named([s for s in spans if not s[2].startswith("model_")]).encode()).hexdigest()
