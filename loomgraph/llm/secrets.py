"""Secret scans: fixed patterns, and a character convolutional network over candidates.

The patterns give the base findings.  Besides, every run of key-like characters with
letters and digits, or what base findings leave of it, is a candidate: a small
convolutional network reads it in overlapping windows over its whole length, each with
the characters before and after it, and yields a probability; a candidate's is that of
its likeliest window.  The network is trained here, in
numpy, on labelled findings made by rule from a fixed seed (keys of several
alphabets in assignment, header and prose contexts; against them hosts, addresses,
dates, versions, paths, identifiers and long words).  Its scores are calibrated
(Platt) on findings held out, and the threshold is the highest at which RECALL of
their secrets are found.
"""

from __future__ import annotations

import functools
import hashlib
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import chunks

#: fixed values: the base patterns, in the order of their kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")

#: fixed: a candidate's least length, with a digit and a letter; shorter keys and those of letters alone are left to the patterns
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.\-]{{{LEAST},}}")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
_KEYWORD = re.compile(r"passw|secret|token|api_?key")

#: words that names in code are made of, beside made-up ones
TERMS = (
    "get set user profile by id from cache or database load order item list update session parser handle request response build query index data model view render image file path config value string number "
    "array object map filter reduce count total price account customer address street city country default max min size width height color key name type class method event listener service client server buffer"
).split()
BEFORE, WITHIN, AFTER = 24, 48, 24  # characters a window reads before its part of a candidate, of it, and after it
STRIDE, TOGETHER = 24, 4096  # from window to window; windows made at once
EMBED, WIDTH, FILTERS = 12, 5, 24
EXAMPLES, EPOCHS, RECALL = 6000, 8, 0.98


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' findings, leftmost and not overlapping in each kind, by start and kind."""
    found = []
    if _KEYWORD.search(text.lower()):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Runs, cut at the base findings, that are long enough and have letters and digits."""
    found, k, known = [], 0, []
    for a, b, _ in base:  # sorted by start; overlapping ones together
        if known and a <= known[-1][1]:
            known[-1] = known[-1][0], max(known[-1][1], b)
        else:
            known.append((a, b))
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while at < end:
            while k < len(known) and known[k][1] <= at:
                k += 1
            a, b = known[k] if k < len(known) and known[k][0] < end else (end, end)
            part = text[at:a] if a > at else ""
            if len(part) >= LEAST and _DIGIT.search(part) and _LETTER.search(part):
                found.append((at, a))
            at = b
    return found


def starts(start: int, end: int) -> list[int]:
    """Where the windows of a candidate start; the last one ends with it."""
    return [*range(start, end - WITHIN, STRIDE), max(start, end - WITHIN)]


def window(text: str, start: int, end: int) -> np.ndarray:
    """Codes of WITHIN characters of a candidate from start, of those before and after: 0 nothing, 1-95 printable ASCII, 96 other, 97 white space."""
    stop = min(end, start + WITHIN)
    left = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    inside, right = text[start:stop].ljust(WITHIN, "\0"), text[stop : stop + AFTER].ljust(AFTER, "\0")
    c = np.frombuffer((left + inside + right).encode("utf-32-le"), np.uint32)
    return np.where(c == 0, 0, np.where((c > 32) & (c < 127), c - 32, np.where(np.isin(c, (9, 10, 13, 32)), 97, 96))).astype(np.int64)


def labelled_findings(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of made findings and their labels (1: a secret), half of each."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    some = lambda alphabet, a, b: "".join(alphabet[k] for k in rng.integers(len(alphabet), size=int(rng.integers(a, b + 1))))
    low, digits = string.ascii_lowercase, string.digits
    word = lambda a=2, b=9: some("aeiou", 1, 1) + some("etaoinshrdlu", a, b)
    words = lambda k: " ".join(word() for _ in range(k))
    syllable = lambda: pick(["", "s", "t", "c", "st", "tr", "pr", "ch", "b", "d", "f", "g", "m", "n", "p", "r", "v", "w", "qu", "j", "k", "y", "h", "l"]) + pick("aeiou") + pick(["", "n", "r", "t", "l", "s", "m", "ck", "nd", "st", "x", "p", "g", "te", "re", "ing"])
    term = lambda: pick(TERMS) if rng.random() < 0.6 else "".join(syllable() for _ in range(int(rng.integers(1, 4))))
    camel = lambda: "".join((term().title() if k else term()) + (str(rng.integers(200)) if rng.random() < 0.25 else "") for k in range(int(rng.integers(3, 7)))) + str(rng.integers(10))
    uuid = lambda: "-".join(some(pick(["0123456789abcdef", "0123456789abcdef", "0123456789ABCDEF"]), k, k) for k in (8, 4, 4, 4, 12))
    secrets = [
        lambda: some("0123456789abcdef", 24, 64), lambda: some("0123456789ABCDEF", 24, 64), lambda: some(string.ascii_letters + digits, 20, 48),
        lambda: some(string.ascii_letters + digits + "+/", 28, 60) + pick(["", "=", "=="]), lambda: "AKIA" + some(string.ascii_uppercase + digits, 16, 16),
        lambda: pick(["sk-", "ghp_", "xoxb-", "glpat-", "pk_live_"]) + some(string.ascii_letters + digits, 20, 40), lambda: some(string.ascii_letters + digits + "_-", 22, 44),
    ]
    harmless = [
        lambda: f"{word()}.{word()}{rng.integers(100)}.example.com", lambda: f"{word()}-{word()}-{rng.integers(3000)}-{word()}",
        lambda: f"20{rng.integers(10, 30)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{rng.integers(10, 24)}", lambda: f"v{rng.integers(9)}.{rng.integers(30)}.{rng.integers(9)}-{word()}.{word()}",
        lambda: "/".join(word() for _ in range(3)) + f"/{word()}{rng.integers(99)}.html", lambda: f"{word()}_{word()}_{word()}_{rng.integers(999)}",
        lambda: word(10, 18) + str(rng.integers(10)), lambda: f"{word(6, 9).title()}{word(6, 9).title()}{rng.integers(99)}",
        lambda: "=" * int(rng.integers(14, 30)) + pick(low) + pick(digits), lambda: f"{pick(low)}{pick(digits)}" * int(rng.integers(9, 16)),
        lambda: f"{word()}.{word()}.{word()}.{rng.integers(99)}.{word()}",
        lambda: camel(), lambda: camel(), lambda: uuid(), lambda: uuid(), lambda: "_".join(term().upper() for _ in range(int(rng.integers(3, 6)))) + f"_{rng.integers(99)}", lambda: f"{term()}.{term()}.{term()}.{camel().title()}", lambda: f"{term().upper()}{rng.integers(99)}_{term().upper()}_{term().upper()}",
        lambda: "_".join(term() for _ in range(int(rng.integers(3, 6)))) + str(rng.integers(99)), lambda: camel(),
        lambda: f"{word(2, 4).upper()}-20{rng.integers(10, 30)}-{rng.integers(10**6):06d}", lambda: f"{word(4, 8)}{rng.integers(9)}{word(4, 8)}{rng.integers(9)}{word(3, 6)}",
    ]
    lead = [
        lambda: f'{pick(["key", "auth", "credential", "access", "private", "bearer", "pwd"])}{pick([" = ", ": ", "=", " "])}{pick(["", chr(34), chr(39)])}',
        lambda: words(4) + " ", lambda: "Authorization: Bearer ", lambda: words(2) + ".\n", lambda: words(3) + "*** ", lambda: "",
    ]
    tail = [lambda: "", lambda: pick([chr(34), chr(39), ".", ",", ")", ";"]) + pick([" ", "\n", ""]) + words(3), lambda: " " + words(4), lambda: "\n" + words(3), lambda: " ***"]
    based = [lambda: "AKIA" + some(string.ascii_uppercase + digits, 16, 16), lambda: some("0123456789abcdef", 24, 40)]
    # assignment contexts are more often those of secrets, hosts and paths follow prose
    x, y = np.zeros((n, BEFORE + WITHIN + AFTER), np.int64), np.arange(n) % 2
    for k in range(n):
        made = pick(secrets)() if y[k] else pick(harmless)()
        before = pick(lead)() if y[k] or rng.random() < 0.4 else lead[1]()
        if rng.random() < 0.3:  # a long run, or what a base finding leaves of one
            ahead = pick("/.-=_")
            if rng.random() < 0.3:
                before += pick(based)() + pick("/.-=_")
                ahead = ""
            else:
                while len(ahead) < rng.integers(20, 120):
                    ahead = pick(harmless)() + pick("/.-=_") + ahead
                if rng.random() < 0.2:
                    ahead = pick("./-=_") * int(rng.integers(48, 90))
            end = len(before) + len(ahead) + len(made)
            at = [a for a in starts(len(before), end) if not y[k] or min(end, a + WITHIN) - max(a, len(before) + len(ahead)) >= min(len(made), STRIDE)]
            made, at = ahead + made, at[int(rng.integers(len(at)))]
        else:
            at = len(before)
        x[k] = window(before + made + pick(tail)(), at, len(before) + len(made))
    return x, y


class Network:
    """Embedding, one convolution, maxima over the context before, the candidate and the context after, one logistic unit."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.p = {
            "e": rng.normal(0, 0.3, (98, EMBED)), "k": rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)),
            "b": np.zeros(FILTERS), "w": rng.normal(0, 0.2, 3 * FILTERS), "c": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        p = self.p
        e = p["e"][x]
        cols = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, WIDTH * EMBED)
        a = np.maximum(cols @ p["k"] + p["b"], 0)
        cuts = [0, BEFORE - WIDTH + 1, BEFORE + WITHIN, a.shape[1]]
        tops = [a[:, i:j].argmax(1) + i for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        pooled = np.concatenate([np.take_along_axis(a, t[:, None], 1)[:, 0] for t in tops], 1)
        return cols, tops, pooled, pooled @ p["w"] + p["c"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[a : a + 512])[3] for a in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -35, 35)))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        cols, tops, pooled, logit = self._forward(x)
        d = (1 / (1 + np.exp(-np.clip(logit, -35, 35))) - y) / len(x)
        g = {"w": pooled.T @ d, "c": np.array([d.sum()])}
        d_pooled = d[:, None] * self.p["w"] * (pooled > 0)
        d_pre = np.zeros((len(x), cols.shape[1], FILTERS))
        rows, filters = np.arange(len(x))[:, None], np.arange(FILTERS)
        for part, top in enumerate(tops):
            np.add.at(d_pre, (rows, top, filters), d_pooled[:, part * FILTERS : (part + 1) * FILTERS])
        flat = d_pre.reshape(-1, FILTERS)
        g["k"], g["b"] = cols.reshape(-1, WIDTH * EMBED).T @ flat, flat.sum(0)
        d_cols = (flat @ self.p["k"].T).reshape(len(x), -1, WIDTH, EMBED)
        d_e = np.zeros((len(x), x.shape[1], EMBED))
        for k in range(WIDTH):
            d_e[:, k : k + d_cols.shape[1]] += d_cols[:, :, k]
        g["e"] = np.zeros_like(self.p["e"])
        np.add.at(g["e"], x.ravel(), d_e.reshape(-1, EMBED))
        return g

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = np.random.default_rng(epoch).permutation(len(x))
            for a in range(0, len(x), 64):
                step += 1
                at = order[a : a + 64]
                for k, g in self.gradients(x[at], y[at]).items():  # Adam
                    m[k][0] = 0.9 * m[k][0] + 0.1 * g
                    m[k][1] = 0.999 * m[k][1] + 0.001 * g * g
                    self.p[k] = self.p[k] - 0.004 * (m[k][0] / (1 - 0.9**step)) / (np.sqrt(m[k][1] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling by Newton steps, then the highest threshold with RECALL of the secrets at or above it."""
        z = self.logits(x)
        t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
            g, v = np.array([((p - t) * z).sum(), (p - t).sum()]), p * (1 - p)
            h = np.array([[(v * z * z).sum(), (v * z).sum()], [(v * z).sum(), v.sum()]]) + 1e-3 * np.eye(2)
            da, db = np.linalg.solve(h, g)
            a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
        self.scale, self.shift = a, b
        p = np.sort(self.probability(x[y == 1]))
        self.threshold = float(p[int((1 - RECALL) * len(p))])


@functools.cache
def network() -> Network:
    """The trained network; the same in every process, as seeds are fixed."""
    net = Network()
    net.fit(*labelled_findings(EXAMPLES, 1))
    net.calibrate(*labelled_findings(EXAMPLES // 2, 2))
    return net


def spans_of(texts: list[str], net: Network) -> list[list[tuple[int, int, str]]]:
    """All spans of each text: base findings, and the candidates outside of them that the network accepts."""
    out, asked, place = [], [], []
    for k, text in enumerate(texts):
        base = base_spans(text)
        out.append(base)
        for a, b in candidates(text, base):
            place.append((k, a, b))
            asked += [(len(place) - 1, at) for at in starts(a, b)]
    secret = np.zeros(len(place), bool)
    for c in range(0, len(asked), TOGETHER):
        some = asked[c : c + TOGETHER]
        p = net.probability(np.stack([window(texts[place[j][0]], at, place[j][2]) for j, at in some]))
        secret[[j for (j, _), q in zip(some, p, strict=True) if q >= net.threshold]] = True
    for j in np.flatnonzero(secret).tolist():
        k, a, b = place[j]
        out[k].append((a, b, "model"))
    return [sorted(x, key=lambda s: (s[0], KINDS.index(s[2]))) for x in out]


def named(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def masked(text: str, spans: list[tuple[int, int, str]], mask: str = "[secret]") -> str:
    """The text with every span, overlapping ones together, replaced by the mask."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame) -> DataFrame:
    """Every row of docs with secret_spans (kind:start:end, comma-joined) and masked_text.

    docs: any columns with text; a null text is empty and has no spans.  Places are code
    points, ends exclusive.  Columns of the two names are replaced; repeated rows are
    scanned each; an empty table gives no rows.
    """
    net = docs.sparkSession.sparkContext.broadcast(network())
    columns = [c for c in docs.columns if c not in ("secret_spans", "masked_text")]
    schema = docs.select(*columns).schema.add("secret_spans", "string").add("masked_text", "string")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = spans_of(texts, net.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([named(s) for s in found]), pa.array([masked(t, s) for t, s in zip(texts, found, strict=True)])],
                names=[*batch.schema.names, "secret_spans", "masked_text"],
            )

    return docs.select(*columns).mapInArrow(scan, schema)


def findings(scanned: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of a `secret_scan`, from its spans.

    A row each for every row, repeated ones too.  Without findings counts are 0, spans is
    empty and base_sha256 that of nothing.
    """
    spans = F.filter(F.split("secret_spans", ","), lambda s: s != "")
    base = F.filter(spans, lambda s: ~s.startswith("model:"))
    count = lambda kind: F.size(F.filter(spans, lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.col("secret_spans").alias("spans"),
    )


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(named([s for s in spans if s[2] != "model"]).encode()).hexdigest()
