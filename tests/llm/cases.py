"""Small documents with every awkward case, and plain reference computations."""

import random
import re
import string

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, name int, word string, matches int, row int"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(("the", "of", f"word{rng.randrange(400)}", f"Été{rng.randrange(30)}", f"x{rng.randrange(9)},")) for _ in range(n))


def texts() -> list:
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    long = " ".join(f"w{k}" for k in range(30_000))
    return [
        None, "", " \n\t ", "one", "one", "one two three four", "one two three four", base, base, " ".join(near), base.upper(), prose(2, 80), prose(3, 9), long, long + " end", "😀 é́ naïve ǅ \x0b z",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and PASSWORD: hunter22', "Released under the MIT License. Licensed under the Apache License, Version 2.0.", "a" * 5000, "é" * 3000, "\x00\x1f\x7f |||",
    ]


def documents(spark):
    rows = [(k, t, "en", f"s{k % 2}", None if t is None else len(t), "x", 1, None, 2, 3) for k, t in enumerate(texts())]
    rows += [(None, prose(5, 30), None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(pattern, text):
    return pattern.findall((text or "").translate(LOWER))
