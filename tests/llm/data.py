"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import random

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, kept string, h long, ids string, component_id string, sig string, _b int"
WORDS = "river stone lamp garden winter copper thread signal market harbor violet engine ladder forest mirror candle bridge planet silver window".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def awkward() -> list[tuple]:
    long = prose(1, 30_000)
    rows = [
        (1, prose(2, 50)), (2, None), (3, ""), (4, "  \n\t "), (5, prose(2, 50)), (6, prose(2, 50).upper()), (7, long), (8, long + " end"), (None, prose(2, 50)), (None, None),
        (9, "one"), (9, "one"), (10, "one"), (11, "one two"), (12, "naïve Ünïcode   wide space \U0001f600 ß"), (13, "a|b || <|endoftext|> x|"), (14, prose(3, 200)), (15, prose(3, 200).replace("stone", "pebble", 1)),
    ]
    return rows


def documents(spark, rows=None):
    rows = awkward() if rows is None else rows
    full = [(d, t, "en", "src1", None if t is None else len(t), "x", 1, "y", "z", "w", 3) for d, t in rows]
    return spark.createDataFrame(full, EXTRA)


def empty(spark):
    return spark.createDataFrame([], EXTRA)
