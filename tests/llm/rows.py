"""Rows that every text operator has to bear: nulls, blanks, repeats, ties, long texts, clashing columns."""

from __future__ import annotations

import random

#: Columns whose names operators also use.
EXTRA = "length long, ids string, score string, node long, spans string, piece int, place long, path string, n long, label string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["an", "the", "on", "re", "é", "st", "Übe", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    base = [words(rng, rng.randint(1, 200)) for _ in range(25)]
    long = "".join(rng.choice("abcdefgh") for _ in range(90_000)) + " " + words(rng, 15_000)
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " "), (4, "\n \n"), (None, "no id here"), (None, None), (5, long), (6, long + " more"),
        (7, "one"), (7, "one"), (7, "another of the same id"), (8, "Don't <|endoftext|> stop\n\n  now"), (9, "日本語 😀 " * 50),
        (10, "password = hunter2222 token:abcdefg AKIA" + "A" * 16 + " " + "0123456789abcdef" * 2),
        (11, "MIT License and the GNU General Public License, version 3. Apache License 2.0"),
    ]
    rows += [(100 + i, b) for i, b in enumerate(base)]
    rows += [(200 + i, b + " and a few words more") for i, b in enumerate(base[:8])]
    rows += [(300 + i, base[0]) for i in range(5)]
    return rows


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame(
        [(i, t, "en", None, None, -1, "x", "x", 7, "x", 1, None, "p", 3, "l") for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
