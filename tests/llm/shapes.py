"""Awkward inputs that every operator has to take: nulls, empty, long, repeated, clashing names."""

from __future__ import annotations

LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from it all the day", "en", 1, 2),
    (2, "the quick brown fox jumps over the lazy dog and runs away from it all the day", "en", 1, 2),
    (2, "the quick brown fox jumps over the lazy dog and runs away from it all the day", "en", 1, 2),
    (3, None, "en", 1, 2),
    (4, "", None, 1, 2),
    (None, "no id here but some words that nobody else has written down before now", "en", None, None),
    (None, None, None, None, None),
    (5, LONG, "la", 1, 2),
    (6, "   \t\n  ", "en", 1, 2),
    (7, "12345 678 !!! ???", "en", 1, 2),
    (8, "Ünïcödé \U0001f600 𝔘𝔫𝔦 \x00 � é <|endoftext|> 'tis we'll", "de", 1, 2),
]
#: key, node, n, id and hash are names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, key int, node int"


def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumnsRenamed({"key": "id", "node": "h1"})


def empty(spark):
    return frame(spark).limit(0)
