"""Small corpora and plain-Python versions that the operators are held against."""

from __future__ import annotations

import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_AZ = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text: str) -> str:
    return (text or "").translate(_AZ)


def tokens(text: str) -> list[str]:
    return WORD.findall(lower(text))


def shingles(text: str, k: int = 5) -> set:
    w = tokens(text)
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{min(int(rng.paretovariate(0.7)), vocabulary)}x{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng: random.Random, text: str, changes: int) -> str:
    w = text.split(" ")
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def frame(spark, rows):
    """rows of (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows(spark):
    """Nulls, empty and long texts, repeats, a null id, and extra columns whose names clash with work and result columns."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (5, "Über café naïve 漢字 text here, six seven eight"),
            (6, "lorem ipsum dolor " * 4000), (None, "null id text with several words in it"), (None, None), (7, "same text of seven words in all"), (8, "same text of seven words in all")]
    df = spark.createDataFrame([(a, b, "en", None if (a or 0) % 2 else "s", None) for a, b in rows], SCHEMA)
    from pyspark.sql import functions as F

    clash = ("score", "label", "size", "taken", "target", "rep", "key", "h1", "component_id", "kept", "_id", "_text", "_row", "pid", "tie", "held_out", "seed", "words", "email", "candidates", "base", "rank", "level", "text_key", "spans")
    return df.withColumns({c: F.lit("x") for c in clash})
