"""Awkward tables that every operator has to take."""

from __future__ import annotations

import random

ROWS = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, size string, rep string, label string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice([
        "the", "of", "and", "river", "stone", "a", "élan", "winter", "go", "seven", "light", "harbour"
    ]) + str(r.randint(0, 40)) * r.randint(0, 1) for _ in range(n))


def awkward(spark):
    """Nulls in every column, empty and long texts, white space, ties, repeated rows, and columns with names that operators use inside."""
    long = words(9000, 1) + "."
    texts = [words(30, k) + "." for k in range(12)]
    rows = [(k, t, "en", f"s{k % 3}") for k, t in enumerate(texts)]
    rows += [(100, texts[0], "en", "s1"), (101, texts[0].replace(" ", "\n"), "fr", None), (50, texts[1] + " more", None, "s0")]
    rows += [(200, long, "en", "s2"), (201, long, "en", "s2"), (202, long[:-60], "en", None), (203, "x" * 9000, "en", "s0")]
    rows += [(300, None, "en", "s1"), (301, "", None, None), (302, " \n\t ", "en", "s1"), (303, "one", "en", "s1"), (304, "ONE", "en", "s1"), (305, "é", "xx", "s1")]
    rows += [(400, texts[3], "en", "s0"), (400, texts[3], "en", "s0")]  # repeated
    rows += [(None, texts[4], "en", "s0"), (None, "nameless words of its own here", "en", "s0")]
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "r", "k", "z", "p", "l") for i, t, lang, s in rows], ROWS)


def empty(spark):
    return spark.createDataFrame([], ROWS)
