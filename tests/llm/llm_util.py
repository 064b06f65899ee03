"""Fixtures with every awkward case: null, empty, blank, very long, repeated and tied rows, clashing extra columns."""

from __future__ import annotations

import random

EXTRA = "_d long, _at string, _lines string, _row long, _text string, node string, kept boolean, n_lines long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def table(spark, rows):
    """Documents (doc_id, text, lang, source) with extra columns that clash with names used inside."""
    data = [(i, t, l, s, None if t is None else len(t), 7, "x", "y", 8, "z", "n", False, 9) for i, t, l, s in rows]
    return spark.createDataFrame(data, SCHEMA)


SYLLABLES = {
    "en": "the and ing tion er re on at en ha th ou it is or st nd ly".split(),
    "de": "der und ung sch ein ich ver keit heit ü ß ö zu ge be auf tz pf".split(),
    "fr": "le la eau que tion é è ê ç oi aux en de ment ier ou re vi".split(),
}


def sentence(rng: random.Random, lang: str, words: int) -> str:
    s = SYLLABLES[lang]
    return " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(words)).capitalize() + "."


def prose(rng: random.Random, lang: str = "en", lines: int = 4, words: int = 14) -> str:
    return "\n".join(sentence(rng, lang, words) for _ in range(lines))


AWKWARD = [
    (900, None, "en", "s0"), (901, "", "en", "s0"), (902, " \t\n \r\n", "en", None), (903, "x", None, None),
    (904, "1234 5678 !!! ***", "en", "s1"), (905, "é", "fr", "s1"), (906, "one two", "en", "s1"),
    (906, "one two", "en", "s1"), (None, "A row without an id that still has a line of text", "en", "s1"),
    (907, "İstanbul ΣΑΣ's \U0001F600 don't it's 'quoted'", "en", "s1"),
    (908, "tail \n\n\x0b\x0cnext", "en", "s1"),
]
