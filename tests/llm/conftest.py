"""A small awkward table and plain-Python versions of the contracts."""

import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, t string, r int, hit boolean, n long"

_long = " ".join(f"w{i % 7919}x{i % 31}" for i in range(60_000))
_base = " ".join(f"alpha{i}" for i in range(120))
_near = _base.replace("alpha60 ", "beta ")

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog", "en", "a"),
    (2, "The  quick\tbrown fox jumps over the lazy dog", "en", "a"),
    (3, None, None, None),
    (4, "", "fr", "b"),
    (5, " \t\n", "fr", None),
    (6, _base, "en", "a"),
    (7, _near, "en", "c"),
    (7, _near, "en", "c"),  # a repeated row
    (8, _near + " tail", None, "c"),
    (9, _long, "en", "b"),
    (None, _base, "de", "b"),  # no key
    (10, "one two three", "es", "d"),
    (11, "one two three", "es", "d"),
    (12, "MIT License and the GNU General Public License, version 3.", "en", "a"),
    (13, "mail a.b@c.example.com from 10.0.0.1 card 4111 1111 1111 1111 call +1 (555) 555-0100 \U0001f600", "en", "a"),
    (14, "x\ny\nx\n\nx " + "la " * 70, "en", "a"),
    (15, "%%% ### " * 40, "en", "d"),
]


@pytest.fixture(scope="session")
def rows():
    return [(d, t, lang, s, len(t) if t else 0, "clash", "clash", 1, True, 7) for d, t, lang, s in ROWS]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def words():
    return lambda text: WORD.findall(text or "")
