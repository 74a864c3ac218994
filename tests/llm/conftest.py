from __future__ import annotations

import random

import pytest

#: names that operators use inside
CLASHES = ["row", "hash", "id", "doc", "drop", "all", "kept", "host", "key", "src", "bucket", "copies", "nth", "shard", "slot", "rank", "lines", "n_words", "fp", "component", "h", "d", "s", "__t", "__size", "__drop", "__kept"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, words string, count string, " + ", ".join(f"{n} string" for n in CLASHES)
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return "\n".join(" ".join(r.choice(WORDS) for _ in range(12)) for _ in range(n))


def rows():
    """Nulls in every column, empty and long texts, ties, copies, repeated rows, odd characters."""
    shared = "All rights reserved."
    out = [(i, prose(3 + i % 4, i) + ("\n" + shared if i % 2 else ""), "en", f"s{i % 3}") for i in range(40)]
    base = prose(30, 100)
    out += [(40, base, "en", "s0"), (41, base, "de", "s1"), (42, base + " tail", "en", "s0")]
    out += [(50, "", "en", "s0"), (51, None, None, None), (52, " \t\n\n ", "en", "s2"), (None, "loose row " * 30, "en", "s0"), (53, "x", "", "")]
    out += [(54, "é ü 漢字 🙂\x1c\x85 A b  c\n  two  spaces ", "fr", "é"), (55, "Apache License and the GNU General Public License; CC-BY 4.0, MIT License", "en", "s1")]
    out += [(56, prose(400, 7), "en", "s1"), (57, "spam " * 500, "en", "s1"), (58, "a" * 5000, "en", "s1")]
    out += [out[0], out[0], out[41]]
    return [(i, t, lang, s, None if t is None else len(t), "1", None, "2", *[f"{i}-{n}" if n < "m" else None for n in CLASHES]) for i, t, lang, s in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
