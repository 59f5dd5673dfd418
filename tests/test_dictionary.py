"""A dictionary of 100,000 aliases against regular expressions in plain Python."""

import random
import re

from matquarry.operators.dictionary import match_dictionary


def plain(text, names):
    hits = {(p, n) for n, a, p in names if a and a.strip() and text and re.search(rf"(?i)(^|[^A-Za-z0-9]){re.escape(a)}($|[^A-Za-z0-9])", text)}
    return list(dict.fromkeys(n for _, n in sorted(hits)))


EDGE = [
    ("β phase", "β-SnSe", 1), ("plus", "++", 2), ("iron selenide", "FeSe", 3), ("iron selenide", "fe se (x)", 3), ("blank", "  ", 4), ("null", None, 5),
    ("dots", "a.b*c", 6), ("greek", "β", 7), ("iron selenide", "FeSe", 3), ("dollar", "$1\\E", 8), ("space", "thin  film", 9),
]
TEXTS = ["FESE, and β-snse", "FeSeTe FeSe2 xFeSe", "fe SE (X).", "thin film", "Thin  Film", "a.b*c a.bbc", "aXb*c", "C++ ++", "++C", "$1\\E", "β", "", None, "FeSe" + " pad" * 30000 + " a.B*C", "FESE, and β-snse"]


def test_edges(spark):
    names = spark.createDataFrame(EDGE, "name string, alias string, position int")
    texts = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "id int, text string, token string")
    for most in (100, 1):
        rows = match_dictionary(texts, names, most=most).collect()
        assert {(r.id, tuple(r.names), r.token) for r in rows} == {(i, tuple(plain(t, EDGE)), "x") for i, t in enumerate(TEXTS)}
        assert len(rows) == len(TEXTS)
    assert match_dictionary(texts, names.limit(0)).where("size(names) > 0").count() == 0
    assert match_dictionary(texts.limit(0), names).count() == 0


def test_many_aliases(spark):
    r = random.Random(1)
    parts = ["Fe", "Se", "Sn", "film", "thin", "bulk", "x", "2H", "1T", "alpha"]
    names = [(f"n{i}", f"{r.choice(parts)}{r.choice('- /')}{i % 33334}{r.choice(['', ' ' + r.choice(parts)])}", i) for i in range(100_000)]
    texts = [" ".join(r.choice(names)[1].swapcase() if r.random() < 0.3 else r.choice([*parts, "word"]) for _ in range(30)) for _ in range(60)]
    dictionary = spark.createDataFrame(names, "name string, alias string, position int")
    rows = match_dictionary(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"), dictionary).collect()
    got = {x.id: list(x.names) for x in rows}
    for i in range(0, 60, 12):
        low = texts[i].lower()
        near = [n for n in names if n[1].lower() in low]
        assert got[i] == plain(texts[i], near) and got[i]
