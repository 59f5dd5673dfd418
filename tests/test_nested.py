"""Secrets and placeholders in nested values against plain Python, at every depth."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from matquarry.functions import text as T

STRINGS = ["plain", 'a "quoted" \\ value', "token=abc123; x", "\\\"token: zz\\\"", "Bearer abc.def", "TBD", "n/a", "", "line\nend\t\x01\x02", "https://u:p@h.org/x", "α[{]}:,", "\\", '"', "token", "[REDACTED]"]
NAMES = ["a", "token", "api_key", "x-api-key", 'q"t', "b\\", "tokens", "", "null", "[]"]


def build(r, depth):
    if depth == 0:
        return r.choice([*STRINGS, 1, -2.5, True, None, {}, []])
    inner = [build(r, r.randrange(depth)) for _ in range(r.randrange(2))] + [build(r, depth - 1)]
    return inner if r.random() < 0.5 else {n: v for n, v in zip(r.sample(NAMES, len(inner)), inner)}


def leaves(v, depth=0):
    if isinstance(v, (dict, list)) and v:
        for x in v.values() if isinstance(v, dict) else v:
            yield from leaves(x, depth + 1)
    else:
        yield v, depth


def fields(v):
    if isinstance(v, dict):
        yield from v
    for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
        yield from fields(x)


def mapped(v, f):
    if isinstance(v, dict):
        return {k: mapped(x, f) for k, x in v.items()}
    return [mapped(x, f) for x in v] if isinstance(v, list) else f(v) if isinstance(v, str) else v


def test_against_plain_python(spark):
    r = random.Random(5)
    values = [build(r, d) for d in range(7) for _ in range(25)] + [build(r, 9) for _ in range(3)]
    single = spark.createDataFrame([(s,) for s in STRINGS], "s string").select("s", T.redact_secrets(F.col("s")).alias("r"), T.has_secrets(F.regexp_replace("s", r"\[REDACTED\]", "")).alias("h"), T.is_placeholder(F.col("s")).alias("p")).collect()
    redact, secret, blank = {x.s: x.r for x in single}, {x.s: x.h for x in single}, {x.s: x.p for x in single}
    named = re.compile(rf"(?i)^(?:{T.CREDENTIAL_FIELDS})$")
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string")
    j = F.col("j")
    shallow = F.when(T.nested_depth(j) <= 6, T.redact_nested(j))
    rows = df.select("i", T.nested_depth(j).alias("depth"), shallow.alias("redacted"), T.has_secrets_nested(j).alias("secret"), T.has_placeholder_nested(j).alias("blank")).collect()
    for row in rows:
        v = values[row.i]
        found = list(leaves(v))
        depth = max(d for _, d in found)
        assert row.depth == depth
        assert (row.redacted is None) if depth > 6 else json.loads(row.redacted) == mapped(v, redact.get)
        assert row.secret == (depth > 8 or any(named.match(n) for n in fields(v)) or any(isinstance(x, str) and secret[x] for x, _ in found)), v
        assert row.blank == (depth > 6 or any(x is None or isinstance(x, (dict, list)) or (isinstance(x, str) and blank[x]) for x, _ in found)), v


def test_no_json_and_too_deep(spark):
    df = spark.createDataFrame([(None,), ("{",)], "j string")
    assert {tuple(r) for r in df.select(T.redact_nested(F.col("j")), T.has_secrets_nested(F.col("j")), T.has_placeholder_nested(F.col("j"))).collect()} == {(None, None, True)}
    deep = spark.createDataFrame([("[" * 7 + "1" + "]" * 7,)], "j string")
    with pytest.raises(Exception, match="CREDENTIAL_SCAN_DEPTH_EXCEEDED"):
        deep.select(T.redact_nested(F.col("j"))).collect()
