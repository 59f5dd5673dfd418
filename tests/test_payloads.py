"""Payloads of every shape, each error code, tables with quotes."""

import json

import pytest

from matquarry.operators import payloads as P


def write(folder, files):
    for name, text in files.items():
        (folder / name).write_text(text if isinstance(text, str) else json.dumps(text), encoding="utf-8")
    return str(folder)


def test_shapes(spark, tmp_path):
    path = write(tmp_path, {
        "single.json": {"formula": "MgB2", "model": "own", "tc": "39"},
        "bare.json": [{"formula": "a", "Tc": 1}, None, 3, [{"formula": "b", "tc_K": 2}]],
        "models.json": {"models": [{"model": "m1", "candidates": [{"formula": "c", "band_gap": 1500, "band_gap_unit": "meV"}]}, {"name": "m2", "candidates": None, "results": [{"formula": "d", "ehull": 0.1}]}, {"name": "m3"}]},
        "results.json": {"model": "m4", "results": [{"formula": "e", "properties": {"magnetic_moment_muB": {"mean": 2, "unit": "Bohr magneton"}}}]},
        "candidates.json": {"candidates": [{"formula": "f", "property": "E_HULL", "value": "0.2", "unit": "eV / atom"}]},
        "t.csv": 'formula,tc_K,note\r\n"Ba, ""Cu""\nO",90,x\r\n,,\r\ng,12\r\n',
        "t.tsv": "formula\tband_gap_eV\nh\t0.5\n",
        "empty.txt": " ", "broken.json": "{", "quote.csv": 'a,b\n"x,1', "none.csv": "a,b\n", "twice.csv": "a,a\n1,2",
    })
    good, bad = P.model_results(spark, path)
    rows = {(r.file, tuple(r.path), r.model, r.formula, r.property, r.value) for r in good.collect()}
    assert rows == {
        ("single.json", (), "own", "MgB2", "tc", 39.0), ("bare.json", (0,), "bare.json", "a", "tc", 1.0), ("bare.json", (3, 0), "bare.json", "b", "tc", 2.0),
        ("models.json", (0, 0), "m1", "c", "gap", 1.5), ("models.json", (1, 0), "m2", "d", "hull", 0.1), ("results.json", (0,), "m4", "e", "moment", 2.0),
        ("candidates.json", (0,), "candidates.json", "f", "hull", 0.2), ("t.csv", (0,), "t.csv", 'Ba, "Cu"\nO', "tc", 90.0), ("t.csv", (1,), "t.csv", "g", "tc", 12.0),
        ("t.tsv", (0,), "t.tsv", "h", "gap", 0.5),
    }
    assert {(r.file, r.error_code) for r in bad.collect()} == {("empty.txt", "EMPTY_INPUT"), ("broken.json", "INVALID_JSON"), ("quote.csv", "UNBALANCED_CSV_QUOTE"), ("none.csv", "EMPTY_TABLE"), ("twice.csv", "DUPLICATE_HEADER")}


CASES = [
    ({"tc": "warm"}, P.ERRORS[0]), ({"tc": {"unit": "K"}}, P.ERRORS[0]), ({"tc": True}, P.ERRORS[0]), ({"tc": "1e999"}, P.ERRORS[0]), ({"tc": '{"value": 1}'}, P.ERRORS[0]),
    ({"band_gap": 1, "band_gap_unit": "eV", "units": {"band_gap": "meV"}}, P.ERRORS[1]), ({"tc": 5, "tc_unit": "K", "unit": "eV"}, P.ERRORS[1]),
    ({"tc": 5, "band_gap": 1, "unit": "K"}, P.ERRORS[2]), ({"tc": 5, "tc_unit": "F"}, P.ERRORS[3]), ({"tc": 1001}, P.ERRORS[4]), ({"ehull": -1}, P.ERRORS[4]),
    ({"tc": 5, "Tc": 6}, P.ERRORS[5]), ({"tc": {"value": 5, "mean": 6}}, P.ERRORS[5]), ({"tc": 5, "properties": {"tc_K": 7}}, P.ERRORS[5]),
    ({"band_gap": 1, "tc": "x", "properties": {"magnetic_moment_muB": 2000}}, P.ERRORS[0]),
    ({"tc": 5, "Tc": "5.0", "properties": {"tc_K": {"value": 5}}, "target": "TC", "value": 5, "unit": "Kelvin"}, {"tc": 5.0}),
    ({"band_gap": 250, "units": {"band_gap_eV": "m eV"}, "tc": "", "magmom": None, "ehull": []}, {"gap": 0.25}),
    ({"formation_energy": "-1.5", "formation_energy_unit": "electronvolts peratom"}, {"formation": -1.5}), ({"name": "x"}, {}), ({"target": "colour", "value": 3}, {}),
]


def test_each_rule(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(CASES)], "i int, j string").select("i", F.parse_json("j").alias("candidate"))
    got = {r.i: r.error or {p.property: p.value for p in r.properties} for r in P.canonical_properties(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}
    assert {w for _, w in CASES if isinstance(w, str)} == set(P.ERRORS)


def test_depth(spark):
    from pyspark.sql import functions as F

    nest = lambda n: spark.createDataFrame([("[" * n + '{"tc":1}' + "]" * n,), (None,)], "j string").select(F.parse_json("j").alias("payload"), F.lit("d").alias("model"))
    assert [(r.path, r.model) for r in P.candidates(nest(6)).collect()] == [([0] * 6, "d")]
    with pytest.raises(Exception, match="PAYLOAD_DEPTH_EXCEEDED"):
        P.candidates(nest(7)).collect()
