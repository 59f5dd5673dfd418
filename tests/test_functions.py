"""Golden cases of the text, extraction and chemistry functions."""

import pytest
from pyspark.sql import functions as F

from matquarry.functions import chem, extract, text
from matquarry.operators import bands, evidence, knn, spectra


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


ABSTRACT = "ARPES was measured at 20 K with photon energy of 70 eV. Cobaltocene-doped SnSe2 shows a band gap of 0.8 eV."


def test_facts(spark):
    t = F.col("t")
    assert one(spark, extract.photon_energies(t), t=ABSTRACT) == ["70"]
    assert one(spark, extract.temperatures(t), t=ABSTRACT) == ["20"]
    assert one(spark, extract.band_gaps(t), t=ABSTRACT) == ["0.8 eV"]
    assert one(spark, extract.match_names(t, {"SnSe2": ["SnSe2"], "SnSe": ["SnSe"]}), t=ABSTRACT) == ["SnSe2"]
    assert one(spark, extract.first_doi(t), t="see 10.1234/example.2026.1.") == "10.1234/example.2026.1"


@pytest.mark.parametrize(
    ("formula", "key"),
    [("Fe2O3", "Fe2 O3"), ("O3Fe2", "Fe2 O3"), ("Fe4O6", "Fe2 O3"), ("Ca(OH)2", "Ca1 H2 O2"), ("Mg(Al(OH)4)2", "Al2 H8 Mg1 O8"), ("Xx2", None), ("Fe-2", None), ("H0.000000001", None)],
)
def test_compositions(spark, formula, key):
    assert one(spark, chem.let(chem.composition(F.col("f")), chem.composition_key), f=formula) == key


def test_small_fractions_differ(spark):
    key = chem.let(chem.composition(F.col("f")), chem.composition_key)
    assert one(spark, key, f="FeO0.00001") != one(spark, key, f="FeO0.00002")


def test_features_of_diboride(spark):
    vector = one(spark, chem.let(chem.composition(F.col("f")), chem.feature_vector), f="MgB2")
    assert len(vector) == 118
    assert vector[4] == pytest.approx(2 / 3)
    assert vector[11] == pytest.approx(1 / 3)


def test_numbers_and_privacy(spark):
    c = F.col("t")
    assert one(spark, text.bounded01(c), t="80%") == pytest.approx(0.8)
    assert one(spark, text.bounded01(c), t="800") is None
    assert one(spark, text.fortran_number(c), t="1.0D-3") == pytest.approx(1e-3)
    assert one(spark, text.redact_secrets(c), t="token: abc123 and Bearer xyz.9") == "token: [REDACTED] and Bearer [REDACTED]"
    assert one(spark, text.is_placeholder(c), t="TBD") is True
    assert one(spark, text.stage_of(c), t="not validated") == "unknown"
    assert one(spark, text.unique_ci(F.split(c, ",")), t="A,a.,b") == ["A", "b"]


def test_interpolation_and_edges(spark):
    b = spark.createDataFrame([("d", "b", 0.0, -1.0), ("d", "b", 1.0, 0.0)], "dataset string, band string, k double, energy double")
    grid = spark.createDataFrame([(0.5,), (2.0,)], "k double")
    assert [(r.k, r.energy) for r in bands.interpolate(b, grid, 0.3).collect()] == [(0.5, -0.5)]
    step = spark.createDataFrame([("s", i, j, 1.0 if i < 10 else 0.0) for i in range(20) for j in range(3)], "dataset string, i long, j long, value double")
    assert spectra.fermi_edge(step).first()["edge"] in (9, 10)


def test_neighbours(spark):
    s = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.0, 1.0], 2), (3, [0.0, 0.0], 2)], "vec_id long, embedding array<float>, label int")
    near = {r["rank"]: r for r in knn.cosine_topk(s.where("vec_id = 0"), s, 3).collect()}
    assert near[1].vec_id == 1
    assert near[3].similarity == -1.0
    knn.register_labeller("same", lambda q, x: q)
    assert knn.labeller("same")(s, s) is s


def test_entities(spark):
    t = F.col("t")
    assert one(spark, text.clean_metadata(t), t="&#945; &#x3b1; &#X393; &amp;#945; &#38;lt; &#55296; &#99999999999999999999; <b>&middot;</b>") == "α α Γ &#945; < &#55296; &#99999999999999999999; ·"
    assert one(spark, text.strip_html(t), t="a<script x>&#945;</script>&thinsp;2&times;3 &#956;m &amp;lt;") == "a 2x3 μm &lt;"


@pytest.mark.parametrize(
    ("name", "stage"),
    [("preview", "task_planning"), ("unvalidated_ml", "ml"), ("MatterSim", "ml"), ("abacus", "dft"), ("gpt", "llm"), ("reference", "database"), ("observed", "experiment"), ("first-principles", "dft"), ("Peer reviewed", "literature"), ("non-experimental", "unknown"), ("review", "unknown"), ("quantum espresso", "dft"), ("chgnet", "ml"), ("deepseek", "llm"), (None, "unknown")],
)
def test_stages(spark, name, stage):
    assert one(spark, text.stage_of(F.col("t")), t=name) == stage


@pytest.mark.parametrize(
    ("name", "plausible"),
    [("YBCO", True), ("BSCCO", True), ("graphene", True), ("cuprates", True), ("Iron-based  superconductors", True), ("ARPES", False), ("Pb", True), ("Bi", False), ("2H-NbSe2", True), ("MgB₂", True), ("the", False), ("FeSe" * 20, False), ("my alloy", True), (None, False)],
)
def test_plausible_materials(spark, name, plausible):
    assert one(spark, chem.is_plausible(F.col("t"), ["My Alloy"]), t=name) is plausible


def test_candidates(spark):
    found = one(spark, chem.formula_candidates(F.col("t")), t="2H-NbSe2 and Nd1-xSrxNiO2 in ARPES; Fe2O3. " + "A" * 5000)
    assert found == ["2H-NbSe2", "Nd1-xSrxNiO2", "Fe2O3"]
    assert one(spark, chem.clean_materials(F.split(F.col("t"), ";"), ["cobaltocene"]), t="MgB2.;mgb2;MgB₂; Cobaltocene,;OF;YBCO") == ["MgB2", "Cobaltocene", "YBCO"]


@pytest.mark.parametrize(("day", "valid"), [("2023-05-01", True), ("2023-05-01T10:00", True), ("9999-99-99", False), ("9998-01-01", False), ("2023-02-30", False), ("soon", False), (None, False)])
def test_snapshot_dates(spark, day, valid):
    assert one(spark, evidence.is_snapshot_date(F.col("t")), t=day) is valid
