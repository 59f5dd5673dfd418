"""Chemical formulas and compositions on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

#: Element symbols in order of atomic number (fixed values).
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr "
    "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
NUMBER = {s: i + 1 for i, s in enumerate(SYMBOLS)}


def normalize_formula(c: Column) -> Column:
    """Subscripts as digits, one kind of dash, delta spelt out."""
    s = F.translate(F.trim(F.coalesce(c, F.lit(""))), "₀₁₂₃₄₅₆₇₈₉ₓ−–—", "0123456789x---")
    return F.replace(s, F.lit("δ"), F.lit("delta"))


def _symbols() -> Column:
    return F.split(F.lit(" ".join(SYMBOLS)), " ")


#: Elements of names that are no formulas, by the name in capitals (fixed values).
ACRONYMS = {
    "YBCO": "Y Ba Cu O", "LSCO": "La Sr Cu O", "LBCO": "La Ba Cu O", "BSCCO": "Bi Sr Ca Cu O", "BI2212": "Bi Sr Ca Cu O", "BI2201": "Bi Sr Cu O", "BAK122": "Ba K Fe As", "BKBO": "Ba K Bi O",
    "STO": "Sr Ti O", "KTO": "K Ta O", "H-BN": "B N", "BN": "B N", "BP": "B P", "CSH": "C S H", "GRAPHENE": "C", "BLACK PHOSPHORUS": "P", "PHOSPHORENE": "P", "TI3C2TX": "Ti C", "SILICENE": "Si",
    "GERMANENE": "Ge", "STANENE": "Sn", "BOROPHENE": "B", "ANTIMONENE": "Sb", "BISMUTHENE": "Bi", "PLUMBENE": "Pb",
}


def formula_elements(c: Column) -> Column:
    """Elements of a formula, or of a name in ``ACRONYMS``, in order; empty if it is neither or has an unknown symbol."""
    none = F.array().cast("array<string>")
    known = F.element_at(F.create_map(*[F.lit(x) for kv in ACRONYMS.items() for x in kv]), F.upper(F.trim(F.coalesce(c, F.lit("")))))

    def parsed(s: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(s, F.lit(r"([A-Z][a-z]?)"), F.lit(1)))
        whole = s.rlike(r"^([A-Z][a-z]?|delta|[xyztnm0-9.,+\-_/()\[\]{}=])+$")
        return F.when(whole, let(found, lambda e: F.when(F.size(F.array_except(e, _symbols())) == 0, e).otherwise(none))).otherwise(none)

    return F.coalesce(F.split(known, " "), let(F.regexp_replace(normalize_formula(c), r"^[0-9]+[HTR]-", ""), parsed))


def elements_of(materials: Column, most: int = 24) -> Column:
    return F.slice(F.array_distinct(F.flatten(F.transform(materials, lambda m: formula_elements(m)))), 1, most)


#: Words that look like formulas and aren't (fixed values).
STOPWORDS = [
    "OF", "ON", "IN", "BY", "SI", "FS", "SC", "SOC", "SPIN", "PHYSICS", "PHONON", "PHONONS", "BCS", "VHS", "COPY", "B.V", "BI", "IV", "IP", "OP", "BOSONIC", "ELECTRON", "ELECTRONS",
    "SUPERCONDUCTIVITY", "TRANSITION", "TEMPERATURE", "MOMENTUM", "ELEMENTS", "THEORY", "STATE", "STATES",
]


#: Names of materials that need no parsing, and terms that stand for classes of them (fixed values).
KNOWN_MATERIALS = [
    "Bi2Se3", "Bi2Te3", "Sb2Te3", "MnBi2Te4", "WTe2", "MoS2", "MoSe2", "MoTe2", "WS2", "WSe2", "FeSe", "FeTe", "LiFeAs", "NaFeAs", "BaFe2As2", "BaK122", "Ba0.6K0.4Fe2As2",
    "YBCO", "YBa2Cu3O7", "Bi2212", "Bi2Sr2CaCu2O8", "Bi2201", "LSCO", "LBCO", "CuO2", "Nd2CuO4", "Nd1-xSrxNiO2", "La3Ni2O7", "LaNiO3", "SnSe2", "SnSe", "SnS2", "SnS", "MgB2", "Nb3Sn", "NbN",
    "NbSe2", "2H-NbSe2", "CeCoIn5", "CeIrIn5", "CeCu2Si2", "Hg", "Pb", "Nb", "H3S", "LaH10", "SrTiO3", "KTaO3", "NiPS3", "TaS2", "TaSe2", "TiSe2", "VSe2", "Bi", "Bi111", "1T-TaS2", "2H-TaSe2",
    "graphene", "h-BN", "BN", "black phosphorus", "phosphorene", "MXene", "Ti3C2Tx", "silicene", "germanene", "stanene", "borophene", "antimonene", "bismuthene", "plumbene",
]
GENERIC_MATERIALS = ["cuprate", "cuprates", "nickelate", "nickelates", "iron-based superconductors", "unconventional superconductors", "conventional superconductors", "beamline instrumentation"]


def is_plausible(c: Column, trusted: list[str] | Column) -> Column:
    """Whether a name is a known or trusted material, a class of materials, or a formula.

    A word in capitals is none unless its elements are listed; a formula has two elements, a digit, or is a symbol.
    """
    s = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    low = F.lower(normalize_formula(s))
    names = F.transform(F.array(*map(F.lit, trusted)).cast("array<string>") if isinstance(trusted, list) else trusted, lambda t: F.lower(normalize_formula(t)))
    named = low.isin(*[k.lower() for k in KNOWN_MATERIALS], *GENERIC_MATERIALS) | F.coalesce(F.array_contains(names, low), F.lit(False))
    found = formula_elements(s)
    formula = (F.size(found) >= 2) | ((F.size(found) == 1) & (s.rlike(r"\d") | s.isin(*SYMBOLS)))
    word = s.rlike(r"^[A-Z][A-Z.]+$") & ~s.isin(*ACRONYMS)
    bad = (s == "") | (F.length(s) > 64) | F.upper(s).isin(*STOPWORDS)
    return ~bad & (named | (formula & ~word))


#: Where an ASCII word begins or ends, and what a candidate is made of (a fixed value); 64 characters are the most.
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
CANDIDATE = r"(?:[0-9]+[HTR]-)?(?:[A-Z][a-z]?(?:[0-9.]+|[xy]|delta|Delta|δ|\+|-|\(|\))*?){2,64}"


def formula_candidates(text: Column) -> Column:
    """Formulas of two elements or more in a text, each once, with phase prefix, variables and brackets."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({_EDGE}{CANDIDATE}{_EDGE})"), F.lit(1))
    clean = F.transform(words, lambda w: F.regexp_replace(w, r"[.,;:]+$", ""))
    return F.array_distinct(F.filter(clean, lambda w: is_plausible(w, []) & (F.size(formula_elements(w)) >= 2)))


def clean_materials(materials: Column, trusted: list[str], most: int = 18) -> Column:
    """Plausible names without trailing punctuation, the first spelling of each."""
    clean = F.transform(materials, lambda m: F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(m, F.lit("")), r"\s+", " ")), r"[;,.:]+$", ""))
    key = lambda m: F.lower(normalize_formula(m))

    def first(kept: Column) -> Column:
        keys = F.transform(kept, key)
        return F.filter(kept, lambda m, i: F.array_position(keys, key(m)) == i + 1)

    return F.slice(let(F.filter(clean, lambda m: is_plausible(m, trusted)), first), 1, most)


_TOKEN = r"([A-Z][a-z]?|\d+(?:\.\d+)?|[()\[\]{}])"


def composition(c: Column) -> Column:
    """Map from symbol to count, with nested groups; null for a formula that doesn't parse.

    Tokens are read from the right with a stack of multipliers: a number waits for the symbol or closing bracket
    before it; a closing bracket pushes its multiplier, an opening one pops it.
    """
    start = F.struct(F.array(F.lit(1.0)).alias("stack"), F.lit(1.0).alias("n"), F.array().cast("array<struct<e:string,n:double>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        top, depth = F.element_at(acc["stack"], -1), F.size(acc["stack"])
        keep = lambda stack, n, out: F.struct(stack.alias("stack"), n.alias("n"), out.alias("out"))
        return (
            F.when(t.rlike(r"^\d"), keep(acc["stack"], t.try_cast("double"), acc["out"]))
            .when(t.isin(")", "]", "}"), keep(F.concat(acc["stack"], F.array(top * acc["n"])), F.lit(1.0), acc["out"]))
            .when(t.isin("(", "[", "{"), keep(F.slice(acc["stack"], F.lit(1), F.greatest(depth - 1, F.lit(1))), F.lit(1.0), acc["out"]))
            .otherwise(keep(acc["stack"], F.lit(1.0), F.concat(acc["out"], F.array(F.struct(t.alias("e"), (top * acc["n"]).alias("n"))))))
        )

    def counted(parts: Column) -> Column:
        count = lambda e: F.aggregate(F.filter(parts, lambda p: p["e"] == e), F.lit(0.0), lambda a, p: a + p["n"])
        symbols = F.array_sort(F.array_distinct(F.transform(parts, lambda p: p["e"])))
        return let(symbols, lambda e: F.when((F.size(e) > 0) & (F.size(F.array_except(e, _symbols())) == 0), F.map_from_arrays(e, F.transform(e, count))))

    def parsed(s: Column) -> Column:
        tokens = F.reverse(F.regexp_extract_all(s, F.lit(_TOKEN), F.lit(1)))
        balanced = F.length(F.regexp_replace(s, r"[^(\[{]", "")) == F.length(F.regexp_replace(s, r"[^)\]}]", ""))
        valid = s.rlike(r"^([A-Z][a-z]?|\d+(\.\d{1,8})?|[()\[\]{}])+$") & ~s.rlike(r"\.\d{9}") & s.rlike(r"^[A-Z(\[{]") & balanced
        return F.when(valid, let(F.aggregate(tokens, start, step)["out"], counted))

    return let(normalize_formula(c), parsed)


def formula_error(c: Column) -> Column:
    """Why a formula doesn't parse: empty, bad_character, unbalanced, unknown_symbol, too_precise; null if it does."""
    s = normalize_formula(c)
    found = F.regexp_extract_all(s, F.lit(r"([A-Z][a-z]?)"), F.lit(1))
    balanced = F.length(F.regexp_replace(s, r"[^(\[{]", "")) == F.length(F.regexp_replace(s, r"[^)\]}]", ""))
    return (
        F.when(s == "", "empty")
        .when(~s.rlike(r"^[A-Za-z0-9.()\[\]{}]+$"), "bad_character")
        .when(~balanced, "unbalanced")
        .when(F.size(F.array_except(found, _symbols())) > 0, "unknown_symbol")
        .when(s.rlike(r"\.\d{9,}"), "too_precise")
    )


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's steps over a bounded sequence (counts are below 2^53)."""
    end = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(F.try_mod(s["a"], s["b"])).alias("b")))
    return end["a"]


def composition_key(comp: Column) -> Column:
    """Alphabetical symbols with counts divided by their greatest common divisor (to 8 places)."""
    whole = F.transform(F.map_values(comp), lambda n: F.round(n * 1e8).cast("long"))
    gcd = lambda ns: F.aggregate(ns, F.lit(0).cast("long"), lambda a, b: F.when(a == 0, b).otherwise(_gcd(a, b)))
    reduced = let(whole, lambda ns: let(gcd(ns), lambda g: F.transform(ns, lambda n: F.try_divide(n, g).cast("long").cast("string"))))
    # The map's keys are sorted already.
    return F.array_join(F.zip_with(F.map_keys(comp), reduced, lambda e, n: F.concat(e, n)), " ")


def fractions(comp: Column) -> Column:
    total = F.aggregate(F.map_values(comp), F.lit(0.0), lambda a, n: a + n)
    return let(total, lambda t: F.transform_values(comp, lambda _, n: n / t))


def fraction_key(comp: Column) -> Column:
    """Fractions to 8 places by atomic number."""
    parts = F.array_sort(F.transform(F.map_entries(fractions(comp)), lambda e: F.struct(F.array_position(_symbols(), e["key"]).alias("z"), e["key"].alias("e"), e["value"].alias("f"))))
    return F.array_join(F.transform(parts, lambda p: F.concat(p["e"], F.lit(":"), F.format_number(p["f"], 8))), "|")


def per_formula(df: DataFrame, formula: str, **columns: Callable[[Column], Column]) -> DataFrame:
    """``df`` with functions of its formulas' compositions; each distinct formula is parsed once."""
    known = df.select(formula).distinct().withColumn("__c", composition(F.col(formula)))
    known = known.select(formula, *[f(F.col("__c")).alias(name) for name, f in columns.items()])
    return df.join(known, formula, "left")


def features(df: DataFrame, key: str, comp: str) -> DataFrame:
    """Statistics of each composition over its fractions and atomic numbers, by one grouped aggregation."""
    long = df.select(key, F.explode(fractions(F.col(comp))).alias("e", "f"), F.aggregate(F.map_values(comp), F.lit(0.0), lambda a, n: a + n).alias("total"))
    long = long.withColumn("z", F.array_position(_symbols(), F.col("e")).cast("double"))
    mean = F.sum(F.col("f") * F.col("z"))
    return long.groupBy(key).agg(
        (F.count("*") / 10).alias("n_elements"),
        (F.log1p(F.first("total")) / 5).alias("log_total"),
        (-F.sum(F.col("f") * F.log("f")) / 3).alias("entropy"),
        (mean / 118).alias("mean_z"),
        (F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("f") * F.col("z") * F.col("z")) - mean * mean)) / 118).alias("std_z"),
        (F.min("z") / 118).alias("min_z"),
        (F.max("z") / 118).alias("max_z"),
        ((F.max("z") - F.min("z")) / 118).alias("range_z"),
        F.max("f").alias("max_fraction"),
        F.sqrt(F.sum(F.col("f") * F.col("f"))).alias("norm"),
    )


def feature_vector(comp: Column) -> Column:
    """118 element fractions by atomic number."""
    f = fractions(comp)
    return F.transform(_symbols(), lambda s: F.coalesce(F.element_at(f, s), F.lit(0.0)))
