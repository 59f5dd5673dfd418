"""Facts from article text: titles, identifiers, materials, conditions, measured values, classifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import compact_text, unique_ci


def guess_title(text: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda s: F.trim(s))
    good = F.filter(lines, lambda s: (F.length(s) >= 8) & (F.length(s) <= 220) & ~F.lower(s).rlike("^(abstract|doi|arxiv)"))
    return F.get(good, F.lit(0))


def first_doi(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\b(10\.\d{4,9}/[-._;()/:A-Z0-9]+)\b", 1), r"\.+$", ""), F.lit(""))


def first_preprint_id(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\barXiv:\s*(\d{4}\.\d{4,5}(?:v\d+)?)\b", 1), F.lit(""))


def _quoted(s: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in s)


def contains_alias(text: Column, alias: str) -> Column:
    """The alias between characters that are neither letters nor digits, in any case."""
    return text.rlike(rf"(?i)(^|[^A-Za-z0-9]){_quoted(alias)}($|[^A-Za-z0-9])")


def match_names(text: Column, names: dict[str, list[str]]) -> Column:
    """Names with an alias in the text, in the dictionary's order."""
    found = []
    for name, aliases in names.items():
        hit = F.lit(False)
        for a in aliases:
            hit = hit | contains_alias(text, a)
        found.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*found))


def flags(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Labels whose pattern occurs, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(label)) for label, p in rules]))


#: Keyword labels on lower-cased text (fixed values).
KEYWORDS = [
    ("ARPES", r"arpes|angle-resolved photoemission"),
    ("nano-ARPES", r"nano-arpes|nanoarpes"),
    ("spin-ARPES", r"spin-resolved arpes|spin arpes"),
    ("DFT", r"density functional theory| dft "),
    ("STM", r"scanning tunneling microscopy| stm "),
]


def technique_flags(text: Column) -> Column:
    return flags(F.lower(compact_text(text)), KEYWORDS)


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def photon_energies(text: Column) -> Column:
    return unique_ci(_all(compact_text(text), r"(?i)(?:photon energ(?:y|ies)|hν|hv)\s*(?:of|=|:|were|was)?\s*(\d+(?:\.\d+)?(?:\s*(?:-|to|–)\s*\d+(?:\.\d+)?)?)\s*eV"))


def temperatures(text: Column) -> Column:
    return unique_ci(_all(compact_text(text), r"(?i)\bat\s*(\d+(?:\.\d+)?)\s*K\b"))


def band_gaps(text: Column) -> Column:
    """'value unit' of both orders of words."""
    t = compact_text(text)
    first = r"(?i)(?:band gap|gap)\s*(?:of|=|:|is|was)?\s*(\d+(?:\.\d+)?)\s*(meV|eV)"
    last = r"(?i)(\d+(?:\.\d+)?)\s*(meV|eV)\s*(?:band gap|gap)"
    pairs = [F.zip_with(_all(t, p, 1), _all(t, p, 2), lambda v, u: F.concat_ws(" ", v, u)) for p in (first, last)]
    return unique_ci(F.concat(*pairs))


def gap_eV(text: Column) -> Column:
    """The first gap in eV; meV are converted."""
    first = F.get(band_gaps(text), F.lit(0))
    value = F.split_part(first, F.lit(" "), F.lit(1)).try_cast("double")
    return F.when(F.lower(first).endswith("mev"), value / 1000).otherwise(value)


def fermi_velocities(text: Column) -> Column:
    return unique_ci(_all(compact_text(text), r"(?i)(?:Fermi velocity|vF|v_F)\s*(?:of|=|:)?\s*(\d+(?:\.\d+)?\s*(?:eV\s*[ÅA]|\d*\s*m/s|m\s*s-1)?)"))


def snippets(text: Column, kind: str) -> Column:
    """Beamline, analyzer or preparation snippets, with Unicode word characters."""
    patterns = {
        "beamline": r"(?U)((?:beamline|Beamline|BL)\s*[-\w ]{1,60}|(?:synchrotron|Synchrotron)\s+[-\w ,()]{1,100})",
        "analyzer": r"(?iU)((?:Scienta|DA30|R4000|MBS|hemispherical analyzer|electron analyzer)[-\w. ,()]{0,80})",
        "preparation": r"(?iU)((?:grown|synthesi[sz]ed|prepared|cleaved|doped|intercalated|molecular beam epitaxy|MBE|chemical vapor transport|CVT)[-\w ,;()/%]{0,160})",
    }
    return unique_ci(_all(F.coalesce(text, F.lit("")), patterns[kind]))


#: Relevance patterns and weights (fixed values).
RELEVANCE = [
    (r"\bangle[- ]resolved photoemission\b", 0.55),
    (r"\bARPES\b", 0.45),
    (r"\bphotoemission spectroscopy\b", 0.2),
    (r"\bFermi surface\b", 0.12),
    (r"\bsuperconducting gap\b", 0.14),
    (r"\bband structure\b", 0.08),
    (r"\bsuperconduct(or|ors|ing|ivity)?\b", 0.12),
]


def relevance_score(text: Column) -> Column:
    """0 unless one of the first three patterns occurs; else the bounded sum of weights."""
    gate = text.rlike("(?i)" + "|".join(p for p, _ in RELEVANCE[:3]))
    total = sum((F.when(text.rlike("(?i)" + p), w).otherwise(0.0) for p, w in RELEVANCE), F.lit(0.0))
    return F.when(gate, F.round(F.least(F.lit(1.0), total), 2)).otherwise(0.0)


#: Technique rules, in order (fixed values).
TECHNIQUES = [
    ("ARPES", r"(?i)\bARPES\b|angle[- ]resolved photoemission"),
    ("XPS", r"(?i)\bXPS\b|x[- ]ray photoelectron"),
    ("XRD", r"(?i)\bXRD\b|x[- ]ray diffraction"),
    ("STM", r"(?i)\bSTM\b|scanning tunneling"),
    ("TEM", r"(?i)\bTEM\b|transmission electron"),
    ("DFT", r"(?i)\bDFT\b|density functional theory|first[- ]principles"),
    ("MBE", r"(?i)\bMBE\b|molecular beam epitaxy"),
    ("CVT", r"(?i)\bCVT\b|chemical vapor transport"),
    ("Raman", r"(?i)\bRaman\b"),
    ("neutron", r"(?i)neutron (scattering|diffraction)"),
    ("transport", r"(?i)\bresistivity\b|\btransport\b|Hall effect"),
    ("SQUID", r"(?i)\bSQUID\b|magnetic susceptibility"),
]
#: Two-dimensional categories; the last needs a two-dimensional context (fixed values).
TWO_D = [
    ("graphene", r"(?i)\bgraphene\b|\b(mono|bi|tri|few)[- ]?layer graphite\b"),
    ("tmds", r"(?i)\bTMDs?\b|\btransition[- ]metal (di)?chalcogenides?\b|\b(Mo|W|Nb|Ta|Ti|V)(S|Se|Te)2\b"),
    ("hbn", r"(?i)\bh-?BN\b|\bboron nitride\b"),
    ("black-phosphorus", r"(?i)\bblack phosphorus\b|\bphosphorene\b"),
    ("mxene", r"(?i)\bMXenes?\b|\bTi3C2T?x?\b"),
    ("xenes", r"(?i)\bXenes?\b|\b(silicene|germanene|stanene|borophene|antimonene|bismuthene|plumbene)\b"),
    ("cof-mof", r"(?i)\b(COF|MOF)s?\b|\bcovalent organic frameworks?\b|\bmetal[- ]organic frameworks?\b"),
]
TWO_D_CONTEXT = r"(?i)\b(2D|two[- ]dimensional|layered|monolayer|bilayer|few[- ]layer|nanosheet)\b"
#: Superconductor categories; ``tmd`` needs an explicit context (fixed values).
SUPERCONDUCTORS = [
    ("cuprate", r"(?i)\bcuprates?\b|\b(YBCO|LSCO|LBCO|Bi2212|Bi2201|BSCCO|YBa2Cu3O7|Bi2Sr2CaCu2O8)\b"),
    ("iron-based", r"(?i)\biron[- ]based\b|\biron (pnictide|chalcogenide)s?\b|\b(FeSe|FeTe|LiFeAs|NaFeAs|BaFe2As2|BaK122)\b"),
    ("nickelate", r"(?i)\bnickelates?\b|\b(Nd1-xSrxNiO2|La3Ni2O7|LaNiO3)\b"),
    ("conventional", r"(?i)\bconventional superconduct|\b(MgB2|Nb3Sn|NbN)\b"),
    ("tmd", r"(?i)\b(NbSe2|TaS2|TaSe2|TiSe2)\b|\bsuperconducting (transition[- ]metal )?(di)?chalcogenide"),
    ("heavy-fermion", r"(?i)\bheavy[- ]fermion\b|\b(CeCoIn5|CeIrIn5|CeCu2Si2|UPt3|UBe13)\b"),
    ("hydride", r"(?i)\bhydride superconduct|\b(H3S|LaH10|H2S|C-S-H|CSH)\b"),
]
SUPERCONDUCTIVITY = r"(?i)\bsuperconduct(or|ors|ing|ivity)?\b|\bCooper pairs?\b|\bpairing symmetry\b"
#: Figure types by caption, the first match wins (fixed values).
FIGURES = [
    ("Fermi surface", r"(?i)\bfermi surface|\bFSs?\b|constant[- ]energy (map|contour)"),
    ("Gap map", r"(?i)\bsuperconducting gap|\bgap (map|anisotropy|distribution|magnitude|sign)"),
    ("Temperature / doping dependence", r"(?i)\btemperature[- ]dependen|\bdoping[- ]dependen|\bphase diagram|\bversus temperature|\bas a function of (temperature|doping)"),
    ("Charge order", r"(?i)\bcharge[- ]density wave|\bCDW\b|\bcharge order|\breconstruction|\bband folding"),
    ("EDC/MDC analysis", r"(?i)\bEDCs?\b|\bMDCs?\b|energy distribution curves?|momentum distribution curves?|\bline ?shape|self[- ]energy"),
    ("Theory comparison", r"(?i)\bDFT\b|first[- ]principles|theoretical calculation|calculated (band|spectrum|dispersion)|theory comparison"),
    ("Band structure", r"(?i)\bband structure|\bband dispersion|energy[- ]momentum|photoemission spectra?|ARPES (maps?|intensit(y|ies)|spectr(um|a))"),
]


def techniques(text: Column) -> Column:
    return flags(text, TECHNIQUES)


def two_d_categories(text: Column) -> Column:
    context = text.rlike(TWO_D_CONTEXT)
    return F.array_compact(F.array(*[F.when(text.rlike(p) & (context if label == "cof-mof" else F.lit(True)), F.lit(label)) for label, p in TWO_D]))


def superconductivity_categories(text: Column, context: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p) & (context if label == "tmd" else F.lit(True)), F.lit(label)) for label, p in SUPERCONDUCTORS]))


def superconductivity_context(title: Column, abstract: Column, keywords: Column) -> Column:
    """Keywords all in capitals come from an index and don't count."""
    own = F.filter(keywords, lambda k: ~((F.length(F.regexp_replace(k, "[^A-Za-z]", "")) >= 3) & (F.regexp_replace(k, "[^A-Za-z]", "") == F.upper(F.regexp_replace(k, "[^A-Za-z]", "")))))
    return F.concat_ws(" ", title, abstract, F.array_join(own, " ")).rlike(SUPERCONDUCTIVITY)


def topic_tags(text: Column, category_text: Column, two_d: Column, superconductors: Column, context: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(text.rlike(r"(?i)\b(ARPES|angle[- ]resolved photoemission|photoemission spectroscopy)\b"), F.lit("arpes")),
            F.when(context | (F.size(F.array_remove(superconductors, "tmd")) > 0), F.lit("superconductivity")),
            F.when((F.size(two_d) > 0) | category_text.rlike(r"(?i)\b(2D|two[- ]dimensional|monolayer|bilayer|few[- ]layer)\b"), F.lit("2d-materials")),
            F.when(text.rlike(r"(?i)\b(beamline|endstation|analy[sz]er|instrumentation|spectrometer)\b"), F.lit("instrumentation")),
        )
    )


def figure_type(caption: Column) -> Column:
    out = F.struct(F.lit("Other").alias("type"), F.lit("unclassified").alias("confidence"))
    for label, p in reversed(FIGURES):
        out = F.when(caption.rlike(p), F.struct(F.lit(label).alias("type"), F.lit("high").alias("confidence"))).otherwise(out)
    return out


def extraction_confidence(materials: Column, techniques_: Column, dopants: Column, conditions: Column, properties: Column) -> Column:
    """35, 20, 15, 15 and 15 points for lists that aren't empty."""
    return sum((F.when(F.size(c) > 0, n).otherwise(0) for c, n in ((materials, 35), (techniques_, 20), (dopants, 15), (conditions, 15), (properties, 15))), F.lit(0)).cast("long")
