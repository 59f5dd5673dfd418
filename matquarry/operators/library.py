"""Article library: shaping, classification, enrichment, merging, auditing."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chem as C
from ..functions import extract as X
from ..functions import text as T

#: Rows whose words a task holds at a time.
ROWS = 256


def inverted(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, words: map from each word to its positions, of every row.  Nothing is shuffled: a row's words are its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                words, first, at, start = [], [0], [], [0]
                for t in b.column("text").to_pylist():
                    found: dict[str, list[int]] = {}
                    for i, w in enumerate(w for w in re.split(r"[ \n\t\r]+", t or "") if w):
                        found.setdefault(w, []).append(i)
                    words += found
                    first.append(len(words))
                    for places in found.values():
                        at += places
                        start.append(len(at))
                places = pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.MapArray.from_arrays(pa.array(first, pa.int32()), pa.array(words, pa.string()), places)], names=[key, "words"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{key}` {rows.schema['key'].dataType.simpleString()}, words map<string,array<int>>")


def from_inverted(df: DataFrame, key: str, out: str) -> DataFrame:
    """Text from a map of words to positions; '' for none."""
    pairs = F.flatten(F.transform(F.map_entries("words"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return df.select(key, F.coalesce(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), F.lit("")).alias(out))


def bounded_authors(names: Column, most: int = 12) -> Column:
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(F.size(names) > most, " et al.").otherwise(""))


def to_article(df: DataFrame) -> DataFrame:
    """The article schema: id falls back from DOI to URL, the link from URL to DOI; '' counts as missing."""
    return df.withColumns(
        {
            "id": F.coalesce(F.nullif(T.canonical_doi(F.col("doi")), F.lit("")), T.falsy(F.col("url")), F.lit("row")),
            "link": F.coalesce(T.falsy(F.col("url")), T.falsy(F.col("doi")), F.lit("")),
            "verification_status": F.when(F.col("source") == "curated", "curated").otherwise(F.concat(F.lit("imported:"), F.col("source"))),
        }
    )


def classify(df: DataFrame) -> DataFrame:
    """two_d_categories, superconductivity_categories, topic_tags from title, abstract and keywords."""
    keywords = T.split_keywords(F.col("keywords"))
    context = X.superconductivity_context(F.col("title"), F.col("abstract"), keywords)
    df = df.withColumns({"two_d_categories": X.two_d_categories(F.col("title")), "superconductivity_categories": X.superconductivity_categories(F.col("title"), context)})
    text = F.concat_ws(" ", "title", "abstract", "keywords")
    return df.withColumn("topic_tags", X.topic_tags(text, F.col("title"), F.col("two_d_categories"), F.col("superconductivity_categories"), context))


def normalize_article(df: DataFrame) -> DataFrame:
    """Clean title and DOI, materials without repeats, recomputed techniques and classification."""
    df = df.withColumns({"title": T.clean_metadata(F.col("title"), 700), "doi": T.canonical_doi(F.col("doi")), "materials": T.unique_ci(F.array("material"))})
    return classify(df.withColumn("techniques", X.techniques(F.concat_ws(" ", "title", "abstract", "keywords"))))


def normalize_figures(df: DataFrame) -> DataFrame:
    """Figures with the publisher's caption get its type; those with a generated one are 'Other'."""
    kind = lambda f: F.when(f["caption_source"] == "publisher", X.figure_type(f["caption"])["type"]).otherwise("Other")
    return df.withColumn("figures", F.transform("figures", lambda f: F.struct(f["figure_index"].alias("figure_index"), f["caption"].alias("caption"), kind(f).alias("type"))))


def supported_publisher(doi: Column, journal: Column, rules: dict[str, str]) -> Column:
    out = F.lit(False)
    for prefix, pattern in rules.items():
        out = out | (T.canonical_doi(doi).startswith(prefix) & journal.rlike(pattern))
    return out


def enrich_by_doi(articles: DataFrame, registry: DataFrame) -> DataFrame:
    """Venue and licence, where the article has none, from the registry on the canonical DOI; it joins the sources."""
    r = registry.select(F.col("doi").alias("r_doi"), F.col("venue").alias("r_venue"), F.col("licence").alias("r_licence"))
    both = articles.join(r, T.canonical_doi(articles.doi) == F.col("r_doi"), "left")
    sources = F.array_compact(F.array("source", F.when(F.col("r_doi").isNotNull(), "registry")))
    own = lambda c: T.falsy(F.col(c)) if c in articles.columns else F.lit(None)
    return both.withColumns({"venue": F.coalesce(own("venue"), "r_venue"), "licence": F.coalesce(own("licence"), "r_licence", F.lit("")), "sources": sources}).drop("r_doi", "r_venue", "r_licence")


def merge_duplicates(df: DataFrame) -> DataFrame:
    """One row for each article key: union of sources and materials, largest citations, first URL that isn't ''.

    Only fixed-size aggregates and sets of sources and materials are kept for a key, so a key with very many
    records needs no more memory than its distinct values.
    """
    keyed = df.withColumn("article_key", T.article_key(F.col("doi"), F.col("title"), F.col("year")))
    return keyed.groupBy("article_key").agg(
        F.min("seq").alias("seq"),
        F.min_by("title", "seq").alias("title"),
        F.array_join(F.sort_array(F.collect_set("source")), " + ").alias("source"),
        F.max("citations").alias("citations"),
        F.coalesce(F.min_by(F.nullif("url", F.lit("")), F.when(F.col("url") != "", F.col("seq"))), F.lit("")).alias("url"),
        F.count("*").alias("merged"),
        F.sort_array(F.collect_set("material")).alias("materials"),
    )


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first record of each key; whole rows meet as aggregates, so hot keys combine on the tasks first."""
    row = F.struct(*df.columns)
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min_by(row, F.col(order)).alias("r")).select("r.*")


def audit(df: DataFrame) -> DataFrame:
    """Counts of articles, identities, duplicates and rule violations for each source."""
    keyed = df.withColumn("article_key", T.article_key(F.col("doi"), F.col("title"), F.col("year")))
    return keyed.groupBy("source").agg(
        F.count("*").alias("articles"),
        F.countDistinct("article_key").alias("identities"),
        (F.count("*") - F.countDistinct("article_key")).alias("duplicates"),
        F.count_if(F.col("url") == "").alias("no_url"),
        F.count_if(F.col("year") < 2016).alias("too_old"),
        F.count_if(F.contains(F.col("doi"), F.lit("DOI"))).alias("raw_doi"),
    )


#: Types that a figure may have (fixed values).
FIGURE_TYPES = ["Fermi surface", "Band structure", "Gap map", "Temperature / doping dependence", "Charge order", "EDC/MDC analysis", "Theory comparison", "Other"]


def audit_rules(df: DataFrame, trusted: list[str]) -> DataFrame:
    """Violations of nine rules for each source, and whether it passes.

    ``df`` holds source, title, abstract, keywords (text), materials, elements, techniques, two_d_categories,
    superconductivity_categories, topic_tags (lists) and figures (array of struct(type, type_source, caption_source,
    classification_confidence, publisher_caption)).  Stored classifications are compared with recomputed ones.
    """
    stored = {c: f"stored_{c}" for c in ("two_d_categories", "superconductivity_categories", "topic_tags")}
    df = classify(df.withColumnsRenamed(stored))
    derived = C.elements_of(F.col("materials"))
    figures = F.coalesce("figures", F.array().cast(dict(df.dtypes)["figures"]))
    absent = lambda c: F.coalesce(c, F.lit("")) == ""
    by_caption = lambda f: F.coalesce(f["type_source"], F.lit("")) == "publisher_caption"
    count = lambda values, rule: F.size(F.filter(values, rule))

    def mismatch(f: Column) -> Column:
        kind = X.figure_type(f["publisher_caption"])
        return by_caption(f) & ((kind["type"] != f["type"]) | (kind["confidence"] != f["classification_confidence"]))

    text = F.concat_ws(" ", "title", "abstract", "keywords")
    rules = {
        "suspicious_materials": count("materials", lambda m: ~C.is_plausible(m, trusted)),
        "invalid_elements": count("elements", lambda e: ~e.isin(*C.SYMBOLS)),
        "mismatched_elements": F.size(F.array_except("elements", derived)),
        "figure_metadata_missing": count(figures, lambda f: absent(f["type_source"]) | absent(f["classification_confidence"]) | absent(f["caption_source"]) | (by_caption(f) & absent(f["publisher_caption"]))),
        "figure_classification_mismatches": count(figures, mismatch),
        "invalid_figure_types": count(figures, lambda f: ~F.coalesce(f["type"].isin(*FIGURE_TYPES), F.lit(False))),
        "invalid_two_d_categories": count(F.col("stored_two_d_categories"), lambda c: ~c.isin(*[name for name, _ in X.TWO_D])),
        "unsupported_arpes_tags": (F.array_contains("techniques", "ARPES") & ~text.rlike(r"(?i)\bARPES\b|angle[- ]resolved photoemission|photoemission spectroscopy")).cast("int"),
        "classification_mismatches": (~((F.col("stored_two_d_categories") == F.col("two_d_categories")) & (F.col("stored_superconductivity_categories") == F.col("superconductivity_categories")) & (F.col("stored_topic_tags") == F.col("topic_tags")))).cast("int"),
    }
    each = df.select("source", *[v.alias(k) for k, v in rules.items()])
    g = each.groupBy("source").agg(F.count("*").alias("articles"), *[F.sum(k).alias(k) for k in rules])
    return g.withColumn("passed", sum((F.col(k) for k in rules), F.lit(0)) == 0)


def upsert(existing: DataFrame, incoming: DataFrame, key: str, batch: str) -> DataFrame:
    """Last write wins for each key; the position (smallest ``seq``) of the first write is kept."""
    both = existing.unionByName(incoming, allowMissingColumns=True)
    w = Window.partitionBy(key)
    ranked = both.withColumn("__n", F.row_number().over(w.orderBy(F.desc(batch), F.desc("seq")))).withColumn("seq", F.min("seq").over(w))
    return ranked.where("__n = 1").drop("__n")
