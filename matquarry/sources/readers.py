"""Readers of landed files with explicit schemas, and sinks.  Fetching is left to whatever lands the files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import payloads

WORK = (
    "id string, doi string, display_name string, publication_year int, cited_by_count int, authorships array<struct<author:struct<display_name:string>>>, "
    "primary_location struct<source:struct<display_name:string>>, open_access struct<oa_url:string>, concepts array<struct<display_name:string>>, abstract_inverted_index map<string,array<int>>"
)
ATOM = ("id string, title string, summary string, published string, author array<struct<name:string>>, link array<struct<_href:string,_type:string,_title:string>>")
ARTICLE = ("id string, title string, year int, source string, doi string, url string, abstract string, materials array<string>, keywords array<string>")
DFT = ("jid string, atoms struct<elements:array<string>>, formation_energy_peratom string, optb88vdw_bandgap string")
SAMPLE = ("id string, material string, features array<double>, createdAt string")


def read_article_texts(spark: SparkSession, path: str) -> DataFrame:
    """source_file, text of all .txt, .md, .xml and .tei files below ``path``."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md,xml,tei}").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))


def _header(name: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in name.lower()).split())


def read_index_export(spark: SparkSession, path: str) -> DataFrame:
    """A delimited export with any of ',', tab or ';' and any header names; names are lower-cased, '_' between words."""
    first = spark.read.text(path).first()
    line = first.value.lstrip("﻿") if first else ""
    sep = max(",\t;", key=line.count)
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[_header(c.lstrip("﻿")).replace(" ", "_") for c in df.columns])


def read_tagged(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Tab-delimited exports with two-letter tags; rows without a title are skipped."""
    df = spark.read.option("header", True).option("sep", "\t").option("encoding", encoding).option("quote", "").csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    return df.where(F.trim(F.coalesce("TI", F.lit(""))) != "")


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """key, fields (map from lower-case name to value without braces)."""
    entry = r"(?s)@\w+\s*\{([^,]+),(.*?)\n\s*\}"
    files = spark.read.text(path, wholetext=True)
    found = files.select(F.explode(F.arrays_zip(F.regexp_extract_all("value", F.lit(entry), F.lit(1)).alias("key"), F.regexp_extract_all("value", F.lit(entry), F.lit(2)).alias("body"))).alias("e"))
    field = r'(\w+)\s*=\s*[{"]((?:[^{}"]|\{[^{}]*\})*)[}"]'
    body = F.col("e.body")
    clean = lambda v: F.replace(F.regexp_replace(v, r"[{}]", ""), F.lit("\\&"), F.lit("&"))
    pairs = F.zip_with(F.regexp_extract_all(body, F.lit(field), F.lit(1)), F.regexp_extract_all(body, F.lit(field), F.lit(2)), lambda k, v: F.struct(F.lower(k), clean(v)))
    return found.select(F.trim(F.col("e.key")).alias("key"), F.map_from_entries(pairs).alias("fields"))


def read_works_json(spark: SparkSession, path: str) -> DataFrame:
    w = spark.read.schema(WORK).json(path)
    return w.select(
        "id", F.col("display_name").alias("title"), F.col("publication_year").alias("year"), "doi", F.col("cited_by_count").alias("citations"),
        F.transform("authorships", lambda a: a["author"]["display_name"]).alias("authors"), F.col("primary_location.source.display_name").alias("venue"),
        F.col("open_access.oa_url").alias("url"), F.transform("concepts", lambda c: c["display_name"]).alias("concepts"), F.col("abstract_inverted_index").alias("words"),
    )


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    e = spark.read.format("xml").option("rowTag", "entry").schema(ATOM).load(path)
    pdf = F.filter("link", lambda x: x["_title"] == "pdf")
    return e.select("id", F.trim("title").alias("title"), "summary", F.left("published", F.lit(4)).try_cast("int").alias("year"), F.transform("author", lambda a: a["name"]).alias("authors"), F.get(pdf, F.lit(0))["_href"].alias("pdf"))


def first_present(*columns: Column) -> Column:
    """The first column that isn't null, '' or blank."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns])


def read_articles(spark: SparkSession, *paths: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.schema(ARTICLE).option("multiLine", True).json(p) for p in paths])


def read_catalog(topics: DataFrame) -> DataFrame:
    """One row for each material of each topic, with its family's name."""
    m = topics.select("topic", "families", F.explode("materials").alias("m"))
    family = F.get(F.filter("families", lambda f: f["id"] == F.col("m.family")), F.lit(0))["name"]
    return m.select("topic", F.col("m.name").alias("material"), F.coalesce(family, F.col("m.family")).alias("family"), F.coalesce("m.transition_temperature_K", "m.tc_K").alias("tc_K"))


def read_training(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) records; rejected ones carry an error code."""
    rows = spark.read.schema(DFT).json(path).withColumns({"formation": F.col("formation_energy_peratom").try_cast("double"), "gap": F.col("optb88vdw_bandgap").try_cast("double")})
    return split_errors(rows, F.when(F.col("jid").isNull(), "no_id").when(F.coalesce(F.size("atoms.elements"), F.lit(0)) < 1, "no_elements").when(F.col("formation").isNull() & F.col("gap").isNull(), "no_target"))


def split_errors(rows: DataFrame, code: Column) -> tuple[DataFrame, DataFrame]:
    coded = rows.withColumn("error_code", code)
    return coded.where(F.col("error_code").isNull()).drop("error_code"), coded.where(F.col("error_code").isNotNull())


def read_model_results(spark: SparkSession, path: str) -> DataFrame:
    """The results of ``payloads.model_results``: one row for each property of each candidate, from payloads of any form."""
    return payloads.model_results(spark, path)[0]


def read_samples(spark: SparkSession, path: str, least: int = 20) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.schema(SAMPLE).json(path).withColumn("features", F.transform("features", lambda x: F.round(x, 4)))
    return split_errors(rows, F.when(F.coalesce(F.trim("material"), F.lit("")) == "", "no_material").when(F.coalesce(F.size("features"), F.lit(0)) < least, "too_few_features"))


def _band_lines(spark: SparkSession, path: str) -> DataFrame:
    """dataset, seq, line, cells of each line; 'd' exponents are read as 'e'."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("dataset"), F.posexplode(F.split("value", r"\r\n?|\n")).alias("seq", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace(F.regexp_replace("line", "\ufeff", ""), r"(?<=\d)[dD](?=[+-]?\d)", "e")))
    return lines.withColumn("cells", F.filter(F.split("line", r"[\s,;]+"), lambda c: c != ""))


def read_band_matrix(spark: SparkSession, path: str) -> DataFrame:
    """dataset, band, seq, k, energy from files of rows 'k e1 e2 ...'; words that are no numbers are gaps."""
    rows = _band_lines(spark, path).where(F.col("line").rlike(r"^[+-]?[\d.]"))
    cells = F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0)))
    return rows.select("dataset", "seq", F.get("cells", F.lit(0)).try_cast("double").alias("k"), F.posexplode(cells).alias("band", "e")).select("dataset", "band", "seq", "k", F.col("e").try_cast("double").alias("energy"))


def read_band_table(spark: SparkSession, path: str) -> DataFrame:
    """dataset, band, seq, k, energy from files with a header that names band, k and energy, in any order."""
    lines = _band_lines(spark, path).where(F.size("cells") > 0)
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"\([^)]*\)|\[[^\]]*\]", ""), r"[^a-z0-9]+", "")
    names = lines.groupBy("dataset").agg(F.min_by("cells", "seq").alias("header"), F.min("seq").alias("top"))
    place = lambda pattern: F.aggregate(F.sequence(F.size("header") - 1, F.lit(0), F.lit(-1)), F.lit(None).cast("int"), lambda a, i: F.when(clean(F.get("header", i)).rlike(pattern), i).otherwise(a))
    at = names.select("dataset", "top", place(r"^(band|bandindex|iband|bandid)$").alias("b"), place(r"^(k|kpath|kdistance|kpathdistance)$").alias("x"), place(r"^(e|energy|eigenvalue|eigenenergy)$").alias("y"))
    rows = lines.join(at.where("b is not null and x is not null and y is not null"), "dataset").where("seq > top")
    cell = lambda i: F.get("cells", F.col(i))
    out = rows.select("dataset", cell("b").alias("band"), "seq", cell("x").try_cast("double").alias("k"), cell("y").try_cast("double").alias("energy"))
    return out.where("band is not null and k is not null and energy is not null")


def read_band_blocks(spark: SparkSession, path: str) -> DataFrame:
    """dataset, band, seq, k, energy from files of two columns; blank lines part the bands (one band without them)."""
    lines = _band_lines(spark, path)
    # The number of blank lines before a line; runs of them count once below.
    blanks = F.count_if(F.col("line") == "").over(Window.partitionBy("dataset").orderBy("seq"))
    rows = lines.withColumn("blanks", blanks).select("dataset", "blanks", "seq", F.get("cells", F.lit(0)).try_cast("double").alias("k"), F.get("cells", F.lit(1)).try_cast("double").alias("energy")).where("k is not null and energy is not null")
    band = F.dense_rank().over(Window.partitionBy("dataset").orderBy("blanks"))
    return rows.select("dataset", band.alias("band"), "seq", "k", "energy")


#: Where index APIs keep their records, in order of preference (fixed values).
HIT_FIELDS = ["hits", "records", "documents", "data", "metadata.records", "results"]
_KEYWORDS = "struct<authorKeywords:array<string>,keywordsPlus:array<string>>"
_RECORD = (
    "uid string, UID string, ut string, id string, title string, titles struct<title:string>, name string, doi string, DOI string, url string, year string, publicationYear string, timesCited string, citationCount string, "
    f"identifiers struct<doi:string,DOI:string>, source struct<publishYear:string,publishedYear:string,sourceTitle:string,title:string,journalTitle:string>, sourceTitle string, keywords {_KEYWORDS}, "
    "names struct<authors:array<struct<displayName:string,name:string>>>, authors array<struct<displayName:string,name:string>>, links struct<record:string,wos:string>, citations array<struct<count:string>>"
)


def read_index_api_json(spark: SparkSession, path: str) -> DataFrame:
    """The article fields of landed index-API responses, one JSON document a file or line.

    Records come from the first field of ``HIT_FIELDS`` that holds any; each value from the first of its names.
    """
    typed = _RECORD.replace(", ", ",")
    record = "struct<" + ",".join(f"{n}:{t}" for n, t in (x.split(" ", 1) for x in _split_fields(typed))) + ">"
    lists = [f"{n} array<{record}>" for n in HIT_FIELDS if "." not in n] + [f"metadata struct<records:array<{record}>>"]
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        raw = spark.read.schema(", ".join(lists)).option("multiLine", True).json(path)
        some = [F.when(F.size(F.col(f)) > 0, F.col(f)) for f in HIT_FIELDS]
        r = raw.select(F.posexplode(F.coalesce(*some)).alias("n", "r"), F.col("_metadata.file_name").alias("file"))
        pick = lambda *names: first_present(*[F.col(f"r.{n}") for n in names])
        uid, doi = pick("uid", "UID", "ut", "id"), F.regexp_replace(pick("identifiers.doi", "identifiers.DOI", "doi", "DOI"), r"(?i)^https?://doi\.org/", "")
        people = F.coalesce("r.names.authors", "r.authors")
        words = F.concat(F.coalesce("r.keywords.authorKeywords", F.array()), F.coalesce("r.keywords.keywordsPlus", F.array()))
        out = r.select(
            F.coalesce(uid, doi, F.concat("file", F.lit("-"), "n")).alias("id"), uid.alias("wos_uid"), pick("title", "titles.title", "name").alias("title"),
            pick("source.publishYear", "source.publishedYear", "year", "publicationYear").try_cast("int").alias("year"), pick("source.sourceTitle", "source.title", "source.journalTitle", "sourceTitle").alias("source_title"),
            F.array_join(F.transform(people, lambda a: F.coalesce(a["displayName"], a["name"])), "; ").alias("authors"),
            first_present(F.col("r.links.record"), F.col("r.links.wos"), F.col("r.url"), F.concat(F.lit("https://www.webofscience.com/wos/woscc/full-record/"), uid)).alias("url"),
            doi.alias("doi"), F.array_distinct(words).alias("keywords"), F.coalesce(F.get("r.citations", F.lit(0))["count"], pick("timesCited", "citationCount")).try_cast("int").alias("citations"),
        )
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    return out


def _split_fields(schema: str) -> list[str]:
    """The top-level fields of a DDL string."""
    depth, parts, at = 0, [], 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(schema[at:i])
            at = i + 1
    return [*parts, schema[at:]]


#: Reference dimensions by name: schema of the landed JSON file (fixed values).
DIMENSIONS = {
    "elements": "symbol string, name string, number int, group int, period int, category string",
    "search_sources": "name string, url string, kind string",
    "materials": "name string, aliases array<string>, family string",
    "knowledge": "material string, family string, traits array<string>",
}


def read_dimension(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A reference dimension (``DIMENSIONS``) from a landed JSON array or JSON lines; rows without their key are dropped."""
    df = spark.read.schema(DIMENSIONS[name]).option("multiLine", True).json(path)
    return df.where(F.col(df.columns[0]).isNotNull()).dropDuplicates([df.columns[0]])


def write_library(articles: DataFrame, path: str, order: list[Column], most: int = 120) -> DataFrame:
    """Writes the ``most`` first articles in ``order`` as JSON; returns one row of statistics of what was written.

    The cap is the feature: a top-k, taken by partial top-k on the tasks.
    """
    articles.orderBy(*order).limit(most).write.mode("overwrite").json(path)
    written = articles.sparkSession.read.schema(articles.schema).json(path)
    total = articles.agg(F.count("*").alias("candidates"))
    return written.agg(F.count("*").alias("written"), F.countDistinct("source").alias("sources"), F.min("year").alias("first_year"), F.max("year").alias("last_year")).join(total, F.lit(True))


def write_samples(samples: DataFrame, path: str, digits: int = 4) -> None:
    """Labelled samples as JSON lines: id, material, features rounded to ``digits``, createdAt."""
    rounded = F.transform("features", lambda x: F.round(x, digits))
    samples.select("id", "material", rounded.alias("features"), "createdAt").write.mode("overwrite").json(path)


def write_extraction(df: DataFrame, path: str) -> None:
    """JSON lines with lists, and a CSV summary with lists joined by '; '."""
    df.write.mode("overwrite").json(f"{path}/json")
    flat = [F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
