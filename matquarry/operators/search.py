"""Search and roll-up over article libraries.  Queries are few and explicit; their table is broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut

#: Weights by field (fixed values).
WEIGHTS = {"materials": 50, "dopants": 35, "elements": 25, "techniques": 15, "keywords": 15, "title": 10, "evidence": 10}
#: Query terms that are broadcast at a time; more are worked through in blocks.
BLOCK = 10_000


def terms(queries: DataFrame) -> DataFrame:
    """qid, term: lower-case terms split on blanks and commas."""
    words = F.filter(F.split(F.lower("query"), r"[\s,，]+"), lambda w: w != "")
    return queries.select("qid", F.explode(words).alias("term"))


def _blocks(stated: DataFrame, block: int = BLOCK) -> list[DataFrame]:
    """Parts of a table of stated queries or terms, each small enough to broadcast; together they are all rows."""
    n = -(-stated.count() // block)
    part = F.pmod(F.xxhash64(*stated.columns), F.lit(2 * n))
    return [stated] if n <= 1 else [stated.where(part == i) for i in range(2 * n)]


def _meet(rows: DataFrame, stated: DataFrame, on: Column | None = None) -> DataFrame:
    """All rows against all stated queries, in blocks."""
    return reduce(DataFrame.unionAll, [rows.join(F.broadcast(b), F.lit(True) if on is None else on) for b in _blocks(stated)])


def search_articles(articles: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """qid, key, score, reasons of articles with a score.

    Every term that occurs in a field adds the field's weight.  Terms of one or two characters only look at the
    start of materials and for equal elements.  Each article meets the broadcast terms once (stated queries
    against all rows); scores are added up on the task that holds the article's rows.
    """
    fields = [f for f in WEIGHTS if f in articles.columns]
    t = F.col("term")

    def hit(field: str):
        values = F.array(field) if field == "title" else F.col(field)
        short = {"materials": lambda v: F.lower(v).startswith(t), "elements": lambda v: F.lower(v) == t}
        long_hit = F.exists(values, lambda v: F.contains(F.lower(v), t))
        return F.when(F.length(t) > 2, long_hit).otherwise(F.exists(values, short[field]) if field in short else F.lit(False))

    found = _meet(articles, terms(queries))
    points = reduce(lambda a, b: a + b, [F.when(hit(f), WEIGHTS[f]).otherwise(0) for f in fields])
    reasons = F.array_compact(F.array(*[F.when(hit(f), F.concat(F.lit(f + ":"), t)) for f in fields]))
    scored = found.select("qid", key, points.cast("long").alias("points"), reasons.alias("why")).where("points > 0")
    return scored.groupBy("qid", key).agg(F.sum("points").alias("score"), F.array_distinct(F.flatten(F.collect_list("why"))).alias("reasons"))


def search_names(df: DataFrame, queries: DataFrame, fields: list[str], key: str) -> DataFrame:
    """qid and rows whose field equals a short term or holds a longer one."""
    t = F.col("term")
    hit = reduce(lambda a, b: a | b, [F.when(F.length(t) <= 2, F.lower(f) == t).otherwise(F.contains(F.lower(f), t)) for f in fields])
    return _meet(df, terms(queries), hit).select("qid", *df.columns).dropDuplicates(["qid", key])


def lookup_catalog(catalog: DataFrame, queries: DataFrame, name: str, context: str, most: int) -> DataFrame:
    """The ``most`` best entries of each query: equal +100, contained +40, a word equal +30 or in the text +5."""
    q, n = F.lower("query"), F.lower(name)
    hay = F.concat_ws(" ", n, F.lower(context))
    words = F.aggregate(F.split(q, r"\s+"), F.lit(0), lambda acc, w: acc + F.when(n == w, 30).when(F.contains(hay, w), 5).otherwise(0))
    score = F.when(n == q, 100).otherwise(0) + F.when(F.contains(n, q), 40).otherwise(0) + words
    scored = _meet(catalog, queries).select("qid", name, context, score.cast("long").alias("score")).where("score > 0")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), name, context)
    return scored.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def describe_materials(df: DataFrame, knowledge: DataFrame) -> DataFrame:
    return df.join(knowledge, "material", "left")


def material_summary(df: DataFrame, knowledge: DataFrame) -> DataFrame:
    """One row for each material of rows (material, citations, t, p, g, dopants, properties), with what is known of it.

    Articles, score, count, range and mean of temperature (t), photon energy (p) and gap (g), distinct dopants and
    properties, and the columns of ``knowledge`` (material and others).  ``place`` orders them by score, articles, name.
    A material's articles are rows of ``material_articles``, as one may hold most of them.
    """
    aggs = [F.count("*").alias("articles"), F.sum("citations").alias("score")]
    for name, c, digits in (("temp", "t", None), ("photon", "p", None), ("gap", "g", 6)):
        aggs.append(F.count(c).alias(f"{name}_count"))
        for kind, f in (("min", F.min), ("max", F.max)):
            aggs.append((F.round(f(c), digits) if digits else f(c)).alias(f"{name}_{kind}"))
        aggs.append(F.round(F.avg(c), 3).alias(f"{name}_avg"))
    lists = [F.sort_array(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("dopants", "properties")]
    # Materials are names of a dictionary, so their places fit in one task.
    place = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("articles"), "material"))
    return describe_materials(df.groupBy("material").agg(*aggs, *lists), knowledge).withColumn("place", place.cast("long"))


def material_articles(df: DataFrame) -> DataFrame:
    """(material, id) of each article once."""
    return df.select("material", "id").distinct()


def bundle(articles: DataFrame, queries: DataFrame, elements: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, materials, elements) of stated queries: scored articles, their roll-up by query and material, element hits.

    ``articles`` have materials, dopants, properties (lists) and t, p, g; ``elements`` have symbol and name.  The hits
    are computed once and feed both tables.
    """
    hits = cut(search_articles(articles, queries, key))
    met = hits.join(articles.drop("score"), key)
    one = met.select("qid", F.explode("materials").alias("material"), "score", "t", "p", "g", "dopants", "properties", F.col(key).alias("id"))
    materials = roll_up(one, ["qid", "material"])
    return hits, materials, search_names(elements, queries, ["symbol", "name"], "symbol")


def roll_up(df: DataFrame, keys: list[str]) -> DataFrame:
    """Articles, score and ranges of temperature (t), photon energy (p) and gap (g), dopants and properties of each key.

    Dopants and properties are distinct values; article ids are left to the hits, where they are rows.
    """
    aggs = [F.countDistinct("id").alias("articles"), F.sum("score").alias("score")]
    for name, c in (("temp", "t"), ("photon", "p"), ("gap", "g")):
        aggs += [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.round(F.avg(c), 3).alias(f"{name}_avg")]
    lists = [F.sort_array(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in ("dopants", "properties")]
    return df.groupBy(*keys).agg(*aggs, *lists)


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    parts = [df.select(F.lit(c).alias("facet"), F.explode(c).alias("value")) for c in columns]
    return reduce(DataFrame.unionByName, parts).groupBy("facet", "value").agg(F.count("*").alias("articles"))
