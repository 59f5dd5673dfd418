"""Texts against a dictionary of aliases by an equi-join on tokens, whatever the size of either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """Distinct runs of ASCII letters and digits, lower-cased, and every other character that isn't blank."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(r"[a-z0-9]+|[^a-z0-9\s]"), F.lit(0)))


def alias_pattern(alias: Column) -> Column:
    """Matches the alias between characters that are neither ASCII letters nor digits, in any case."""
    return F.concat(F.lit("(?i)(^|[^A-Za-z0-9])"), F.regexp_replace(alias, r"([^A-Za-z0-9\s])", r"\\$1"), F.lit("($|[^A-Za-z0-9])"))


def alias_keys(names: DataFrame) -> DataFrame:
    """name, alias, position, token: each alias with the one of its tokens that fewest aliases share (ties: the longest, then by order)."""
    rows = names.select("name", "alias", "position").where("name IS NOT NULL AND position IS NOT NULL").distinct().withColumn("token", F.explode(tokens(F.col("alias"))))
    shared = rows.groupBy("token").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct("n", (-F.length("token")).alias("length"), "token"))
    return rows.join(shared, "token").groupBy("name", "alias", "position").agg(rarest.alias("r")).select("name", "alias", "position", F.col("r.token").alias("token"))


def match_dictionary(texts: DataFrame, names: DataFrame, text: str = "text", out: str = "names", most: int = 200_000) -> DataFrame:
    """Adds ``out``: the names with an alias in the text, in order of position (ties by name), each once.

    ``names`` has name, alias, position.  Every run of letters and digits of an alias that occurs between boundaries is a whole
    token of the text, so texts and aliases meet on one token of each alias, and only those pairs are checked as written.  The
    work follows tokens and candidates, not texts x aliases.  Dictionaries of at most ``most`` aliases (counted) are broadcast and
    the tokens aren't shuffled; larger ones are joined by a shuffle, where AQE splits frequent tokens.  Texts are shuffled
    once, by their hash, without being copied for each candidate.  A text's candidates are bounded by the dictionary.

    Null and empty texts have no names; aliases that are null or blank match nothing; repeated rows of either side are kept
    once (names) or as they are (texts).
    """
    keys = alias_keys(names)
    small = names.limit(most + 1).count() <= most
    hashed = texts.withColumn("_hash", F.xxhash64(text))
    met = hashed.select("_hash", F.explode(tokens(F.col(text))).alias("token")).join(F.broadcast(keys) if small else keys, "token")
    candidates = met.groupBy("_hash").agg(F.collect_set(F.struct("position", "name", "alias")).alias("_met"))
    # Equal hashes of different texts only add candidates.
    hits = F.filter("_met", lambda m: F.rlike(F.col(text), alias_pattern(m["alias"])))
    ordered = F.array_sort(F.transform(hits, lambda m: F.struct(m["position"], m["name"])))
    found = F.array_distinct(F.transform(ordered, lambda m: m["name"]))
    return hashed.join(candidates, "_hash", "left").withColumn(out, F.coalesce(found, F.array().cast("array<string>"))).drop("_hash", "_met")
