"""URL filter by the ratio of two character language models.

One variable-order Markov model is counted over accepted URLs and one over rejected URLs; those are the URLs
that explicit rules decide.  A URL without a rule is judged by the difference of the two log-likelihoods for
each character, against a threshold calibrated on URLs that the models haven't counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import running
from . import shared, textkit

#: Longest context in bytes.
ORDER = 5
#: Parts that the rows of one key are dealt to in joins.
SALTS = 8


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' for null or no '://'."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to '?', '#' or the end; '' for null or no '://'."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1)


def with_rule(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, url, host, path, rule, ruled: the longest rule that fits, or nulls.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    """
    host, path = F.col("host"), F.col("path")
    rule = ruled = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, ruled = F.when(fits, F.lit(r.name)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(ruled)
    return pages.select(F.col("page_id").cast("long"), "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumns({"rule": rule, "ruled": ruled})


def _grams(urls: list[bytes], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each order 0..order: hashes of the contexts and of context and next byte, for each byte of each URL.

    The context of an early byte is shorter than the order; such bytes have the hash 0 there.
    """
    raw, off = textkit.flat(urls)
    n = len(raw)
    owner = np.repeat(np.arange(len(urls)), np.diff(off))
    since = np.arange(n) - off[:-1][owner] if n else np.zeros(0, np.int64)
    context = np.full(n, 0x51ED27, np.uint64)
    contexts, nexts = [], []
    for k in range(order + 1):
        if k:
            back = np.zeros(n, np.uint64)
            back[k:] = raw[:-k] if k < n else 0
            context = textkit.mix(context + (back + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k))
        here = np.where(since >= k, context, np.uint64(0))
        contexts.append(here)
        nexts.append(np.where(since >= k, textkit.mix(here + raw.astype(np.uint64) + np.uint64(77)), np.uint64(0)))
    return owner, contexts, nexts, since


def _text(url: str | None) -> bytes:
    """What the models read: the URL without its scheme."""
    s = url or ""
    return s.split("://", 1)[-1].encode()


def count(ruled: DataFrame, order: int = ORDER) -> DataFrame:
    """ruled, order, context, gram, n over all URLs that a rule decides; each task adds up its own first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for verdict, part in pdf.groupby("ruled"):
                _, contexts, nexts, _ = _grams([_text(u) for u in part["url"]], order)
                for k, (c, g) in enumerate(zip(contexts, nexts, strict=True)):
                    both, n = np.unique(np.stack([c, g], 1)[g != 0], axis=0, return_counts=True)
                    yield pd.DataFrame({"ruled": verdict, "ord": k, "context": both[:, 0].view(np.int64), "gram": both[:, 1].view(np.int64), "n": n})

    shared.bounded_batches(ruled.sparkSession, 8192)
    return ruled.select("ruled", "url").mapInPandas(run, "ruled string, ord int, context long, gram long, n long").groupBy("ruled", "ord", "context", "gram").agg(F.sum("n").alias("n"))


def positions(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """row, key, n: how often each gram of the longest context occurs in a URL; the key settles the shorter ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            owner, _, nexts, since = _grams([_text(u) for u in pdf["url"]], order)
            key = np.stack(nexts)[np.minimum(since, order), np.arange(len(since))]
            both, n = np.unique(np.stack([owner.astype(np.uint64), key], 1), axis=0, return_counts=True)
            yield pd.DataFrame({"row": pdf["row"].to_numpy()[both[:, 0].astype(np.int64)], "key": both[:, 1].copy().view(np.int64), "n": n})

    shared.bounded_batches(rows.sparkSession, 8192)
    return rows.select("row", "url").mapInPandas(run, "row long, key long, n long")


def chains(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """key, ord, context, gram: the gram of each order for each distinct key of ``positions``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            _, contexts, nexts, since = _grams([_text(u) for u in pdf["url"]], order)
            key = np.stack(nexts)[np.minimum(since, order), np.arange(len(since))]
            key, at = np.unique(key, return_index=True)
            for k, (c, g) in enumerate(zip(contexts, nexts, strict=True)):
                here = g[at] != 0
                yield pd.DataFrame({"key": key[here].view(np.int64), "ord": k, "context": c[at][here].view(np.int64), "gram": g[at][here].view(np.int64)})

    shared.bounded_batches(rows.sparkSession, 8192)
    return rows.select("url").mapInPandas(run, "key long, ord int, context long, gram long").distinct()


def _salted(big: DataFrame, table: DataFrame, on: str, by: str) -> DataFrame:
    """``big`` with what ``table`` says of ``on``; rows of one ``on`` are dealt out by ``by``."""
    copies = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS))).join(copies, [on, "salt"], "left").drop("salt")


def odds(keys: DataFrame, counts: DataFrame) -> DataFrame:
    """key, d: log-likelihood of the key's last byte as of an accepted URL less that as of a rejected one.

    Contexts of no or one byte are met by very many keys; they are few (257), with at most 256 grams each, so
    their counts are broadcast.  All others are joined with the whole table of counts.
    """
    verdicts = ("allow", "block")
    n = {v: F.sum(F.when(F.col("ruled") == v, F.col("n")).otherwise(0)) for v in verdicts}
    kinds = {v: F.count_if(F.col("ruled") == v) for v in verdicts}
    grams = shared.cut(counts.groupBy("ord", "gram").agg(*(x.alias(f"g_{v}") for v, x in n.items())))
    contexts = shared.cut(counts.groupBy("ord", "context").agg(*(x.alias(f"n_{v}") for v, x in n.items()), *(x.alias(f"k_{v}") for v, x in kinds.items())))
    low, high = F.col("ord") <= 1, F.col("ord") > 1
    few = keys.where(low).join(F.broadcast(contexts.where(low).drop("ord")), "context", "left").join(F.broadcast(grams.where(low).drop("ord")), "gram", "left")
    many = _salted(_salted(keys.where(high), contexts.where(high).drop("ord"), "context", "key"), grams.where(high).drop("ord"), "gram", "key")
    numbers = [f"{x}_{v}" for x in "gnk" for v in verdicts]
    each = few.unionByName(many).select("key", F.struct("ord", *(F.coalesce(x, F.lit(0)).cast("double").alias(x) for x in numbers)).alias("x"))
    each = each.groupBy("key").agg(F.sort_array(F.collect_list("x")).alias("orders"))

    def log_likelihood(v: str) -> Column:
        def longer(p: Column, x: Column) -> Column:
            return F.when(x[f"n_{v}"] > 0, (x[f"g_{v}"] + x[f"k_{v}"] * p) / (x[f"n_{v}"] + x[f"k_{v}"])).otherwise(p)

        return F.log(F.aggregate("orders", F.lit(1 / 256), longer))

    return each.select("key", (log_likelihood("allow") - log_likelihood("block")).alias("d"))


def differences(rows: DataFrame, ruled: DataFrame, order: int = ORDER) -> DataFrame:
    """row, difference: log-likelihood for each byte as an accepted URL less that as a rejected one, for the rows
    (row, url) whose URL has bytes.  The models count all of ``ruled``; no count is left out or sent to the driver."""
    value = shared.cut(odds(chains(rows, order), shared.cut(count(ruled, order))))
    at = positions(rows, order)
    # What nearly all URLs begin with is few keys: their values are broadcast and their rows stay where they are.
    often = shared.cut(at.groupBy("key").agg(F.count("*").alias("rows")))
    least = (often.agg(F.sum("rows")).first()[0] or 0) / shared.HEAVY
    hot = shared.cut(often.where(F.col("rows") >= least).join(value, "key").select("key", F.col("d").alias("hot_d"), F.lit(True).alias("hot")))
    known = at.join(F.broadcast(hot), "key", "left")
    # A row of a hot key takes no part in the join of the rest; it is dealt out by its row.
    known = known.withColumns({"key": F.when(F.col("hot"), F.xxhash64("row", "key")).otherwise(F.col("key")), "rest": F.col("hot").isNull()})
    found = known.join(value.withColumn("rest", F.lit(True)), ["key", "rest"], "left").withColumn("d", F.coalesce("hot_d", "d"))
    return found.groupBy("row").agg((F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias("difference"))


def judge(pages: DataFrame, rules: list[Rule], order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, difference of every row.

    A null URL has empty host and path, no rule and the difference 0, as has an empty one.  Without accepted or
    rejected URLs to learn from, the threshold is 0 and so every URL without a rule is allowed.  Repeated rows
    are judged alike.  All of one fifth of the ruled URLs (by hash), which the models don't count,
    set the threshold.
    """
    found = shared.cut(with_rule(pages, rules).withColumn("row", F.monotonically_increasing_id()))
    ruled = found.where(F.col("ruled").isNotNull())
    aside = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    scored = found.join(differences(found, ruled.where(~aside), order), "row", "left").withColumn("difference", F.coalesce("difference", F.lit(0.0)))
    scored = shared.cut(scored)
    held = scored.where(F.col("ruled").isNotNull() & aside).select("difference", (F.col("ruled") == "allow").alias("accepted"))
    threshold = threshold_of(held)
    verdict = F.coalesce("ruled", F.when(F.col("difference") >= threshold, "allow").otherwise("block"))
    return scored.withColumn("verdict", verdict).select("page_id", "host", "path", "rule", "verdict", "difference")


def threshold_of(held: DataFrame) -> float:
    """The cut of (difference, accepted) with the best mean of both classes' shares judged right, over all rows; halfway
    between neighbours.

    Ranks run over ranges of the distinct differences; the driver sees a few numbers.
    """
    counts = shared.cut(held.groupBy("difference").agg(F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad")).withColumn("all", F.lit(0)))
    good, bad = counts.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if not good or not bad:
        return 0.0
    ranked = running(running(counts, ["all"], "difference", "bad").withColumnRenamed("below", "bad_below"), ["all"], "difference", "good")
    right = F.col("bad_below") / bad + (good - F.col("below")) / good
    at = -ranked.agg(F.max(F.struct(right.alias("right"), (-F.col("difference")).alias("at")))["at"]).first()[0]
    before = counts.where(F.col("difference") < at).agg(F.max("difference")).first()[0]
    return at if before is None else (before + at) / 2
