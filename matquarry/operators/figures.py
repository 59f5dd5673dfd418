"""Figures of publishers' article pages, and the manifest of their images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import text as T

#: A figure's container, its image, its caption, and figure images anywhere on a page (fixed values).
CONTAINER = r'(?i)(?=<div(?=[^>]*id="figure-\d+")[^>]+class="[^"]*c-article-section__figure(?:\s|[^"])*"[^>]*data-test="figure"[^>]*>)'
CAPTION = r'(?is)data-test="bottom-caption"[^>]*>(.*?)</div>'
IMAGE = r"(?i)((?:https:)?//media\.springernature\.com/[^\"'<> ]+?MediaObjects/[^\"'<> ]+?Fig\d+_HTML\.(?:png|jpg|jpeg|webp))"
#: Size variants of an image URL, and the one that stands for all (fixed values).
VARIANTS, STANDARD = ["lw1200", "m685", "full", "w215h120"], "lw685"
#: Characters of a page's last figure block, and figures of a page.
BLOCK, FIGURES = 30_000, 8


def standard_url(url: Column) -> Column:
    """One size variant for all, https for no scheme, no WebP flag, entities decoded."""
    s = F.regexp_replace(F.replace(url, F.lit("&amp;"), F.lit("&")), "^//", "https://")
    for v in VARIANTS:
        # Only the first occurrence changes.
        s = F.regexp_replace(s, f"^(.*?)/{v}/", f"$1/{STANDARD}/")
    return F.regexp_replace(s, r"(?i)\?as=webp$", "")


def sized_url(url: Column, size: str) -> Column:
    return F.when(F.contains(url, F.lit("media.springernature.com/")), F.regexp_replace(url, rf"/({'|'.join([STANDARD, *VARIANTS, 'w400'])})/", f"/{size}/")).otherwise(url)


def extract_figures(pages: DataFrame, key: str, most: int = FIGURES) -> DataFrame:
    """key, figure_index, image_url, caption, excerpt, type, type_source, caption_source: ``most`` figures of a page at most.

    ``pages`` hold html, doi and title beside the key.  A block runs from a container to the next one (the last one for
    ``BLOCK`` characters).  Pages without a container with an image fall back to the images whose URL has the DOI, the
    first for each number.  Null pages have none.
    """
    parts = F.split(F.coalesce("html", F.lit("")), CONTAINER)
    blocks = pages.select(key, "title", F.size(parts).alias("parts"), F.posexplode(parts).alias("part", "block")).where(F.col("block").rlike(CONTAINER))
    number = F.regexp_extract("block", r'(?i)id="figure-(\d+)"', 1)
    block = F.when(F.col("part") == F.col("parts") - 1, F.left("block", F.lit(BLOCK))).otherwise(F.col("block"))
    image = F.call_function("regexp_extract", block, F.concat(F.lit(r'(?i)(?:src|data-src)="([^"]*Fig'), number.try_cast("int").cast("string"), F.lit(r'_HTML\.(?:png|jpg|jpeg|webp)[^"]*)"')), F.lit(1))
    found = blocks.select(key, "title", "part", number.try_cast("int").alias("figure_index"), standard_url(image).alias("image_url"), T.bounded_text(T.strip_html(F.regexp_extract(block, CAPTION, 1)), 500)[0].alias("publisher_caption")).where("image_url <> ''")
    place = F.row_number().over(Window.partitionBy(key).orderBy("part"))
    found = found.withColumn("place", place).where(F.col("place") <= most)
    words = F.split("publisher_caption", " ")
    short = F.when(F.col("publisher_caption") == "", "").when(F.size(words) > 20, F.concat(T.excerpt(F.col("publisher_caption")), F.lit("..."))).otherwise(F.col("publisher_caption"))
    label = F.concat(F.coalesce("title", F.lit("")), F.lit(" - Figure "), F.col("figure_index"))
    kind = X.figure_type(F.col("publisher_caption"))
    main = found.withColumn("excerpt", short).select(
        key, "figure_index", "image_url", F.when(F.col("excerpt") != "", F.concat(label, F.lit(": "), "excerpt")).otherwise(label).alias("caption"), "excerpt", kind["type"].alias("type"),
        F.when(F.col("excerpt") != "", "publisher_caption").otherwise("unclassified").alias("type_source"), F.when(F.col("excerpt") != "", "publisher").otherwise("generated_label").alias("caption_source"),
    )
    rest = pages.join(found.select(key).distinct(), key, "left_anti")
    other = figure_urls(rest, key, most)
    return main.unionByName(
        other.select(
            key, F.col("place").alias("figure_index"), "image_url", F.concat(F.coalesce("title", F.lit("")), F.lit(" - Figure "), F.col("number")).alias("caption"), F.lit("").alias("excerpt"),
            F.lit("Other").alias("type"), F.lit("unclassified").alias("type_source"), F.lit("generated_label").alias("caption_source"),
        )
    )


def figure_urls(pages: DataFrame, key: str, most: int = FIGURES) -> DataFrame:
    """key, title, place, number, image_url: the first image of each figure number whose URL has the page's DOI."""
    doi = F.replace(T.canonical_doi(F.col("doi")), F.lit("/"), F.lit("%2f"))
    urls = pages.select(key, "title", doi.alias("d"), F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(IMAGE), F.lit(1))).alias("at", "url"))
    urls = urls.where((F.col("d") != "") & F.contains(F.lower("url"), F.col("d"))).withColumn("number", F.regexp_extract("url", r"(?i)Fig(\d+)_HTML", 1).try_cast("int")).where("number > 0")
    first = urls.groupBy(key, "title", "number").agg(F.min_by("url", "at").alias("url"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("number"))
    return first.withColumn("place", place).where(F.col("place") <= most).select(key, "title", "place", "number", standard_url(F.col("url")).alias("image_url"))


def asset_manifest(figures: DataFrame, existing: DataFrame, name: str, size: str = "lw1200") -> DataFrame:
    """asset, image_url, sized_url, reused of each figure with an image; ``existing`` (asset) is what is landed already."""
    some = figures.where(F.col("image_url").rlike("(?i)^https?://"))
    extension = F.regexp_replace(F.lower(F.regexp_extract("image_url", r"(?i)\.(png|jpe?g|webp)(?:[?#].*)?$", 1)), "jpeg", "jpg")
    asset = F.concat(T.asset_key(F.regexp_replace(F.col(name), r"(?i)^https?://(?:dx\.)?doi\.org/", ""), F.col("image_url"), F.col("figure_index")), F.lit("."), F.coalesce(F.nullif(extension, F.lit("")), F.lit("png")))
    rows = some.withColumns({"asset": asset, "sized_url": sized_url(F.col("image_url"), size)})
    known = existing.select("asset").distinct().withColumn("reused", F.lit(True))
    return rows.join(known, "asset", "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("figures"), F.countDistinct("asset").alias("assets"), F.count_if("reused").alias("reused"))
