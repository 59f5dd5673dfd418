"""Spectra as cell tables (dataset, i, j, value)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles

#: Words in axis paths by kind (fixed values).
AXIS_KINDS = [("energy", r"energy|eb|ekin|binding"), ("angle", r"angle|theta|phi|polar|tilt|slit"), ("momentum", r"momentum|\bk[xyz]?\b|kpar"), ("temperature", r"temp|kelvin")]
#: Points for words in dataset paths (fixed values).
DATASET_POINTS = {"fine_cut": 90, "fine": 40, "cut": 65, "map": 55, "spectrum": 40, "spectra": 40, "intensity": 35, "band": 25, "image": 15, "root": 5}


def axis_kind(path: Column) -> Column:
    out = F.lit("axis")
    for kind, pattern in reversed(AXIS_KINDS):
        out = F.when(F.lower(path).rlike(pattern), kind).otherwise(out)
    return out


#: Words that tell a table of axis values (fixed values).
AXIS_WORDS = ["axis", "energy", "alpha", "theta", "phi"]


def dataset_score(path: Column, cells: Column, shape: Column) -> Column:
    """Size and words of a dataset; one of two dimensions with a side of 4 at most and an axis word loses points."""
    points = sum((F.when(F.contains(F.lower(path), F.lit(w)), p).otherwise(0) for w, p in DATASET_POINTS.items()), F.lit(0))
    narrow = (F.size(shape) == 2) & (F.array_min(shape) <= 4) & F.lower(path).rlike("|".join(AXIS_WORDS))
    return F.log10(cells) + points - F.when(narrow, 50).otherwise(0)


def rank_datasets(catalog: DataFrame) -> DataFrame:
    """The best dataset of each file: numeric, two dimensions or more, 64 cells or more."""
    cells = F.aggregate("shape", F.lit(1).cast("long"), lambda a, n: a * n)
    fit = catalog.withColumn("cells", cells).where(F.col("dtype").rlike("^(int|uint|float)") & (F.size("shape") >= 2) & (F.col("cells") >= 64))
    return fit.withColumn("score", dataset_score(F.col("path"), F.col("cells"), F.col("shape"))).groupBy("file").agg(F.max_by(F.struct("path", "shape", "score"), F.struct("score", "path")).alias("r")).select("file", "r.*")


def mid_slice(cells: DataFrame, index: str, size: int) -> DataFrame:
    return cells.where(F.col(index) == size // 2)


#: Points of a plane's dimensions by kind (fixed values).
PLANE_POINTS = {"energy": 20, "angle": 16, "momentum": 16}


def axes_of_dimensions(dimensions: DataFrame, axes: DataFrame) -> DataFrame:
    """file, dim, axis, kind of each dimension: of the file's axes of its length, the best by score, then path.

    ``dimensions`` hold file, dim, n; ``axes`` hold file, path, n, score.  Few axes share a length in a file.
    """
    met = dimensions.join(axes, ["file", "n"], "left")
    best = met.groupBy("file", "dim", "n").agg(F.max_by("path", F.struct("score", "path")).alias("axis"))
    return best.withColumn("kind", axis_kind(F.coalesce("axis", F.lit(""))))


def pick_plane(dimensions: DataFrame) -> DataFrame:
    """file, x, y of the best pair of dimensions (file, dim, n, kind): by area, energy, angle or momentum, and size.

    Energy goes on y; otherwise the later dimension is x.
    """
    points = F.lit(0)
    for kind, p in PLANE_POINTS.items():
        points = F.when(F.col("kind") == kind, p).otherwise(points)
    d = dimensions.withColumn("points", points + F.when(F.col("n") >= 16, 6).otherwise(0))
    first, second = d.alias("p"), d.alias("q")
    pairs = first.join(second, (F.col("p.file") == F.col("q.file")) & (F.col("p.dim") < F.col("q.dim")))
    score = F.log10(F.col("p.n") * F.col("q.n")) + F.col("p.points") + F.col("q.points")
    upright = F.col("q.kind") == "energy"
    pairs = pairs.select(F.col("p.file").alias("file"), F.when(upright, F.col("p.dim")).otherwise(F.col("q.dim")).alias("x"), F.when(upright, F.col("q.dim")).otherwise(F.col("p.dim")).alias("y"), score.alias("score"))
    return pairs.groupBy("file").agg(F.max_by(F.struct("x", "y", "score"), F.struct("score", -F.col("y"), F.col("x"))).alias("r")).select("file", "r.*")


def grid_axes(waves: DataFrame) -> DataFrame:
    """file, dim, name, coordinates: start + step * index of each dimension; names repeat with a number of their own.

    ``waves`` hold file, dim, kind, start, step, n.
    """
    nth = F.row_number().over(Window.partitionBy("file", "kind").orderBy("dim"))
    name = F.when(nth == 1, F.col("kind")).otherwise(F.concat("kind", F.lit("_"), nth))
    return waves.select("file", "dim", name.alias("name"), F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("start") + F.col("step") * i).alias("coordinates"))


def clip_normalise(cells: DataFrame, low: float = 1.0, high: float = 99.6) -> DataFrame:
    """Values between two percentiles scaled to 0..1; other values clipped.  One row a dataset is joined back."""
    p = quantiles(cells, ["dataset"], "value", {"lo": low / 100, "hi": high / 100})
    scaled = (F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return cells.join(p, "dataset").withColumn("value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))).drop("lo", "hi")


def smooth3x3(cells: DataFrame, i0: int = 0, j0: int = 0) -> DataFrame:
    """Binomial kernel with edges clamped; each cell is sent to the nine cells that it is a neighbour of.

    A clamped neighbour counts once for every offset that leads to it, so a cell on an edge sends itself more often.
    """
    edge = cells.groupBy("dataset").agg(F.max("i").alias("mi"), F.max("j").alias("mj"))
    offsets = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(float((2 - abs(a)) * (2 - abs(b)))).alias("w")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    asks = cells.join(F.broadcast(edge), "dataset").select("dataset", "i", "j", F.explode(offsets).alias("o"), "mi", "mj")
    clamp = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(hi, x))
    asks = asks.select("dataset", "i", "j", F.col("o.w").alias("w"), clamp(F.col("i") + F.col("o.di"), i0, F.col("mi")).alias("ni"), clamp(F.col("j") + F.col("o.dj"), j0, F.col("mj")).alias("nj"))
    values = cells.select("dataset", F.col("i").alias("ni"), F.col("j").alias("nj"), "value")
    return asks.join(values, ["dataset", "ni", "nj"], "left").groupBy("dataset", "i", "j").agg((F.sum(F.col("w") * F.coalesce("value", F.lit(0.0))) / 16).alias("value"))


def profile(cells: DataFrame, by: str) -> DataFrame:
    """Mean along one dimension, scaled to 0..1 within the dataset."""
    w = Window.partitionBy("dataset")
    mean = cells.groupBy("dataset", by).agg(F.avg("value").alias("v"))
    return mean.withColumn("profile", F.coalesce((F.col("v") - F.min("v").over(w)) / F.nullif(F.max("v").over(w) - F.min("v").over(w), F.lit(0.0)), F.lit(0.0)) + 0.0)


def axis_value(i: Column, n: Column, first: Column, last: Column) -> Column:
    return first + i * (last - first) / (n - 1)


def quantise_u8(v: Column) -> Column:
    return F.round(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))).cast("long")


def edc_smooth(cells: DataFrame, sigma: float) -> DataFrame:
    """Row means under a Gaussian of radius ceil(3 sigma), ends clamped."""
    rows = cells.groupBy("dataset", "i").agg(F.avg("value").alias("v"))
    edge = rows.groupBy("dataset").agg(F.max("i").alias("mi"))
    radius = math.ceil(3 * sigma)
    kernel = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(math.exp(-o * o / (2 * sigma * sigma))).alias("w")) for o in range(-radius, radius + 1)])
    asks = rows.join(F.broadcast(edge), "dataset").select("dataset", "i", F.explode(kernel).alias("k"), "mi")
    asks = asks.select("dataset", "i", F.col("k.w").alias("w"), F.greatest(F.lit(0), F.least("mi", F.col("i") + F.col("k.o"))).alias("ni"))
    values = rows.select("dataset", F.col("i").alias("ni"), "v")
    return asks.join(values, ["dataset", "ni"]).groupBy("dataset", "i").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("smooth"))


def fermi_edge(cells: DataFrame) -> DataFrame:
    """The row of the steepest fall of the mean intensity."""
    rows = cells.groupBy("dataset", "i").agg(F.avg("value").alias("v"))
    w = Window.partitionBy("dataset").orderBy("i")
    slope = rows.withColumn("slope", (F.lead("v").over(w) - F.lag("v").over(w)) / 2).where("slope is not null")
    return slope.groupBy("dataset").agg(F.min_by("i", F.struct("slope", "i")).alias("edge"), F.min("slope").alias("slope"))


def fermi_edge_near(cells: DataFrame, first: float, last: float, direction: str = "electron", sigma: float = 2.0) -> DataFrame:
    """dataset, edge, energy, confidence: the Fermi edge of the smoothed rows over an energy axis from ``first`` to ``last``.

    Rows within 4 % of an end are left out; where the axis holds 0, only rows within 18 % of it are searched.  The slope
    must have the direction's sign, others count 0.18.  Confidence is the best slope against the median one.  A dataset
    without contrast, or without a slope beyond the noise floor, has no row.
    """
    rows = edc_smooth(cells, sigma)
    n = rows.groupBy("dataset").agg((F.max("i") + 1).alias("n"), F.min("smooth").alias("lo"), F.max("smooth").alias("hi"))
    span, sign = abs(last - first), 1 if direction == "binding" else -1
    w = Window.partitionBy("dataset").orderBy("i")
    steps = rows.withColumns({"next": F.lead("smooth").over(w), "prev": F.lag("smooth").over(w)}).join(n, "dataset")
    energy = first + (last - first) * F.col("i") / F.greatest(F.lit(1), F.col("n") - 1)
    margin = F.greatest(F.lit(1), F.floor(F.col("n") * 0.04))
    inside = (F.col("i") >= margin) & (F.col("i") < F.col("n") - margin)
    if min(first, last) <= 0 <= max(first, last):
        inside = inside & (F.abs(energy) <= F.greatest(F.lit(0.18 * span), span / F.greatest(F.lit(8), F.col("n"))))
    contrast = F.col("hi") - F.col("lo") > F.greatest(F.lit(1e-12), F.greatest(F.abs("lo"), F.abs("hi"), F.lit(1.0)) * 1e-10)
    slope = (F.col("next") - F.col("prev")) / (2 * (last - first) / F.greatest(F.lit(1), F.col("n") - 1))
    found = steps.where(inside & contrast).withColumns({"energy": energy, "slope": slope}).where("slope is not null")
    score = F.when(F.col("slope") * sign > 0, F.abs("slope")).otherwise(F.abs("slope") * 0.18)
    size = F.abs("slope")
    ranked = found.withColumns({"score": score, "floor": (F.col("hi") - F.col("lo")) / span * 1e-6, "nth": F.row_number().over(Window.partitionBy("dataset").orderBy(size)), "of": F.count("*").over(Window.partitionBy("dataset"))})
    g = ranked.groupBy("dataset").agg(F.max_by(F.struct("i", "energy", "score"), F.struct("score", -F.col("i"))).alias("b"), F.max(F.when(F.col("nth") == F.floor(F.col("of") * 0.5) + 1, size)).alias("median"), F.first("floor").alias("floor"))
    return g.where(F.col("b.score") > F.col("floor")).select("dataset", F.col("b.i").alias("edge"), F.col("b.energy").alias("energy"), (F.col("b.score") / F.greatest(F.coalesce("median", F.lit(0.0)), "floor")).alias("confidence"))


def source_identity(catalog: DataFrame) -> DataFrame:
    """fingerprint of each dataset: its metadata and the extents of its axes, whichever way they run.

    ``catalog`` holds file, path, dtype, shape and axes (array of struct(dimension, label, first, last)).
    """
    extent = F.transform(F.array_sort("axes"), lambda a: F.struct(a["dimension"].alias("dimension"), a["label"].alias("label"), F.least(a["first"], a["last"]).alias("first"), F.greatest(a["first"], a["last"]).alias("last")))
    text = F.concat_ws("\x1f", "file", "path", "dtype", F.array_join(F.transform("shape", lambda n: n.cast("string")), "x"), F.to_json(extent))
    return catalog.withColumn("fingerprint", F.sha2(text, 256))


def calibrate_energy(value: Column, unit: Column, fermi: Column, binding: Column) -> Column:
    """Energy against the Fermi level in eV; binding energies change sign."""
    scale = F.when(F.lower(unit) == "mev", 1e-3).when(F.lower(unit) == "kev", 1e3).when(F.lower(unit).isin("µev", "uev"), 1e-6).otherwise(1.0)
    e = value * scale - fermi
    return F.when(binding, -e).otherwise(e)


def fingerprint(catalog: DataFrame, columns: list[str]) -> DataFrame:
    return catalog.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*columns)), 256))


def features(cells: DataFrame) -> DataFrame:
    """z-scores within the dataset and the size of the step to the next cells."""
    stats = cells.groupBy("dataset").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"))
    z = cells.join(stats, "dataset").withColumn("z", (F.col("value") - F.col("mean")) / F.nullif(F.col("spread"), F.lit(0.0))).drop("mean", "spread")
    right = F.lead("z").over(Window.partitionBy("dataset", "i").orderBy("j")) - F.col("z")
    below = F.lead("z").over(Window.partitionBy("dataset", "j").orderBy("i")) - F.col("z")
    return z.withColumn("gradient", F.sqrt(F.pow(F.coalesce(right, F.lit(0.0)), 2) + F.pow(F.coalesce(below, F.lit(0.0)), 2)))


def array_quality(cells: DataFrame) -> DataFrame:
    finite = ~F.isnan("value") & F.col("value").isNotNull() & (F.abs("value") != float("inf"))
    share = cells.groupBy("dataset").agg((F.count_if(finite) / F.count("*")).alias("finite"))
    p = quantiles(cells.select("dataset", F.abs("value").alias("size")), ["dataset"], "size", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return share.join(p, "dataset", "left")
