"""Neighbour joins as equi-joins on grid cells: k nearest, within a distance, nearest target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histomill.errors import InvalidParameterError, MissingSpatialError, require_column
from histomill.model import Cohort
from histomill.storage import stored


def points(cohort: Cohort, section: str = "section", *more: Column) -> DataFrame:
    """``section, id, x, y`` of every pixel, and what else is asked for."""
    for c in ("x", "y"):
        require_column(cohort.pixels.columns, c, MissingSpatialError)
    return cohort.pixels.select(
        F.coalesce(F.col(section).cast("string"), F.lit("")).alias("section"), F.col("pixel_id").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *more
    )


def _cell(v: str, low: str, side: Column) -> Column:
    return F.floor((F.col(v) - F.col(low)) / side).cast("long")


def _around(c: str) -> Column:
    return F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))


def _distance2() -> Column:
    dx, dy = F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")
    return dx * dx + dy * dy


#: Most points of a cell, for each neighbour that is sought, before cells are made smaller; times that
#: they are, and factor between the sides of two rounds.
CROWDED, ROUNDS, STEP = 32, 16, 4
#: Least number of points that the last round compares with all of their section.
FEW = 64


def _extent(pts: DataFrame, k: int) -> DataFrame:
    """Per section: origin, widest span, and a cell side that holds about ``k + 1`` points where
    most points lie (between the 5th and 95th percentiles), made smaller until no cell is crowded."""
    inner = lambda c: F.percentile_approx(c, [0.05, 0.95], 1000)
    box = pts.groupBy("section").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"), inner("x").alias("qx"), inner("y").alias("qy")
    )
    span = F.greatest("w", "h")
    width, height = F.col("qx")[1] - F.col("qx")[0], F.col("qy")[1] - F.col("qy")[0]
    inside = F.greatest(width, height)
    area = F.greatest(width * height, inside * inside / F.col("n"))
    side = F.when(span > 0, F.greatest(F.sqrt(area * (k + 1) / F.col("n")), span * 1e-9)).otherwise(1.0)
    extent = stored(box.select("section", "x0", "y0", span.alias("span"), side.alias("side"), F.lit(0).cast("long").alias("most")), "extent")
    for _ in range(ROUNDS):
        cell = [_cell("x", "x0", F.col("side")), _cell("y", "y0", F.col("side"))]
        fullest = pts.join(extent, "section").groupBy("section", *[c.alias(n) for c, n in zip(cell, ("cx", "cy"), strict=True)]).count().groupBy("section").agg(F.max("count").alias("now"))
        crowded = (F.col("now") > CROWDED * (k + 1)) & (F.col("now") != F.col("most")) & (F.col("side") > F.col("span") * 1e-9)
        if fullest.where(F.col("now") > CROWDED * (k + 1)).isEmpty():
            break
        told = stored(extent.join(fullest, "section").select("section", "x0", "y0", "span", F.when(crowded, F.col("side") / STEP).otherwise(F.col("side")).alias("side"), F.when(crowded, F.col("now")).alias("most"), crowded.alias("crowded")), "extent")
        if told.where("crowded").isEmpty():
            return told.select("section", "x0", "y0", "span", "side")
        extent = told.select("section", "x0", "y0", "span", "side", F.coalesce("most", F.lit(0)).alias("most"))
    return extent.select("section", "x0", "y0", "span", "side")


def knn(pts: DataFrame, k: int, targets: DataFrame | None = None) -> DataFrame:
    """``section, i, j, d2, r``: the ``k`` nearest of ``targets`` (the points themselves unless
    given) of every point in its own section, nearest first, ties by id. A point is not its own
    neighbour. Sections with fewer points give fewer neighbours.

    Points meet the points of the 3x3 cells around theirs. A point is settled when its k-th
    neighbour is no further than a cell's side, or a side spans the section; the others are
    joined again on cells ``STEP`` times as large, until none is left. Where at most ``FEW`` are left they
    meet all points of their sections."""
    if k < 1:
        raise InvalidParameterError(f"The number of neighbours must be at least 1, got {k}.")
    own = targets is None
    targets = pts if own else targets
    extent = _extent(pts.unionByName(targets) if not own else pts, k)
    pending, found, factor = pts, None, 1.0
    while True:
        side = F.col("side") * F.lit(factor)
        placed = lambda t: t.join(extent, "section").withColumns({"cx": _cell("x", "x0", side), "cy": _cell("y", "y0", side)})
        asked = placed(pending).select("section", "id", "x", "y", "span", side.alias("side"), _around("cx").alias("cx"), "cy")
        asked = asked.select("section", "id", "x", "y", "span", "side", "cx", _around("cy").alias("cy")).alias("q")
        held = placed(targets).select("section", "id", "x", "y", "cx", "cy").alias("p")
        on = [F.col(f"q.{c}") == F.col(f"p.{c}") for c in ("section", "cx", "cy")]
        pairs = asked.join(held, on)
        pairs = pairs.where(F.col("q.id") != F.col("p.id")) if own else pairs
        near = pairs.select("q.section", F.col("q.id").alias("i"), F.col("p.id").alias("j"), _distance2().alias("d2"), "q.side", "q.span")
        order = Window.partitionBy("section", "i").orderBy("d2", "j")
        ranked = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
        within = F.col("side") >= F.col("span")
        furthest = F.max(F.when(F.col("r") == k, F.col("d2"))).over(Window.partitionBy("section", "i"))
        ranked = stored(ranked.withColumn("settled", within | F.coalesce(furthest <= F.col("side") * F.col("side"), F.lit(False))), "near")
        good = ranked.where("settled").select("section", "i", "j", "d2", "r")
        found = good if found is None else found.unionByName(good)
        settled = ranked.where("settled").select("section", F.col("i").alias("id")).distinct()
        spans_all = extent.where(F.col("side") * F.lit(factor) >= F.col("span")).select("section")
        unsettled = pending.join(settled, ["section", "id"], "left_anti").join(spans_all, "section", "left_anti")
        if unsettled.isEmpty():
            return found
        pending = stored(unsettled, "pending")
        left = pending.limit(FEW + 1).count()
        if left <= FEW:
            last = F.broadcast(pending).alias("q").join(targets.alias("p"), F.col("q.section") == F.col("p.section"))  # FEW rows at most
            last = (last.where(F.col("q.id") != F.col("p.id")) if own else last).select("q.section", F.col("q.id").alias("i"), F.col("p.id").alias("j"), _distance2().alias("d2"))
            return found.unionByName(last.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k))
        factor *= STEP


def spatial_edges(cohort: Cohort, n_neighbors: int = 6, section: str = "section", include_self: bool = False) -> DataFrame:
    """Directed ``section, i, j, w``: the weights of a pixel add up to 1."""
    pts = points(cohort, section)
    edges = knn(pts, n_neighbors).select("section", "i", "j")
    if include_self:
        edges = edges.unionByName(pts.select("section", F.col("id").alias("i"), F.col("id").alias("j")))
    w = 1 / F.count(F.lit(1)).over(Window.partitionBy("section", "i"))
    return edges.withColumn("w", w)


def spatial_neighbors(cohort: Cohort, n_neighbors: int = 6, section: str = "section") -> DataFrame:
    """Undirected graph, both directions listed: ``section, i, j``."""
    edges = knn(points(cohort, section), n_neighbors).select("section", "i", "j")
    return edges.unionByName(edges.select("section", F.col("j").alias("i"), F.col("i").alias("j"))).distinct()


def within_distance(pts: DataFrame, max_dist: float, *carried: str) -> DataFrame:
    """Ordered pairs ``section, i, j, d`` of different points at most ``max_dist`` apart. Cells
    have that side, so the 3x3 around a point hold all its partners. Columns that are ``carried``
    come for both points, as ``<name>_i`` and ``<name>_j``."""
    if max_dist <= 0:
        raise InvalidParameterError(f"max_dist must be positive, got {max_dist}.")
    cell = lambda c: F.floor(F.col(c) / max_dist).cast("long")
    held = pts.withColumns({"cx": cell("x"), "cy": cell("y")})
    asked = held.withColumn("cx", _around("cx")).withColumn("cy", _around("cy"))
    on = [F.col(f"q.{c}") == F.col(f"p.{c}") for c in ("section", "cx", "cy")]
    pairs = asked.alias("q").join(held.alias("p"), on).where((F.col("q.id") != F.col("p.id")) & (_distance2() <= max_dist * max_dist))
    return pairs.select("q.section", F.col("q.id").alias("i"), F.col("p.id").alias("j"), F.sqrt(_distance2()).alias("d"), *[F.col(f"{t}.{c}").alias(f"{c}_{k}") for c in carried for t, k in (("q", "i"), ("p", "j"))])


def nearest_target(pts: DataFrame, targets: DataFrame) -> DataFrame:
    """``section, id, d``: distance of every point to the nearest target of its section; points
    of sections without targets have no row."""
    return knn(pts.join(targets.select("section").distinct(), "section", "left_semi"), 1, targets).select("section", F.col("i").alias("id"), F.sqrt("d2").alias("d"))
