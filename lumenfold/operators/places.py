"""Density clusters of places (DBSCAN as joins), and names from a gazetteer.

Photos at one spot are one weighted point. `dbscan` works with any distance: `pairs` finds all pairs in reach. `near_clusters`
gives the same result for places on the globe without most of these pairs. Its grid has cells whose points are all within the
radius of each other, so a cell with enough weight holds cores of one cluster only and is one node. Such nodes are
linked by a few points of theirs; only where these lie too far apart, and nothing else links the nodes, are their
points looked at, by parts of parts as far as bounds leave it open. Points of the other cells, which are few in any place, meet
all points around them.

Cores in reach of each other are one cluster; other points go to the cluster, of those in reach, whose first core comes first.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.checkpoint import shared_checkpoint
from lumenfold.functions.scalar import haversine
from lumenfold.operators.components import components
from lumenfold.operators.quarters import MARGIN, above, cell_of, nodes_of
from lumenfold.options import PlacesOptions
from lumenfold.sources.gazetteer import GAZETTEER

#: A little less than the meters of a degree on the sphere, so that cells are never narrower than the radius; and a little more.
DEGREE_METERS, WIDE_DEGREE_METERS = 111_190.0, 111_200.0


def _columns(row: Column, high: float) -> Column:
    """How many cells a row of cells has around the globe; narrower toward the poles, by the row's and its neighbours' latitudes."""
    edge = F.least(F.lit(90.0), F.greatest(F.abs((row - 1) * high), F.abs((row + 2) * high)))
    return F.greatest(F.lit(1.0), F.floor(360 / (high / F.greatest(F.lit(1e-9), F.cos(F.radians(edge)))))).cast("long")


def _place_in(lon: Column, columns: Column) -> Column:
    return F.pmod(F.floor((lon + 180) / (360 / columns)), columns)


def near_pairs(points: DataFrame, meters: float, key: str = "point", asking: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """(library_id, key, key2, weight2, meters): all pairs of points at most `meters` apart, each with itself too.

    With `asking`, pairs of its points with `points`. Columns `more` of the second point come along as they are.
    """
    high = meters / DEGREE_METERS
    rows = points.withColumn("row", F.floor(F.col("lat") / high))
    homes = rows.withColumn("columns", _columns(F.col("row"), high)).withColumn("cell", _place_in(F.col("lon"), F.col("columns"))).drop("columns")
    rows = rows if asking is None else asking.withColumn("row", F.floor(F.col("lat") / high))
    asks = rows.withColumn("row", F.explode(F.sequence(F.col("row") - 1, F.col("row") + 1))).withColumn("columns", _columns(F.col("row"), high)).withColumn("own", _place_in(F.col("lon"), F.col("columns")))
    asks = asks.withColumn("cell", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: F.pmod(F.col("own") + k, F.col("columns"))))))
    met = asks.select("library_id", "row", "cell", key, "lat", "lon").join(homes.select("library_id", "row", "cell", F.col(key).alias(f"{key}2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), F.col("weight").alias("weight2"), *more), ["library_id", "row", "cell"])
    return met.withColumn("meters", haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))).where(F.col("meters") <= meters).select("library_id", key, f"{key}2", "weight2", "meters", *more)


def dbscan(points: DataFrame, pairs: Callable[[DataFrame], DataFrame], min_points: int, key: str = "point") -> DataFrame:
    """(library_id, key, cluster) of all points that aren't noise; a cluster is named by its smallest core.

    `pairs` maps the points (library_id, key, weight, ...) to all pairs in reach (library_id, key, key2, weight2), by any distance.
    """
    near = pairs(points)
    cores = near.groupBy("library_id", key).agg(F.sum("weight2").alias("around")).where(F.col("around") >= min_points).select("library_id", key)
    to_core = near.join(cores.withColumnRenamed(key, f"{key}2"), ["library_id", f"{key}2"])
    linked = to_core.join(cores, ["library_id", key]).select(F.struct("library_id", key).alias("a"), F.struct("library_id", F.col(f"{key}2").alias(key)).alias("b"))
    named = components(linked, "library_id").select(F.col("node.library_id").alias("library_id"), F.col(f"node.{key}").alias(f"{key}2"), F.col(f"component.{key}").alias("cluster"))
    own = cores.withColumnRenamed(key, f"{key}2").join(named, ["library_id", f"{key}2"], "left").withColumn("cluster", F.coalesce("cluster", f"{key}2"))
    # a core reaches itself, and all cores in its reach are of its cluster
    return to_core.join(own, ["library_id", f"{key}2"]).groupBy("library_id", key).agg(F.min("cluster").alias("cluster"))


def _fine_cells(points: DataFrame, meters: float) -> DataFrame:
    """`points` with `cell` (two points of one are within `meters`) and `quarter`, one of its four parts."""
    side = 0.99 * meters / 2**0.5
    high = side / WIDE_DEGREE_METERS
    row = F.floor(F.col("lat") / high)
    rows = points.withColumn("row", row)
    low = F.least(F.abs(F.col("row") * high), F.abs((F.col("row") + 1) * high), F.lit(90.0))
    columns = F.greatest(F.lit(1.0), F.ceil(360 * WIDE_DEGREE_METERS * F.cos(F.radians(low)) / side))
    rows = rows.withColumn("columns", columns).withColumn("across", (F.col("lon") + 180) / (360 / F.col("columns")))
    quarter = 2 * F.pmod(F.floor(F.col("lat") / (high / 2)), F.lit(2)) + F.pmod(F.floor(2 * F.col("across")), F.lit(2))
    return rows.withColumns({"cell": F.struct("row", F.floor("across").alias("column")), "quarter": quarter.cast("int")}).drop("row", "columns", "across")


def near_clusters(points: DataFrame, meters: float, min_points: int, key: str = "point") -> DataFrame:
    """(library_id, key, cluster) as `dbscan` of `near_pairs`, for points (library_id, key, lat, lon, weight)."""
    cells = _fine_cells(points.select("library_id", F.col(key).alias("point"), "lat", "lon", "weight"), meters)
    full = cells.groupBy("library_id", "cell").agg(F.sum("weight").alias("held"), F.min("point").alias("head")).where(F.col("held") >= min_points).drop("held")
    placed = shared_checkpoint(cells.join(full, ["library_id", "cell"], "left"))  # `head` names a full cell
    sparse = placed.where("head is null").select("library_id", "point", "lat", "lon")
    near = shared_checkpoint(near_pairs(placed, meters, asking=sparse, more=("head",)).withColumnRenamed("head", "head2"))
    cores = near.groupBy("library_id", "point").agg(F.sum("weight2").alias("around")).where(F.col("around") >= min_points).select("library_id", "point", F.lit(True).alias("core"))
    cores = shared_checkpoint(cores)
    # what a point reaches: the node of a full cell, or a core outside of them
    other = cores.select("library_id", F.col("point").alias("point2"), F.lit(True).alias("core2"))
    reached = near.join(other, ["library_id", "point2"], "left").where("head2 is not null or core2")
    reached = shared_checkpoint(reached.select("library_id", "point", F.coalesce("head2", "point2").alias("node")).distinct())
    links = reached.join(cores, ["library_id", "point"]).select("library_id", F.col("point").alias("a"), F.col("node").alias("b"))
    # a point of each quarter of a full cell stands for it; if no two of these are in reach, those of two quarters may still be
    marks = placed.where("head is not null").groupBy("library_id", "head", "quarter").agg(F.min_by(F.struct("point", "lat", "lon"), "point").alias("own"))
    marks = marks.select("library_id", F.struct("head", "quarter").alias("mark"), "own.lat", "own.lon", F.lit(1).alias("weight"))
    met = near_pairs(marks, 2 * meters, "mark").where(F.col("mark.head") < F.col("mark2.head"))
    met = shared_checkpoint(met.select("library_id", "mark", "mark2", "meters"))
    sure = met.where(F.col("meters") <= meters).select("library_id", F.col("mark.head").alias("a"), F.col("mark2.head").alias("b")).distinct()
    links = shared_checkpoint(links.unionByName(sure))
    named = _components(links)
    owner = named.select("library_id", F.col("node").alias("head"), "cluster")
    doubt = met.where(F.col("meters") > meters)
    for k, mark in (("1", "mark"), ("2", "mark2")):
        doubt = doubt.withColumn("head", F.col(f"{mark}.head")).join(owner.withColumnRenamed("cluster", "c"), ["library_id", "head"], "left").withColumn(f"c{k}", F.coalesce("c", "head")).drop("c", "head")
    doubt = shared_checkpoint(doubt.where(F.col("c1") != F.col("c2")).select("library_id", "mark", "mark2"))
    if not doubt.isEmpty():
        own = placed.where("head is not null").select("library_id", F.struct("head", "quarter").alias("mark"), "lat", "lon", "weight")
        close = touching(doubt, own, meters)
        named = _components(links.unionByName(close.select("library_id", F.col("mark.head").alias("a"), F.col("mark2.head").alias("b")).distinct()))
    owner = named.withColumnRenamed("cluster", "c")
    inside = placed.where("head is not null").select("library_id", "point", F.col("head").alias("node"))
    alone = cores.select("library_id", "point", F.col("point").alias("node"))
    edge = reached.join(cores, ["library_id", "point"], "left_anti")
    found = inside.unionByName(alone).unionByName(edge).join(owner, ["library_id", "node"], "left")
    return found.groupBy("library_id", F.col("point").alias(key)).agg(F.min(F.coalesce("c", "node")).alias("cluster"))


def touching(pairs: DataFrame, points: DataFrame, meters: float, made: list[int] | None = None) -> DataFrame:
    """Those of `pairs` (library_id, mark, mark2) of groups of `points` (library_id, mark, lat, lon, weight) with two points in reach.

    Parts of the groups meet first: parts wholly in reach settle a pair, parts wholly out of reach are done with, parts of few points meet
    point by point, and the rest is cut finer. `made` gets how many parts and points met in each round.
    """
    level = max(1, math.ceil(math.log2(16 * 180 * DEGREE_METERS / meters)))
    open_, found, ends = pairs.select("library_id", "mark", "mark2"), [], None
    for left in range(6, -1, -1):
        marks = open_.select("library_id", "mark").unionByName(open_.select("library_id", F.col("mark2").alias("mark"))).distinct()
        parts = shared_checkpoint(nodes_of(points.join(marks, ["library_id", "mark"], "left_semi"), level, "library_id", "mark"))
        own, other = (parts.select("library_id", F.col("mark").alias(f"mark{x}"), *(F.col(c).alias(f"{c}{x or 1}") for c in ("cell", "lat", "lon", "far", "n"))) for x in ("", "2"))
        met = open_ if ends is None else ends.withColumnsRenamed({"cell1": "up1", "cell2": "up2"})
        met = met.join(own.withColumn("up1", above(F.col("cell1"), level, 2)), ["library_id", "mark"] + ([] if ends is None else ["up1"]))
        met = met.join(other.withColumn("up2", above(F.col("cell2"), level, 2)), ["library_id", "mark2"] + ([] if ends is None else ["up2"]))
        apart, room = haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), F.col("far1") + F.col("far2")
        state = F.when(apart + room <= meters - MARGIN, "inside").when(apart - room > meters + MARGIN, "outside").when((F.col("n1") * F.col("n2") <= 256) | F.lit(left == 0), "few").otherwise("open")
        judged = shared_checkpoint(met.withColumn("state", state).where("state <> 'outside'").select("library_id", "mark", "mark2", "cell1", "cell2", "state"))
        if made is not None:
            made.append(met.count())
        settled = judged.where("state = 'inside'").select("library_id", "mark", "mark2").distinct()
        few = judged.where("state = 'few'").join(settled, ["library_id", "mark", "mark2"], "left_anti")
        placed = points.withColumn("cell", cell_of(level))
        one, two = (placed.select("library_id", F.col("mark").alias(f"mark{x}"), F.col("cell").alias(f"cell{x or 1}"), F.col("lat").alias(f"lat{x or 1}"), F.col("lon").alias(f"lon{x or 1}")) for x in ("", "2"))
        by_point = few.join(one, ["library_id", "mark", "cell1"]).join(two, ["library_id", "mark2", "cell2"])
        if made is not None:
            made.append(by_point.count())
        by_point = by_point.where(haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) <= meters).select("library_id", "mark", "mark2")
        settled = shared_checkpoint(settled.unionByName(by_point).distinct())
        found.append(settled)
        ends = shared_checkpoint(judged.where("state = 'open'").join(settled, ["library_id", "mark", "mark2"], "left_anti").drop("state"))
        if ends.isEmpty():
            break
        open_, level = ends.select("library_id", "mark", "mark2").distinct(), level + 2
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def _components(links: DataFrame) -> DataFrame:
    """(library_id, node, cluster) from links (library_id, a, b)."""
    named = components(links.select(*(F.struct("library_id", F.col(k).alias("point")).alias(k) for k in ("a", "b"))), "library_id")
    return named.select(F.col("node.library_id").alias("library_id"), F.col("node.point").alias("node"), F.col("component.point").alias("cluster"))


def place_members(photos: DataFrame, options: PlacesOptions = PlacesOptions()) -> DataFrame:
    """(library_id, id, place): photos with a position that belong to a cluster; `place` is the first photo of its first core."""
    rows = photos.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("library_id", "id", "lat", "lon", F.struct(F.coalesce("taken_at", F.lit(2**62)).alias("at"), F.col("id")).alias("turn"))
    spots = shared_checkpoint(rows.groupBy("library_id", "lat", "lon").agg(F.min("turn").alias("point"), F.count("*").alias("weight")))
    found = near_clusters(spots, options.eps_meters, options.min_points)
    named = spots.join(found, ["library_id", "point"]).select("library_id", "lat", "lon", F.col("cluster.id").alias("place"))
    return rows.join(named, ["library_id", "lat", "lon"]).select("library_id", "id", "place")


def with_nearest(rows: DataFrame, lat: str, lon: str, name: str = "near") -> DataFrame:
    """`rows` with a struct (meters, ord, name) of the nearest entry of the gazetteer, a constant of fixed size; the first of equals.

    The nearest entry is that with the largest inner product of unit vectors; its distance is exact.
    """

    def unit(y: Column, x: Column) -> list[Column]:
        y, x = F.radians(y), F.radians(x)
        return [F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)]

    own = dict(zip(("__x", "__y", "__z"), unit(F.col(lat), F.col(lon))))
    fixed = []
    for _, y, x in GAZETTEER:
        y, x = math.radians(y), math.radians(x)
        fixed.append((math.cos(y) * math.cos(x), math.cos(y) * math.sin(x), math.sin(y)))

    @F.pandas_udf("int")
    def first_largest(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        dots = sum(v.to_numpy()[:, None] * np.array([e[k] for e in fixed]) for k, v in enumerate((x, y, z)))
        return pd.Series(dots.argmax(axis=1) + 1)

    # in a task, as one term for each entry would be a method too long for the JVM to compile
    out = rows.withColumns(own).withColumn("__ord", first_largest("__x", "__y", "__z")).drop(*own)
    names, lats, lons = (F.array(*(F.lit(g[k]) for g in GAZETTEER)) for k in range(3))
    at = F.col("__ord")
    meters = haversine(F.col(lat), F.col(lon), F.element_at(lats, at), F.element_at(lons, at))
    told = F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull() & (at > 0), F.struct(meters.alias("meters"), (at - 1).alias("ord"), F.element_at(names, at).alias("name")))
    return out.withColumn(name, told).drop("__ord")
