"""Events around many origins: all within a radius, or the nearest few, without comparing everything with everything.

The globe is cut into bands of latitude, and each band into cells of about the same width in kilometres, so the
cells that a circle touches are few at any latitude. Circles meet occupied cells first; a crowded cell is dealt to
several parts, and only rows of a touched cell are measured. Distances count to the millimetre.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacegrid.functions.fixed import EARTH_KM
from pacegrid.functions.geo import haversine_km, located
from pacegrid.operators.lineage import dealt, written

#: Rows that a part of a cell is planned for.
PART_ROWS = 10_000
#: The widest distance there is, and the first radius of a search for the nearest.
HALF_WAY_KM, FIRST_KM = EARTH_KM * 3.1416, 25.0
_KM_A_DEGREE = EARTH_KM * math.pi / 180
#: Wider circles than needed, so that rounding leaves out no cell.
_SLACK = 1.000001


def _band(latitude: Column, step: float) -> Column:
    return F.floor((latitude + 90) / step)


def _cells_of_band(band: Column, step: float) -> Column:
    """Number of cells around a band: as many steps as fit at its edge nearer to the equator."""
    low, high = band * step - 90, (band + 1) * step - 90
    widest = F.when((low <= 0) & (high >= 0), 1.0).otherwise(F.cos(F.radians(F.least(F.abs(low), F.abs(high)))))
    return F.greatest(F.lit(1), F.floor(360 * widest / step)).cast("long")


def _cell(longitude: Column, cells: Column) -> Column:
    """Cell of any longitude, counted from -180 and around."""
    return F.pmod(F.floor((longitude + 180) / 360 * cells), cells)


def _on_globe(df: DataFrame) -> DataFrame:
    real = located(F.col("latitude"), F.col("longitude")) & ~F.isnan("latitude") & ~F.isnan("longitude") & F.col("latitude").between(-90, 90) & F.col("longitude").between(-1e6, 1e6)
    return df.where(real)


def _touched(origins: DataFrame, radius_km: float, step: float) -> DataFrame:
    """(columns of ``origins``, _band, _cell): a row for each cell that the circle around an origin may touch."""
    reach = radius_km / _KM_A_DEGREE * _SLACK + 1e-9
    top = math.floor(180 / step)
    bands = F.sequence(F.greatest(_band(F.col("latitude") - reach, step), F.lit(0)).cast("long"), F.least(_band(F.col("latitude") + reach, step), F.lit(top)).cast("long"))
    df = origins.withColumn("_band", F.explode(bands)).withColumn("_cells", _cells_of_band(F.col("_band"), step))
    # the circle's widest meridian; without one it holds a pole, and all cells of a band
    ratio = F.sin(F.radians(F.lit(min(reach, 90.0)))) / F.cos(F.radians("latitude"))
    around = F.coalesce((F.abs("latitude") + reach >= 90) | (ratio >= 1), F.lit(True))
    wide = F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * _SLACK + 1e-9
    first, last = (F.floor((F.col("longitude") + side * wide + 180) / 360 * F.col("_cells")).cast("long") for side in (-1, 1))
    whole = around | (last - first + 1 >= F.col("_cells"))
    each = F.when(whole, F.sequence(F.lit(0).cast("long"), F.col("_cells") - 1)).otherwise(F.sequence(first, F.when(whole, first).otherwise(last)))
    return df.withColumn("_cell", F.explode(each)).withColumn("_cell", F.pmod("_cell", "_cells")).drop("_cells")


def _pairs(points: DataFrame, origins: DataFrame, radius_km: float) -> DataFrame:
    """Columns of ``origins`` and ``points`` (latitude, longitude, others apart from those of origins) and km, for all pairs within the radius."""
    step = min(180.0, max(radius_km / _KM_A_DEGREE, 1e-4))
    band = _band(F.col("latitude"), step).cast("long")
    placed = points.withColumn("_band", band).withColumn("_cell", _cell(F.col("longitude"), _cells_of_band(band, step)).cast("long"))
    parts = placed.groupBy("_band", "_cell").agg(F.ceil(F.count("*") / PART_ROWS).alias("_parts"))
    dealt = placed.join(parts.where("_parts > 1"), ["_band", "_cell"], "left").withColumn("_part", F.when(F.col("_parts") > 1, F.pmod(F.xxhash64("id"), "_parts")).otherwise(0).cast("long")).drop("_parts")
    rings = _touched(origins, radius_km, step).join(parts, ["_band", "_cell"]).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    rings = rings.withColumnsRenamed({"latitude": "_lat", "longitude": "_lon"})
    km = F.round(haversine_km(F.col("_lat"), F.col("_lon"), F.col("latitude"), F.col("longitude")), 6)
    met = rings.join(dealt, ["_band", "_cell", "_part"]).withColumn("km", km).where(F.col("km") <= radius_km)
    return met.drop("_band", "_cell", "_part", "_lat", "_lon", "latitude", "longitude")


def within(events: DataFrame, origins: DataFrame, radius_km: float) -> DataFrame:
    """(origin, id, km) of all ``events`` (id, latitude, longitude) within ``radius_km`` of each of ``origins`` (origin, latitude, longitude).

    Rows without coordinates, or with ones that are not on the globe, are near nothing. Repeated rows count each. A
    negative radius gives nothing, as empty tables do; other columns are ignored.
    """
    points = _on_globe(events.select("id", *[F.col(c).cast("double").alias(c) for c in ("latitude", "longitude")]))
    starts = _on_globe(origins.select("origin", *[F.col(c).cast("double").alias(c) for c in ("latitude", "longitude")]))
    return _pairs(written(points), starts, float(radius_km)).select("origin", "id", "km")


def around(events: DataFrame, origins: DataFrame, radius_km: float) -> DataFrame:
    """(origin, n, least, most): of the pairs of within(), how many each origin has, and their least and largest distance; origins
    without any are left out.

    Only distinct spots of events are measured from distinct spots of origins, and count for the rows that are there, so the work grows
    with pairs of spots and not with pairs of rows.
    """
    spot = ["latitude", "longitude"]
    points, starts = (_on_globe(df.select(*own, *[F.col(c).cast("double").alias(c) for c in spot])) for df, own in ((events, []), (origins, ["origin"])))
    points = written(points.groupBy(*spot).agg(F.count("*").alias("_n")).withColumn("id", F.xxhash64(*spot)))
    starts = written(starts)
    homes = dealt(written(starts.select(*spot).distinct())).withColumns({"_home_lat": F.col("latitude"), "_home_lon": F.col("longitude")})
    met = _pairs(points, homes, float(radius_km)).groupBy("_home_lat", "_home_lon").agg(F.sum("_n").alias("n"), F.min("km").alias("least"), F.max("km").alias("most"))
    found = starts.join(met.withColumnsRenamed({"_home_lat": "latitude", "_home_lon": "longitude"}), spot)
    return found.groupBy("origin").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def nearest(events: DataFrame, origins: DataFrame, k: int) -> DataFrame:
    """(origin, place, id, km): the ``k`` events nearest to each origin, from place 1, ties in order of ids.

    Rings double until a circle holds k events; an origin whose circle does is done, and only the others go on. Of events at one
    and the same spot only the k least ids take part, since no more of them can count. Origins with a null name or no spot,
    and events with a null id, have no part; repeated origins count once, repeated events each.
    """
    spots = _on_globe(events.where("id is not null").select("id", *[F.col(c).cast("double").alias(c) for c in ("latitude", "longitude")]))
    points = written(spots.withColumn("_n", F.row_number().over(Window.partitionBy("latitude", "longitude").orderBy("id"))).where(F.col("_n") <= k).drop("_n"))
    left = written(_on_globe(origins.where("origin is not null").select("origin", *[F.col(c).cast("double").alias(c) for c in ("latitude", "longitude")])).distinct())
    radius, done = FIRST_KM, []
    place = F.row_number().over(Window.partitionBy("origin").orderBy("km", "id")).cast("long")
    while k > 0 and left.limit(1).count():
        wide = radius >= HALF_WAY_KM
        best = written(_pairs(points, left, min(radius, HALF_WAY_KM)).withColumn("place", place).where(F.col("place") <= k).select("origin", "place", "id", "km"))
        if wide:  # the whole globe: there are no more
            done.append(best)
            break
        full = best.where(F.col("place") == k).select("origin")
        done.append(best.join(full, "origin", "left_semi"))
        left = written(left.join(full, "origin", "left_anti"))
        radius *= 2
    if not done:
        return origins.sparkSession.createDataFrame([], "origin string, place long, id string, km double").select(F.col("origin").cast(origins.schema["origin"].dataType), "place", F.col("id").cast(events.schema["id"].dataType), "km")
    return reduce(DataFrame.union, done)
