"""Layers that come in tiles, items or columns: which tiles are needed, who fills them, what their numbers mean.

Inputs are tables (a store of tiles or items that Spark reads), so every choice is a join or a grouped
minimum over them and the scan is pruned by the tile keys that come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of elevation products in the order in which they stand in for each other.
ELEVATION = ("cop30", "cop90", "nasadem")
# What counts as no data.
NO_ELEVATION, NO_SOIL, NO_WATER = -1e4, -32000.0, 255
# Divisor and unit of attributes that are stored as scaled whole numbers.
SCALED = {"tmp": (10.0, "degC"), "slp": (10.0, "degrees"), "ari": (100.0, "index"), "cmi": (100.0, "index"), "hft": (10.0, "index")}
# Attributes that are class codes.
CODES = ("clz", "cls", "glc", "pnv", "wet", "lit", "gad", "tbi", "tec", "fmh")
# Extent by the first letter of the third part of an attribute's name.
EXTENTS = {"u": "upstream", "s": "sub-catchment", "p": "pour point", "c": "catchment", "l": "local"}


def corners(boxes: DataFrame, size: int = 1) -> DataFrame:
    """id, lat, lon: south-west corners of the tiles of `size` degrees that boxes (id, west, south, east, north) touch."""
    line = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    return boxes.select("id", line("south", "north").alias("r"), "west", "east").select("id", (F.col("r") * size).cast("int").alias("lat"), line("west", "east").alias("c")).select("id", "lat", (F.col("c") * size).cast("int").alias("lon"))


def tile_name(product: str, lat: Column, lon: Column) -> Column:
    """Name of the tile with that south-west corner, as its publisher writes it."""
    ns = lambda n, s: F.concat(F.when(lat >= 0, n).otherwise(s), F.lpad(F.abs(lat).cast("string"), 2, "0"))
    ew = lambda e, w: F.concat(F.when(lon >= 0, e).otherwise(w), F.lpad(F.abs(lon).cast("string"), 3, "0"))
    if product in ("cop30", "cop90"):
        return F.concat(F.lit(f"Copernicus_DSM_COG_{10 if product == 'cop30' else 30}_"), ns("N", "S"), F.lit("_00_"), ew("E", "W"), F.lit("_00_DEM"))
    if product == "nasadem":
        return F.concat(F.lit("NASADEM_HGT_"), ns("n", "s"), ew("e", "w"))
    if product == "srtm30":
        return F.concat(ns("N", "S"), ew("E", "W"))
    raise ValueError(f"no tiles of {product}")


def fill_tiles(wanted: DataFrame, held: DataFrame, order: tuple[str, ...] = ELEVATION) -> DataFrame:
    """id, lat, lon, product: the first product of `order` that holds a wanted tile; null where none does.

    held: (product, lat, lon). One grouped minimum instead of a lookup for each tile.
    """
    rank = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("product"))
    best = held.where(F.col("product").isin(*order)).groupBy("lat", "lon").agg(F.min(F.struct(rank.alias("k"), "product"))["product"].alias("product"))
    return wanted.join(best, ["lat", "lon"], "left").select("id", "lat", "lon", "product")


def mosaic(cells: DataFrame, least: float = NO_ELEVATION) -> DataFrame:
    """layer, row, col, value of overlapping tiles (layer, row, col, rank, value): the known value of the best rank."""
    known = F.when(F.col("value") > least, F.struct("rank", "value"))
    return cells.groupBy("layer", "row", "col").agg(F.min(known)["value"].alias("value"))


def first_valid(items: DataFrame) -> DataFrame:
    """cell and value of (cell, t, value): the first that is not 0 in order of time."""
    return items.groupBy("cell").agg(F.min(F.when(F.col("value") != 0, F.struct("t", "value")))["value"].alias("value"))


def years_available(items: DataFrame) -> DataFrame:
    """One row: the years of items (id, start), ascending; without a start the last part of the id is the year."""
    year = F.coalesce(F.year("start"), F.element_at(F.split("id", "[-_]"), -1).try_cast("int"))
    return items.agg(F.array_join(F.transform(F.array_sort(F.collect_set(year)), lambda y: y.cast("string")), ",").alias("years"))


def search_items(items: DataFrame, box: tuple[float, float, float, float], start: str, end: str, most_cloud: float) -> DataFrame:
    """Items (id, west, south, east, north, t, cloud) that touch the box in time and have less cloud; a null cloud passes."""
    west, south, east, north = box
    touch = (F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)
    return items.where(touch & F.col("t").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")) & F.coalesce(F.col("cloud") < most_cloud, F.lit(True)))


def why_empty(items: DataFrame, box: tuple[float, float, float, float], start: str, end: str, most_cloud: float) -> DataFrame:
    """One row: items found, items without the limit on cloud, and their least cloud, to say why a search is empty."""
    found = search_items(items, box, start, end, most_cloud)
    free = search_items(items, box, start, end, float("inf"))
    return found.agg(F.count("*").alias("found")).join(F.broadcast(free.agg(F.count("*").alias("without_limit"), F.min("cloud").alias("least_cloud"))))  # one row each


def resolve_bands(asked: DataFrame, bands: DataFrame, aliases: DataFrame) -> DataFrame:
    """asked and band: names (asked) as bands (band) of the mission, by name or alias (alias, band), whatever their case; null: unknown."""
    known = bands.select(F.upper("band").alias("k"), "band", F.lit(0).alias("r")).union(aliases.join(bands, "band", "left_semi").select(F.upper("alias").alias("k"), "band", F.lit(1).alias("r")))
    best = known.groupBy("k").agg(F.min(F.struct("r", "band"))["band"].alias("band"))
    return asked.join(best, F.upper("asked") == F.col("k"), "left").select("asked", "band")


def scaling(items: DataFrame) -> DataFrame:
    """band, scale, offset, nodata of (item, band, scale, offset, nodata, offset_applied): the first item with the band decides; an offset that was applied is 0."""
    first = items.groupBy("band").agg(F.min(F.struct("item", "scale", "offset", "nodata", "offset_applied")).alias("i"))
    offset = F.when(F.coalesce("i.offset_applied", F.lit(False)), 0.0).otherwise(F.coalesce("i.offset", F.lit(0.0)))
    return first.select("band", F.coalesce("i.scale", F.lit(1.0)).alias("scale"), offset.alias("offset"), F.col("i.nodata").alias("nodata"))


def scaled(values: DataFrame, by_band: DataFrame) -> DataFrame:
    """(cell, band, raw) to cell, band, value by scaling()."""
    both = values.join(F.broadcast(by_band), "band")  # a row for each band
    return both.select("cell", "band", F.when(~F.col("raw").eqNullSafe(F.col("nodata")), F.col("raw") * F.col("scale") + F.col("offset")).alias("value"))


def open_items(assets: DataFrame) -> DataFrame:
    """item of (item, href): those whose every asset can be read over http."""
    return assets.groupBy("item").agg(F.bool_and(F.coalesce(F.rlike("href", F.lit("^https?://")), F.lit(False))).alias("open")).where("open").select("item")


def regions_of(points: DataFrame, regions: DataFrame) -> DataFrame:
    """id, region, place: the regions (region, west, south, east, north, rank) whose box holds a point (id, lat, lon), in order of rank."""
    box = F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    hit = points.join(F.broadcast(regions), box)  # a handful of continents
    return hit.select("id", "region", F.row_number().over(Window.partitionBy("id").orderBy("rank")).cast("int").alias("place"))


def in_box(shapes: DataFrame, box: tuple[float, float, float, float], **least: float) -> DataFrame:
    """Shapes (west, south, east, north, ...) that touch the box and have at least the given value of each named column."""
    west, south, east, north = box
    out = shapes.where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))
    for column, value in least.items():
        out = out.where(F.coalesce(F.col(column), F.lit(0.0)) >= value)
    return out


def soil_value(raw: Column, divisor: float) -> Column:
    """A stored soil value in its unit; null where it is no data."""
    return F.when(raw > NO_SOIL, raw / divisor)


def available_water(at_field: Column, at_wilting: Column) -> Column:
    """Percent of volume between field capacity and wilting point, of stored tenths; never below 0, null stays null."""
    return F.greatest((at_field - at_wilting) / 10, F.lit(0.0) + at_field * 0)


def ndvi(nir: Column, red: Column) -> Column:
    return F.try_divide(nir - red, nir + red)


def decibels(power: Column) -> Column:
    return 10 * F.log10(F.greatest(power, F.lit(1e-5)))


def water_shares(cells: DataFrame, permanent: float = 90.0) -> DataFrame:
    """layer, permanent and seasonal share of (layer, occurrence): above 100 is no data."""
    v = F.col("occurrence")
    return cells.where(v <= 100).groupBy("layer").agg(F.count("*").alias("cells"), F.avg((v >= permanent).cast("double")).alias("permanent"), F.avg(((v > 0) & (v < permanent)).cast("double")).alias("seasonal"))


def attributes(table: DataFrame, key: str, extent: str | None = "u") -> DataFrame:
    """key, name, variable, extent, unit, value: the attribute columns of a wide table (named variable_unit_extent) as rows.

    extent: only names whose third part begins with it. Scaled numbers come in their unit; class codes as they are.
    """
    names = [c for c in table.columns if c != key and len(c.split("_")) >= 3 and (not extent or c.split("_")[2].startswith(extent))]
    rows = []
    for c in names:
        variable, unit, where = c.split("_")[:3]
        divisor, unit = SCALED[variable] if variable in SCALED and variable not in CODES else (1.0, unit)
        rows.append(F.struct(F.lit(c).alias("name"), F.lit(variable).alias("variable"), F.lit(EXTENTS.get(where[0])).alias("extent"), F.lit(unit).alias("unit"), (F.col(f"`{c}`").cast("double") / divisor).alias("value")))
    return table.select(key, F.explode(F.array(*rows)).alias("a")).select(key, "a.*")


def satellite_window(lat: Column, year: Column) -> tuple[Column, Column]:
    """First and last day of the dry season's images: November to February in the north, May to September in the south."""
    south = lat < 0
    return F.when(south, F.make_date(year, F.lit(5), F.lit(1))).otherwise(F.make_date(year - 1, F.lit(11), F.lit(1))), F.when(south, F.make_date(year, F.lit(9), F.lit(30))).otherwise(F.make_date(year, F.lit(2), F.lit(28)))
