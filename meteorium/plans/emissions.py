"""Emission tables from spreadsheet cells."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..operators import series
from ..session import materialize

# Global warming potentials and the row numbers of the published categories.
GWP = {"co2": 1.0, "ch4": 25.0, "n2o": 298.0}
HISTORICAL = {
    "total_source": 59, "energy_industries": 3, "manufacturing_construction_fuels": 4, "transport": 5,
    "industrial_processes": 12, "residential_commercial_agricultural_forestry_fishing_fuels": 6, "agriculture": 21,
    "waste": 41, "international_aviation": 51, "international_navigation": 52, "co2_emissions_from_biomass": 54, "lulucf": 32}
HISTORICAL_OTHERS = [7, 8]
ENERGY = {
    "total": 1, "fuel_combustion_activities.total": 2, "fuel_combustion_activities.energy_industries": 3,
    "fuel_combustion_activities.manufacturing_construction": 4, "fuel_combustion_activities.transport": 5,
    "fuel_combustion_activities.other_sectors": 6, "fuel_combustion_activities.other": 7,
    "fugitive_emissions_from_fuels.total": 8, "fugitive_emissions_from_fuels.solid_fuels": 9,
    "fugitive_emissions_from_fuels.oil_natural_gas_and_energy_production": 10, "co2_transport_storage": 11}
INDUSTRY = {"total": 12, "mineral_industry": 13, "chemical_industry": 14, "metal_industry": 15,
            "non_energy_products_from_fuels": 16, "electronic_industry": 17, "product_usese_as_ODS": 18,
            "other_product_manufacture_use": 19, "other": 20}
AGRICULTURE = {"total": 21, "enteric_fermentation": 22, "manure_management": 23, "rice_cultivation": 24,
               "agricultural_soils": 25, "prescribed_burning_of_savannas": 26, "field_burning_agricultural_residues": 27,
               "liming": 28, "urea_application": 29, "carbon_containing_fertilizers": 30, "other": 31}
LAND_USE = {"total": 32, "forest_land": 33, "cropland": 34, "grassland": 35, "wetlands": 36, "settlements": 37,
            "other_land": 38, "harvested_wood_prducts": 39, "other": 40}
WASTE = {"total": 41, "solid_waste_disposal": 42, "biological_treatment_solid_waste": 43,
         "incineration_open_burning_waste": 44, "waste_water_treatment_discharge": 45, "other": 46}
MEMO = {"international_bunkers.total": 50, "international_bunkers.aviation": 51, "international_bunkers.navigation": 52,
        "multilateral_operations": 53, "co2_emissions_from_biomass": 54, "co2_captured": 55,
        "longerim_storage_waste_disposal": 56, "indirect_n20": 57, "indirect_co2": 58}
HISTORICAL_TABLES = {"energy": ENERGY, "industrial_processes": INDUSTRY, "agriculture": AGRICULTURE, "lulucf": LAND_USE,
                     "waste": WASTE, "memo_items": MEMO}
PROJECTION = {"total_source": 19, "energy_industries": 2, "manufacturing_construction_fuels": 3, "transport": 4,
              "industrial_processes": 8, "residential_commercial_agricultural_forestry_fishing_fuels": 5, "agriculture": 9,
              "waste": 18, "lulucf": 10}
PROJECTION_OTHERS = [6, 7]
PROJECTION_BLOCKS = {"current": (20, 27), "bau": (60, 67), "additional_nuclear": (28, 35), "additional_synthetic": (36, 43),
                     "ambitious_additional_nuclear": (44, 51), "ambitious_additional_synthetic": (52, 59)}
PARIS_COLUMNS = {"bau": 3, "nepn": 4, "ec": 6, "paris20": 8, "paris15": 10}
TRANSPORT_ROWS = {"total": 0, "domestic_aviation": 6, "road_transporation.total": 10, "road_transporation.cars": 18,
                  "road_transporation.light_duty_trucks": 26, "road_transporation.motorcycles": 42,
                  "road_transporation.other": 51, "railways": 52, "domestic_navigation": 58, "other_transportation": 66}
BUNKER_ROWS = {"international_aviation": 56, "international_navigation": 57}


def co2_equivalent(gas: str | Column, amount: str | Column, weights: dict[str, float] = GWP) -> Column:
    """Amount times the gas's warming potential; unknown gases count 0."""
    g = F.col(gas) if isinstance(gas, str) else gas
    a = F.col(amount) if isinstance(amount, str) else amount
    items = list(weights.items())
    expr = reduce(lambda acc, kv: acc.when(g == kv[0], F.lit(kv[1])), items[1:], F.when(g == items[0][0], F.lit(items[0][1])))
    return a * expr.otherwise(F.lit(0.0))


def wide_table(cells: DataFrame, key: list[str], code: str, value: str, columns: dict[str, int],
               sums: dict[str, list[int]] | None = None) -> DataFrame:
    """Select coded rows as named columns, one output row per key.

    One conditional sum per column in a single aggregation: a pivot whose column list is fixed, with map-side partial sums
    and without a first pass to find the codes.  A column of ``sums`` is null where one of its codes has no number.
    """
    wanted = sorted({*columns.values(), *(c for cs in (sums or {}).values() for c in cs)})
    pick = lambda c: F.sum(F.when(F.col(code) == c, F.col(value)))
    return cells.filter(F.col(code).isin(wanted)).groupBy(*key).agg(
        *[pick(c).alias(n) for n, c in columns.items()],
        *[reduce(add, map(pick, cs)).alias(n) for n, cs in (sums or {}).items()])


def historical(cells: DataFrame, year: str = "year", code: str = "code", raw: str = "raw") -> dict[str, DataFrame]:
    """All seven historical tables from one aggregation; notation keys become null."""
    tables = {"historical": HISTORICAL, **HISTORICAL_TABLES}
    codes = {t: sorted({*c.values(), *(HISTORICAL_OTHERS if t == "historical" else [])}) for t, c in tables.items()}
    numbers = cells.withColumn("_v", F.col(raw).try_cast("double")).filter(F.col(code).isin(sorted({c for cs in codes.values() for c in cs})))
    sums = {c: F.sum(F.when(F.col(code) == c, F.col("_v"))).alias(f"c{c}") for cs in codes.values() for c in cs}
    there = [F.max(F.col(code).isin(cs)).alias(f"in_{t}") for t, cs in codes.items()]
    wide = materialize(numbers.groupBy(year).agg(*sums.values(), *there))
    out = {t: wide.filter(f"in_{t}").select(year, *[F.col(f"c{c}").alias(n) for n, c in columns.items()]) for t, columns in tables.items()}
    others = reduce(add, (F.col(f"c{c}") for c in HISTORICAL_OTHERS)).alias("others")
    return out | {"historical": wide.filter("in_historical").select(year, *[F.col(f"c{c}").alias(n) for n, c in HISTORICAL.items()], others)}


def transport(cells: DataFrame, bunkers: DataFrame, vehicles: DataFrame, year: str = "year") -> DataFrame:
    """Transport breakdown in CO2 equivalents.

    ``cells``: (year, row, gas, raw); ``bunkers``: (year, row, raw); ``vehicles``: (year, vehicle, gas, raw) with vehicle
    ``heavy_duty_trucks`` or ``buses``.  Notation keys count as 0.
    """
    main = wide_table(cells.withColumn("_v", co2_equivalent("gas", num.number_or_zero("raw"))), [year], "row", "_v", TRANSPORT_ROWS)
    sea_air = wide_table(bunkers.withColumn("_v", num.number_or_zero("raw")), [year], "row", "_v", BUNKER_ROWS)
    v = vehicles.withColumn("_v", co2_equivalent("gas", num.number_or_zero("raw"))).groupBy(year).agg(
        *[F.sum(F.when(F.col("vehicle") == n, F.col("_v"))).alias(f"road_transporation.{n}") for n in ("heavy_duty_trucks", "buses")])
    return main.join(sea_air, year, "left").join(v, year, "left")


def projections(sheet: DataFrame, first_year: int = 2020, step: int = 5, rows: tuple[int, int] = (23, 44)) -> DataFrame:
    """All projection scenarios interpolated to every year, in one pass.  ``sheet``: long cells (row, col, raw)."""
    blocks = [F.when(F.col("col").between(c0, c1 - 1), F.struct(F.lit(name).alias("scenario"), F.lit(c0).alias("first"))) for name, (c0, c1) in PROJECTION_BLOCKS.items()]
    cells = sheet.withColumn("_b", F.coalesce(*blocks)).filter(F.col("_b").isNotNull() & F.col("row").between(rows[0], rows[1] - 1))
    placed = cells.select("_b.scenario", (F.col("row") - rows[0]).alias("row"), (F.lit(first_year) + (F.col("col") - F.col("_b.first")) * step).alias("year"),
                          F.col("raw").try_cast("double").alias("value"))
    yearly = series.interpolate_yearly(placed, ["scenario", "row"], "year", ["value"])
    return wide_table(yearly, ["scenario", "year"], "row", "value", PROJECTION, {"others": PROJECTION_OTHERS})


def paris(sheet: DataFrame, first_year: int = 2020, n_years: int = 11) -> DataFrame:
    """The five reduction paths, one column each."""
    cells = sheet.filter(F.col("row") < n_years).withColumns({"year": F.lit(first_year) + F.col("row"),
                                                             "value": F.col("raw").try_cast("double")})
    return wide_table(cells, ["year"], "col", "value", PARIS_COLUMNS)


def sea_level(requests: DataFrame, projections_table: DataFrame, surcharge: DataFrame) -> DataFrame:
    """Median, low and high rise at (scenario, year) plus the surcharge of the probability.

    ``projections_table``: (scenario, year, median, low, high); ``surcharge``: (probability, cm).
    """
    found = series.lookup_piecewise(requests, projections_table, ["scenario"], "year", "at_year", {f"rise_{c}": c for c in ("median", "low", "high")})
    return found.join(surcharge, "probability", "left").withColumn("total", F.col("rise_median") + F.col("cm"))


def legacy_level(requests: DataFrame, table: DataFrame, offset: float) -> DataFrame:
    """Level of the older map: offset plus the table value at (scenario, probability, year)."""
    return requests.join(table, ["scenario", "probability", "year"], "left").withColumn("level", F.lit(offset) + F.col("cm"))
