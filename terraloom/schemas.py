"""Explicit schemas and the fixed dimension tables.

The lists below are fixed values (names, coordinates, codes, limits) stated as plain data.
Each is a few rows long and never grows, so joins against them may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --------------------------------------------------------------------------- fixed values
CLASSES = ["Forest", "Water", "Agriculture", "Urban", "Others"]

FINE_CLASSES = [
    ("AnnualCrop", "Agriculture"),
    ("Forest", "Forest"),
    ("HerbaceousVegetation", "Agriculture"),
    ("Highway", "Urban"),
    ("Industrial", "Urban"),
    ("Pasture", "Agriculture"),
    ("PermanentCrop", "Agriculture"),
    ("Residential", "Urban"),
    ("River", "Water"),
    ("SeaLake", "Water"),
]

REGIONS = {"jk": (32.0, 37.0, 73.0, 80.0), "india": (6.5, 38.5, 66.5, 100.0)}
RESOLUTION = {"jk": 0.25, "india": 0.5}

VARIABLES = [
    # name, units, long name, point-feed code, station-agency code, archive code
    ("tmean", "degC", "Mean 2m air temperature", "T2M", "tmean", "temperature_2m_mean"),
    ("tmax", "degC", "Maximum 2m air temperature", "T2M_MAX", "tmax", "temperature_2m_max"),
    ("tmin", "degC", "Minimum 2m air temperature", "T2M_MIN", "tmin", "temperature_2m_min"),
    ("rain", "mm/day", "Precipitation", "PRECTOTCORR", "rain", "precipitation_sum"),
    ("lst", "degC", "Land surface temperature (satellite skin temp)", "TS", None, None),
]

DISTRICTS = [
    # name, elevation factor, rainfall multiplier
    ("Baramulla", 1.9, 1.15),
    ("Srinagar", 1.6, 1.05),
    ("Kishtwar", 2.1, 0.95),
    ("Doda", 1.7, 0.85),
    ("Anantnag", 1.4, 0.80),
    ("Udhampur", 0.8, 0.90),
    ("Rajouri", 0.9, 1.10),
    ("Kathua", 0.4, 1.00),
    ("Jammu", 0.2, 1.20),
]

DISTRICT_MARKERS = [
    ("Baramulla", 34.20, 74.35), ("Srinagar", 34.08, 74.80), ("Kishtwar", 33.31, 75.77),
    ("Doda", 33.15, 75.55), ("Anantnag", 33.73, 75.15), ("Udhampur", 32.93, 75.13),
    ("Rajouri", 33.38, 74.31), ("Kathua", 32.37, 75.52), ("Jammu", 32.73, 74.87),
]

CITY_MARKERS = [
    ("Delhi", 28.61, 77.21), ("Mumbai", 19.08, 72.88), ("Kolkata", 22.57, 88.36),
    ("Chennai", 13.08, 80.27), ("Bengaluru", 12.97, 77.59), ("Hyderabad", 17.38, 78.49),
    ("Ahmedabad", 23.03, 72.58), ("Srinagar", 34.08, 74.80), ("Jaipur", 26.91, 75.79),
    ("Lucknow", 26.85, 80.95), ("Bhopal", 23.26, 77.41), ("Guwahati", 26.14, 91.74),
    ("Nagpur", 21.15, 79.09), ("Patna", 25.59, 85.14), ("Bhubaneswar", 20.30, 85.82),
]

WEATHER_STATIONS = [
    ("Srinagar", 34.08, 74.80), ("Jammu", 32.73, 74.87), ("Gulmarg", 34.05, 74.38),
    ("Pahalgam", 34.01, 75.31), ("Leh (Ladakh)", 34.16, 77.58), ("Kupwara", 34.53, 74.26),
]

WEATHER_CODES = [
    (0, "Clear sky"), (1, "Mainly clear"), (2, "Partly cloudy"), (3, "Overcast"),
    (45, "Fog"), (48, "Rime fog"),
    (51, "Light drizzle"), (53, "Drizzle"), (55, "Heavy drizzle"),
    (56, "Freezing drizzle"), (57, "Freezing drizzle"),
    (61, "Light rain"), (63, "Rain"), (65, "Heavy rain"),
    (66, "Freezing rain"), (67, "Freezing rain"),
    (71, "Light snow"), (73, "Snow"), (75, "Heavy snow"), (77, "Snow grains"),
    (80, "Rain showers"), (81, "Rain showers"), (82, "Violent showers"),
    (85, "Snow showers"), (86, "Heavy snow showers"),
    (95, "Thunderstorm"), (96, "Storm w/ hail"), (99, "Storm w/ hail"),
]

REFRESH_JOBS = [
    ("power", "rain", "jk"), ("power", "tmean", "jk"), ("power", "lst", "jk"),
    ("openmeteo", "rain", "jk"), ("openmeteo", "tmean", "jk"),
    ("power", "rain", "india"), ("power", "tmean", "india"),
]

COORDINATE_NAMES = {"latitude": "lat", "Latitude": "lat", "y": "lat", "longitude": "lon", "Longitude": "lon", "x": "lon"}

# --------------------------------------------------------------------------- schemas
_D, _S, _I, _L, _B = T.DoubleType(), T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


DAILY_OBS = _struct(station=_S, obs_date=T.DateType(), tmean=_D, tmin=_D, tmax=_D, precip=_D)
RECORD_TEXT = _struct(ds=_S, temp_mean=_S, temp_min=_S, temp_max=_S, precip=_S)
GRID_OBS = _struct(source=_S, var=_S, region=_S, obs_date=T.DateType(), lat=_D, lon=_D, value=_D)
GRID_CLIM = _struct(source=_S, var=_S, region=_S, month=_I, lat=_D, lon=_D, value=_D)
MANIFEST_ENTRY = _struct(
    id=_S, source=_S, var=_S, units=_S, region=_S, bbox=T.ArrayType(_D), res_deg=_D, start=_S, end=_S, days=_L,
    grid_shape=T.ArrayType(_L), n_cells=_L, valid_cells=_L, mean=_D, min=_D, max=_D, native_res_deg=_D, kind=_S,
    path=_S, created_at=_S, status=_S,
)
MANIFEST = _struct(datasets=T.ArrayType(MANIFEST_ENTRY))
POINT_FEED = _struct(properties=_struct(parameter=T.MapType(_S, T.MapType(_S, _D))))
ARTICLE_A = _struct(title=_S, description=_S, url=_S, urlToImage=_S, source=_struct(name=_S), publishedAt=_S)
ARTICLE_B = _struct(title=_S, description=_S, url=_S, image=_S, source=_struct(name=_S), publishedAt=_S)
WEATHER_PAYLOAD = T.ArrayType(
    _struct(
        current=_struct(
            temperature_2m=_D, relative_humidity_2m=_D, apparent_temperature=_D, precipitation=_D,
            weather_code=_I, wind_speed_10m=_D, time=_S,
        ),
        daily=_struct(
            temperature_2m_max=T.ArrayType(_D), temperature_2m_min=T.ArrayType(_D),
            precipitation_probability_max=T.ArrayType(_D),
        ),
    )
)
DETECTION = _struct(type=_S, confidence=_D, affected_area_pct=_D, evidence=_S)
DOCUMENT = _struct(
    id=_S, name=_S, email=_S, owner=_S, created_at=_S, category=_S, severity=_S,
    land_cover=T.MapType(_S, _D), object_counts=T.MapType(_S, _L), confidence=_D, report_url=_S,
    changed_percent=_D, primary=_S, mode=_S, region=_S, affected_area_pct=_D, overlay_url=_S,
    location=_struct(lat=_D, lon=_D),
    transitions=T.ArrayType(_struct(**{"from": _S, "to": _S, "pct": _D, "percent": _D})),
)
BACKTEST_METHOD = _struct(rmse=_D, mae=_D, skill_pct=_D, rmse_by_lead=T.ArrayType(_D))


# --------------------------------------------------------------------------- dimension tables
def dim_variable(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        VARIABLES, _struct(var=_S, units=_S, long_name=_S, point_code=_S, agency_code=_S, archive_code=_S)
    )


def dim_region(spark: SparkSession) -> DataFrame:
    rows = [(k, *map(float, v), RESOLUTION[k]) for k, v in REGIONS.items()]
    return spark.createDataFrame(rows, _struct(region=_S, lat0=_D, lat1=_D, lon0=_D, lon1=_D, res_deg=_D))


def dim_marker(spark: SparkSession) -> DataFrame:
    rows = [("jk", *m) for m in DISTRICT_MARKERS] + [("india", *m) for m in CITY_MARKERS]
    return spark.createDataFrame(rows, _struct(region=_S, name=_S, lat=_D, lon=_D))


def dim_weather_code(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WEATHER_CODES, _struct(weather_code=_I, condition=_S))


def dim_class(spark: SparkSession) -> DataFrame:
    rows = [(i, fine, CLASSES.index(app), app) for i, (fine, app) in enumerate(FINE_CLASSES)]
    return spark.createDataFrame(rows, _struct(fine_cls=_I, fine_name=_S, cls=_I, name=_S))
