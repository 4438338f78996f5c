"""The crop profile dimension (22 rows).

Each profile holds seven numeric (lo, hi) ranges, the soils the crop is grown
on and the condition -> fertilizer map used by the limiting-nutrient rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# They must equal the reference's generator input for results to
# agree. Columns: crop, N, P, K, temperature, humidity, ph, rainfall ranges,
# soils, and the fertilizer for N_low, P_low, K_low, balanced.
PROFILES = [
    ("rice", (60, 80), (35, 45), (35, 45), (20, 27), (80, 90), (5.5, 7.0), (180, 270), ["Clayey", "silty clay", "laterite"], ("Urea", "DAP", "MOP", "Urea and DAP")),
    ("maize", (70, 90), (45, 55), (40, 50), (18, 27), (55, 70), (5.5, 7.5), (80, 110), ["sandy", "alluvial", "clay loam"], ("Urea", "DAP", "MOP", "Good NPK")),
    ("chickpea", (30, 50), (55, 75), (65, 80), (15, 25), (14, 30), (6.0, 8.0), (65, 105), ["sandy", "alluvial", "clay loam"], ("Urea", "DAP", "MOP", "DAP and MOP")),
    ("kidneybeans", (15, 25), (55, 75), (15, 25), (15, 25), (18, 28), (5.5, 7.0), (100, 130), ["alluvial", "clay loam", "sandy"], ("Urea", "DAP", "MOP", "DAP and MOP")),
    ("pigeonpeas", (15, 25), (55, 75), (15, 25), (25, 35), (45, 60), (5.0, 7.0), (140, 155), ["alluvial", "laterite", "clay loam"], ("Urea", "DAP", "MOP", "Good NPK")),
    ("mothbeans", (15, 25), (40, 60), (15, 25), (25, 35), (45, 60), (3.5, 6.5), (40, 60), ["sandy", "alluvial", "laterite"], ("Urea", "DAP", "MOP", "DAP and MOP")),
    ("mungbean", (15, 25), (55, 75), (15, 25), (25, 35), (80, 90), (6.0, 7.5), (45, 65), ["alluvial", "clay loam", "sandy"], ("Urea", "DAP", "MOP", "Urea and DAP")),
    ("blackgram", (15, 25), (55, 75), (15, 25), (25, 35), (60, 70), (5.5, 7.0), (65, 75), ["alluvial", "laterite", "clay loam"], ("Urea", "DAP", "MOP", "Good NPK")),
    ("lentil", (15, 25), (55, 75), (15, 25), (18, 28), (65, 75), (6.0, 8.0), (45, 55), ["alluvial", "clay loam", "sandy"], ("Urea", "DAP", "MOP", "DAP and MOP")),
    ("pomegranate", (15, 25), (55, 75), (35, 45), (18, 24), (90, 95), (5.5, 7.0), (100, 115), ["laterite", "alluvial", "clay loam"], ("Urea", "DAP", "MOP", "Urea and MOP")),
    ("banana", (90, 115), (55, 75), (45, 55), (25, 35), (75, 90), (5.5, 7.0), (100, 115), ["alluvial", "clay loam", "Clayey"], ("Urea", "DAP", "MOP", "Good NPK")),
    ("mango", (15, 25), (15, 25), (25, 35), (25, 35), (45, 55), (5.5, 7.5), (90, 115), ["alluvial", "laterite", "sandy"], ("Urea", "DAP", "MOP", "Urea and DAP")),
    ("grapes", (15, 25), (120, 145), (195, 210), (8, 17), (80, 90), (5.5, 7.0), (65, 75), ["laterite", "alluvial", "clay loam"], ("Urea", "DAP", "MOP", "DAP and MOP")),
    ("watermelon", (95, 115), (8, 16), (45, 55), (24, 30), (80, 90), (6.0, 7.0), (45, 60), ["sandy", "alluvial", "clay loam"], ("Urea", "DAP", "MOP", "Urea and MOP")),
    ("muskmelon", (95, 115), (8, 16), (45, 55), (28, 38), (85, 95), (6.0, 7.0), (20, 30), ["sandy", "alluvial", "coastal"], ("Urea", "DAP", "MOP", "Good NPK")),
    ("apple", (15, 25), (120, 145), (195, 210), (21, 24), (90, 95), (5.5, 7.0), (110, 125), ["clay loam", "alluvial", "laterite"], ("Urea", "DAP", "MOP", "DAP and MOP")),
    ("orange", (15, 25), (15, 25), (8, 16), (22, 32), (85, 95), (6.0, 7.5), (100, 115), ["alluvial", "clay loam", "coastal"], ("Urea", "DAP", "MOP", "Good NPK")),
    ("papaya", (45, 55), (35, 55), (45, 55), (33, 38), (90, 95), (6.0, 7.0), (140, 155), ["alluvial", "Clayey", "sandy"], ("Urea", "DAP", "MOP", "Urea and DAP")),
    ("coconut", (4, 6), (4, 6), (4, 6), (24, 28), (90, 96), (5.0, 8.0), (145, 180), ["laterite", "coastal", "sandy"], ("Urea", "DAP", "MOP", "Good NPK")),
    ("cotton", (115, 135), (40, 60), (15, 25), (23, 30), (75, 85), (6.0, 8.0), (80, 95), ["alluvial", "Clayey", "clay loam"], ("Urea", "DAP", "MOP", "Urea and MOP")),
    ("jute", (60, 85), (40, 55), (35, 45), (23, 27), (75, 90), (6.0, 7.0), (160, 200), ["alluvial", "Clayey", "silty clay"], ("Urea", "DAP", "MOP", "Urea and DAP")),
    ("coffee", (95, 115), (25, 35), (25, 35), (23, 28), (55, 65), (6.0, 6.5), (145, 165), ["laterite", "alluvial", "clay loam"], ("Urea", "DAP", "MOP", "Good NPK")),
]

# Soil and fertilizer vocabularies.
SOILS = ["Clayey", "alluvial", "clay loam", "coastal", "laterite", "sandy", "silty clay"]
FERTILIZERS = ["DAP", "DAP and MOP", "Good NPK", "MOP", "Urea", "Urea and DAP", "Urea and MOP"]

RANGE_FIELDS = ["N", "P", "K", "temperature", "humidity", "ph", "rainfall"]
FMAP_KEYS = ["N_low", "P_low", "K_low", "balanced"]

_RANGE = T.StructType([T.StructField("lo", T.DoubleType(), False),
                       T.StructField("hi", T.DoubleType(), False)])

PROFILE_SCHEMA = T.StructType(
    [T.StructField("pidx", T.IntegerType(), False), T.StructField("crop", T.StringType(), False)]
    + [T.StructField(f, _RANGE, False) for f in RANGE_FIELDS]
    + [T.StructField("soils", T.ArrayType(T.StringType(), False), False),
       T.StructField("fmap", T.MapType(T.StringType(), T.StringType(), False), False)]
)


def profile_rows():
    for i, (crop, *ranges, soils, ferts) in enumerate(PROFILES):
        yield (i, crop, *[(float(lo), float(hi)) for lo, hi in ranges],
               list(soils), dict(zip(FMAP_KEYS, ferts)))


def profiles_df(spark: SparkSession) -> DataFrame:
    """Profile dimension as a typed DataFrame (22 rows, safe to broadcast)."""
    return spark.createDataFrame(list(profile_rows()), PROFILE_SCHEMA)
