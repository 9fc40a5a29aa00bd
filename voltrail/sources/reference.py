"""Small reference tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail.functions import scalars

#: Battery capacity in kWh by model, maker and battery type.
BATTERIES = (
    ("208 V2 (P21)", "PEUGEOT", "L2 640 60AH EF 640 EN", 50.0),
    ("2008 V2 (P24)", "PEUGEOT", "L2 640 60AH EF 640 EN", 50.0),
    ("C4 V3 (C41E)", "CITROEN", "L2 640 60AH EF 640 EN", 50.0),
    ("DS3 CROSSBACK (D34)", "DS", "L2 640 60AH EF 640 EN", 50.0),
    ("C4X (C43E)", "CITROEN", "L2 640 60AH EF 640 EN", 50.0),
    ("308 V3 (P512)", "PEUGEOT", "L3 720 70AH EF 720 EN", 54.0),
    ("BERLINGO (K9 EUROPE)", "CITROEN", "L2 640 60AH EF 640 EN", 52.0),
    ("RIFTER / PARTNER (K9 EUROPE)", "PEUGEOT", "L2 640 60AH EF 640 EN", 52.0),
    ("RIFTER / PARTNER (K9 EUROPE)", "PEUGEOT", "L3 760 70AH EFBC 760 EN EFBC", 52.0),
    ("TRAVELLER / EXPERT 4 (K0)", "PEUGEOT", "L2 640 640 EN", 50.0),
    ("SPACETOURER / JUMPY 4 (K0)", "CITROEN", "L2 640 640 EN", 50.0),
    ("SPACETOURER / JUMPY 4 (K0)", "CITROEN", "L3 760 70AH EFBC 760 EN EFBC", 75.0),
    ("TRAVELLER / EXPERT 4 (K0)", "PEUGEOT", "L3 760 70AH EFBC 760 EN EFBC", 75.0),
)
KEYS = ["car_model", "manufacturer", "battery_type"]


def batteries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pa.table(dict(zip([*KEYS, "battery_capacity_kwh"], zip(*BATTERIES)))))


def with_battery(df: DataFrame) -> DataFrame:
    """Adds battery_capacity_kwh; the keys are cleaned on both sides."""
    clean = lambda d: d.withColumns({c: scalars.clean_text(F.col(c)) for c in KEYS})
    return clean(df).join(F.broadcast(clean(batteries(df.sparkSession))), KEYS, "left")  # 13 rows
