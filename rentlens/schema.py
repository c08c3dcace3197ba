"""Schemas and column-name constants."""

from pyspark.sql import types as T

# Raw listing fields in the column order of the sample file; every field is text.
# The misspelling ``maintenence_price`` is the public column name and is kept.
RAW_COLUMNS = [
    "rent_price", "address", "sqr_m", "name_place", "rei_price", "shikikin",
    "maintenence_price", "nearest_eki", "apartment_type", "year_built",
    "ku_name", "floor", "house_type",
]
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

# Derived listings carry a key and a scrape time in front of the raw fields.
KEYED_RAW_SCHEMA = T.StructType(
    [T.StructField("listing_id", T.LongType(), True),
     T.StructField("scraped_at", T.TimestampNTZType(), True)] + RAW_SCHEMA.fields)

CLEAN_COLUMNS = [
    "rent_price", "address", "sqr_m", "name_place", "rei_price", "shikikin",
    "maintenence_price", "apartment_type", "year_built", "ku_name", "floor",
    "house_type", "eki_walk", "eki_name",
]
CLEAN_TYPES = {
    "rent_price": T.DoubleType(), "address": T.StringType(), "sqr_m": T.DoubleType(),
    "name_place": T.StringType(), "rei_price": T.DoubleType(), "shikikin": T.DoubleType(),
    "maintenence_price": T.DoubleType(), "apartment_type": T.StringType(),
    "year_built": T.IntegerType(), "ku_name": T.StringType(), "floor": T.IntegerType(),
    "house_type": T.StringType(), "eki_walk": T.IntegerType(), "eki_name": T.StringType(),
}

TARGET = "rent_price"
# Model features in cleaned column order (the champion's X).
FEATURES = ["sqr_m", "rei_price", "shikikin", "maintenence_price", "year_built", "floor", "eki_walk"]
# The notebook's four-feature model.
NOTEBOOK_FEATURES = ["rei_price", "shikikin", "maintenence_price", "sqr_m"]
# Rent, key money and deposit are in 万円 (10,000 yen); the monthly maintenance fee is in yen.
