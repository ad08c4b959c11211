"""Product JSON of an open food database: to partial foods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import product_number
from ..schemas import NUTRIENTS, UNIT

PRODUCT = "product_name string, brands string, nutriments map<string,string>"
#: The keys of the nutrients; sodium has two.
KEYS = {
    "kcal": "energy-kcal_100g",
    "carbsG": "carbohydrates_100g",
    "sugarsG": "sugars_100g",
    "addedSugarsG": "added-sugars_100g",
    "proteinG": "proteins_100g",
    "fatG": "fat_100g",
    "saturatedFatG": "saturated-fat_100g",
    "transFatG": "trans-fat_100g",
    "fiberG": "fiber_100g",
}
#: The column of the response's status code, where it's known, and the error where that isn't 2xx.
HTTP, UNAVAILABLE = "http_status", "product-service-unavailable"
SODIUM_G, SODIUM_MG = "sodium_100g", "sodium_mg_100g"


def _value(nutriments: Column, key: str) -> Column:
    return product_number(F.try_element_at(nutriments, F.lit(key)))


def normalize(rows: DataFrame, json: str = "json", barcode: str = "barcode") -> DataFrame:
    """Partial foods of ``rows(barcode, json)``; JSON that can't be read has no nutrients and a default name."""
    out = rows.withColumn("_p", F.from_json(json, PRODUCT))
    nutriments = F.col("_p.nutriments")
    sodium = F.coalesce(_value(nutriments, SODIUM_G) * 1000, _value(nutriments, SODIUM_MG))
    values = [(sodium if n == "sodiumMg" else _value(nutriments, KEYS[n])).alias(n) for n in NUTRIENTS]
    basis = F.struct(F.lit("mass").alias("type"), F.lit(100.0).alias("grams"), F.lit(None).cast("double").alias("ml"))
    return out.select(
        F.coalesce(F.nullif(F.col("_p.product_name"), F.lit("")), F.concat(F.lit("Produto "), F.col(barcode))).alias("name"),
        F.col("_p.brands").alias("brand"), F.col(barcode).alias("barcode"), basis.alias("nutritionBasis"), F.struct(*values).alias("nutrition"),
        F.array().cast(f"array<{UNIT}>").alias("servingUnits"), F.lit("open-food-facts").alias("source"),
        F.to_json(F.struct(F.lit("Open Food Facts").alias("provider"), F.col(json).alias("rawProduct"))).alias("sourceMetadata"),
    )


def from_responses(rows: DataFrame, response: str = "response", barcode: str = "barcode") -> DataFrame:
    """Foods of API responses: those with status 1 and a product.  Failed ones have none; see ``failed_responses``."""
    if HTTP in rows.columns:
        rows = rows.where(F.col(HTTP).between(200, 299))
    read = rows.withColumn("_r", F.from_json(response, "status int, product string"))
    found = read.where("_r.status = 1 and _r.product is not null").select(F.col(barcode), F.col("_r.product").alias("json"))
    return normalize(found, "json", barcode)


def failed_responses(rows: DataFrame, barcode: str = "barcode") -> DataFrame:
    """``barcode, error`` of responses whose ``http_status`` isn't 2xx."""
    return rows.where(~F.coalesce(F.col(HTTP).between(200, 299), F.lit(False))).select(barcode, F.lit(UNAVAILABLE).alias("error"))


def lookup_path(barcode: Column) -> Column:
    """The path of a product's JSON below a product API, with the code escaped."""
    return F.concat(F.lit("/api/v2/product/"), F.replace(F.url_encode(barcode), F.lit("+"), F.lit("%20")), F.lit(".json"))
