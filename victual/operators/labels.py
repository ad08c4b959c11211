"""Nutrition labels: from recognised text to a draft of a food."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import parse_decimal
from ..schemas import NUTRIENTS, UNIT

#: How labels write numbers, the base amount, the serving, and what hints at one.
_N = r"(\d+(?:[,.]\d+)?)"
#: How labels name the nutrients, and the unit that follows the number.
NAMES = {
    "kcal": ("valor energ[eé]tico", "kcal"),
    "carbsG": ("carboidratos", "g"),
    "sugarsG": ("a[cç][uú]cares totais", "g"),
    "addedSugarsG": ("a[cç][uú]cares adicionados", "g"),
    "proteinG": ("prote[ií]nas", "g"),
    "fatG": ("gorduras totais", "g"),
    "saturatedFatG": ("gorduras saturadas", "g"),
    "transFatG": ("gorduras trans", "g"),
    "fiberG": ("fibra alimentar", "g"),
    "sodiumMg": ("s[oó]dio", "mg"),
}
BASIS = r"100\s*(g|ml)"
SERVING = rf"por[cç][aã]o[:\s]*{_N}\s*(g|ml)(?:\s*\({_N}\s*([^)]+?)\))?"
MENTIONS = "unidade|por[cç][aã]o"
#: The warnings, in order.
NO_BASIS = "Base nutricional não identificada."
FEW = "Poucos nutrientes foram reconhecidos."
NO_UNIT = "Revise manualmente a relação de porção/unidade."
LEAST = 3


def _find(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, "(?iu)" + pattern, group), F.lit(""))


def singular(word: Column) -> Column:
    """Without a final ``es`` or ``s``."""
    low = F.lower(word)
    return F.when(low.endswith("es"), F.left(word, F.length(word) - 2)).when(low.endswith("s"), F.left(word, F.length(word) - 1)).otherwise(word)


def _truthy(number: Column) -> Column:
    return number.isNotNull() & (number != 0)


def parse_labels(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``nutritionBasis, nutrition, servingUnits, warnings, confidence``.

    The basis is the first "100 g" or "100 ml", else the serving.  A serving
    unit's id derives from the text, so reruns agree.
    """
    normal = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+", " "))
    out = rows.withColumn("_t", normal)
    t = F.col("_t")
    out = out.withColumns({"_basis": F.lower(_find(t, BASIS)), "_amount": parse_decimal(_find(t, SERVING)), "_unit": F.lower(_find(t, SERVING, 2)), "_quantity": parse_decimal(_find(t, SERVING, 3)), "_label": _find(t, SERVING, 4)})
    out = out.withColumn("nutrition", F.struct(*[parse_decimal(_find(t, rf"{NAMES[n][0]}\s+{_N}\s*{NAMES[n][1]}")).alias(n) for n in NUTRIENTS]))
    kind = F.coalesce("_basis", F.when(_truthy(F.col("_amount")), F.col("_unit")))
    size = F.when(F.col("_basis").isNotNull(), F.lit(100.0)).otherwise(F.col("_amount"))
    basis = F.when(
        kind.isNotNull(),
        F.struct(F.when(kind == "g", "mass").otherwise("volume").alias("type"), F.when(kind == "g", size).alias("grams"), F.when(kind == "ml", size).alias("ml")),
    )
    raw = F.regexp_replace(F.trim("_label"), r"\.$", "")
    unit = F.struct(
        F.sha2(t.cast("binary"), 256).alias("id"), singular(F.trim(raw)).alias("singular"), raw.alias("plural"), F.col("_quantity").alias("quantity"),
        F.when(F.col("_unit") == "g", F.col("_amount")).alias("grams"), F.when(F.col("_unit") == "ml", F.col("_amount")).alias("ml"),
    )
    has_unit = F.col("_label").isNotNull() & _truthy(F.col("_quantity")) & _truthy(F.col("_amount"))
    out = out.withColumns({"nutritionBasis": basis, "servingUnits": F.when(has_unit, F.array(unit)).otherwise(F.array().cast(f"array<{UNIT}>"))})
    known = sum((F.col(f"nutrition.{n}").isNotNull().cast("int") for n in NUTRIENTS[1:]), F.col("nutrition.kcal").isNotNull().cast("int"))
    few, mentions = known < LEAST, t.rlike("(?iu)" + MENTIONS)
    warnings = F.array_compact(F.array(F.when(F.col("nutritionBasis").isNull(), NO_BASIS), F.when(few, FEW), F.when((F.size("servingUnits") == 0) & mentions, NO_UNIT)))
    out = out.withColumn("warnings", warnings)
    confidence = F.when(F.size("warnings") == 0, "high").when(~few, "medium").otherwise("low")
    return out.withColumn("confidence", confidence).drop("_t", "_basis", "_amount", "_unit", "_quantity", "_label")


def food_drafts(parsed: DataFrame, name: Column, text: str = "text") -> DataFrame:
    """Partial foods of parsed labels, with their provenance."""
    provenance = F.to_json(F.struct(F.col("warnings"), F.col("confidence"), F.col(text).alias("rawText")))
    return parsed.select(name.alias("name"), "nutritionBasis", "nutrition", "servingUnits", F.lit("label-ocr").alias("source"), provenance.alias("sourceMetadata"))
