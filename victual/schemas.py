"""Record types, fixed lists and default settings.

Tables have an ``owner_id`` beside the fields of a single person's records; a
constant there gives one person's results.
"""

from __future__ import annotations

from pyspark.sql import types as T

#: The nutrients in their canonical order.
NUTRIENTS = ("kcal", "carbsG", "sugarsG", "addedSugarsG", "proteinG", "fatG", "saturatedFatG", "transFatG", "fiberG", "sodiumMg")
#: Energy factors of the activity levels.
ACTIVITY = {"sedentary": 1.2, "light": 1.375, "moderate": 1.55, "active": 1.725, "very-active": 1.9}

NUTRITION = "struct<" + ", ".join(f"{n}: double" for n in NUTRIENTS) + ">"
BASIS = "struct<type: string, grams: double, ml: double>"
UNIT = "struct<id: string, singular: string, plural: string, quantity: double, grams: double, ml: double>"
PROFILE = (
    "struct<currentWeightKg: double, goalWeightKg: double, heightCm: double, birthDate: date, age: double, sex: string, "
    "activityLevel: string, manualTdee: double, desiredWeightChangeKgPerWeek: double>"
)
FOOD_FIELDS = (
    f"id: string, name: string, brand: string, barcode: string, nutritionBasis: {BASIS}, nutrition: {NUTRITION}, "
    f"servingUnits: array<{UNIT}>, source: string, sourceMetadata: string, createdAt: timestamp, updatedAt: timestamp"
)
DIARY_FIELDS = (
    "owner_id: long, id: string, date: date, meal: string, foodId: string, foodName: string, amount: double, unitId: string, "
    f"unitLabel: string, grams: double, ml: double, nutritionSnapshot: {NUTRITION}, createdAt: timestamp"
)
WEIGHT_FIELDS = "owner_id: long, id: string, date: date, kg: double, note: string"
SETTINGS_FIELDS = (
    "owner_id: long, id: string, locale: string, theme: string, mealNames: array<string>, weekStartsOn: int, calorieTargetMode: string, "
    "dailyCalorieTarget: double, weeklyCalorieTarget: double, macroTargets: struct<kcal: double, proteinG: double, carbsG: double, fatG: double>, "
    f"profile: {PROFILE}, reminders: array<struct<id: string, label: string, time: string, enabled: boolean>>, updatedAt: timestamp"
)
FIELDS = {"foods": FOOD_FIELDS, "diaryEntries": DIARY_FIELDS, "weightEntries": WEIGHT_FIELDS, "settings": SETTINGS_FIELDS}
#: What a table is keyed by, beside its owner where it has one.
KEYS = {"foods": ("id",), "diaryEntries": ("owner_id", "id"), "weightEntries": ("owner_id", "id"), "settings": ("owner_id", "id")}


def schema(name: str) -> T.StructType:
    return T._parse_datatype_string(FIELDS[name])  # type: ignore[return-value]


#: Settings of a new owner.
DEFAULT_SETTINGS = {
    "id": "settings",
    "locale": "pt-BR",
    "theme": "system",
    "mealNames": ["Café da manhã", "Almoço", "Jantar", "Lanches"],
    "weekStartsOn": 1,
    "calorieTargetMode": "daily",
    "dailyCalorieTarget": 2000.0,
    "weeklyCalorieTarget": 14000.0,
    "macroTargets": {"kcal": 2000.0, "proteinG": 130.0, "carbsG": 220.0, "fatG": 70.0},
    "profile": {"activityLevel": "moderate"},
    "reminders": [
        {"id": "breakfast", "label": "Log breakfast", "time": "08:00", "enabled": False},
        {"id": "lunch", "label": "Log lunch", "time": "12:30", "enabled": False},
        {"id": "dinner", "label": "Log dinner", "time": "19:30", "enabled": False},
        {"id": "weight", "label": "Log today's weight", "time": "07:30", "enabled": False},
    ],
}
