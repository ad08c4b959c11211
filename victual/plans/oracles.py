"""DuckDB SQL for the registered queries, written against the driver's tables."""

from __future__ import annotations

import json

from ..operators.labels import BASIS, FEW, MENTIONS, NAMES, NO_BASIS, NO_UNIT, SERVING
from ..schemas import ACTIVITY, NUTRIENTS
from ..sources.fixtures import AS_OF

_DAY = f"DATE '{AS_OF}'"
_ALL = ", ".join(NUTRIENTS)


def _r(expression: str, name: str | None = None) -> str:
    return f'floor(({expression} + 2.220446049250313E-16) * 1e6 + 0.5) / 1e6 AS "{name or expression}"'


def _known(prefix: str = "", function: str = "") -> str:
    return ", ".join(_r(f"{function}({prefix}{n})", n) for n in NUTRIENTS)


_TABLES = {
    "food_all": """
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand AS brand, '789' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS barcode,
         p_partkey % 4 = 3 AS volume, (p_partkey % 4 = 3) <> (p_partkey % 13 = 5) AS in_ml, p_partkey AS k, CAST(p_size AS DOUBLE) AS size,
         p_retailprice / 10 AS kcal, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS carbsG, CAST(p_partkey % 30 AS DOUBLE) AS proteinG,
         CAST(p_partkey % 23 AS DOUBLE) AS fatG, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 900 AS DOUBLE) END AS sodiumMg,
         CAST(p_partkey % 11 AS DOUBLE) AS sugarsG, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey % 5 AS DOUBLE) END AS addedSugarsG, CAST(p_partkey % 13 AS DOUBLE) AS saturatedFatG,
         CASE WHEN p_partkey % 6 = 0 THEN 0.5::DOUBLE END AS transFatG, CAST(p_partkey % 17 AS DOUBLE) AS fiberG FROM part""",
    "food": "SELECT * FROM food_all WHERE k % 10 <> 9",
    "intake0": """
  SELECT event_id AS e, user_id AS owner_id, CAST(ts AS DATE) AS date, event_type AS meal, value AS amount, ts AS created,
         (event_id * 37) % (SELECT count(*) FROM part) AS f FROM events WHERE event_type <> 'signup'""",
    "intake": """
  SELECT e, CAST(e AS VARCHAR) AS id, owner_id, date, meal, amount, created, CASE WHEN e % 11 <> 0 THEN CAST(f AS VARCHAR) END AS foodId,
         CASE WHEN e % 17 = 3 THEN 'cup' WHEN e % 2 = 0 THEN CASE WHEN f % 4 = 3 THEN 'ml' ELSE 'g' END ELSE 'unit' END AS unitId FROM intake0""",
    "resolved": f"""
  SELECT i.id, owner_id, date, meal, foodId, amount, created, unitId, fa.name AS foodName, fa.k, fa.k % 10 <> 9 AS alive, volume,
         CASE WHEN unitId = 'g' THEN amount WHEN unitId = 'unit' AND NOT in_ml THEN amount * (size / 4.75) END AS grams,
         CASE WHEN unitId = 'ml' THEN amount WHEN unitId = 'unit' AND in_ml THEN amount * (size / 4.75) END AS ml,
         CASE WHEN unitId IN ('g', 'ml') THEN unitId WHEN unitId = 'unit' THEN CASE WHEN abs(amount) = 1 THEN 'unidade' ELSE 'unidades' END END AS label,
         {_ALL}
  FROM intake i LEFT JOIN food_all fa ON fa.id = i.foodId WHERE i.foodId IS NOT NULL""",
    "scaled": f"""
  SELECT * EXCLUDE ({_ALL}), CASE WHEN volume THEN ml ELSE grams END / 100 AS factor, {", ".join(f"{n} * (CASE WHEN volume THEN ml ELSE grams END / 100) AS {n}" for n in NUTRIENTS)} FROM resolved""",
    "diary": f"""
  SELECT owner_id, id, date, meal, foodId, foodName, created, amount, unitId, label AS unitLabel, grams, ml, {_ALL} FROM scaled WHERE factor IS NOT NULL
  UNION ALL SELECT owner_id, id, date, meal, NULL, 'Quick calories', created, amount, 'kcal', 'kcal', NULL, NULL, amount{", NULL" * 9} FROM intake WHERE foodId IS NULL""",
    "weight": "SELECT user_id AS owner_id, CAST(event_id AS VARCHAR) AS id, CAST(ts AS DATE) AS date, 50 + value / 10 AS kg FROM events WHERE event_type = 'signup'",
    "settings": """
  SELECT c_custkey AS owner_id, c_custkey % 2 AS starts, c_custkey % 3 = 0 AS weekly, CAST(1800 + c_custkey % 10 * 50 AS DOUBLE) AS daily,
         CAST(13000 + c_custkey % 20 * 100 AS DOUBLE) AS weekly_target, CAST(100 + c_custkey % 50 AS DOUBLE) AS t_proteinG, CAST(200 + c_custkey % 60 AS DOUBLE) AS t_carbsG,
         CAST(60 + c_custkey % 30 AS DOUBLE) AS t_fatG, CAST(60 + c_custkey % 40 AS DOUBLE) AS kg,
         CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 9 = 0 THEN 0.0 ELSE CAST(60 + c_custkey % 20 AS DOUBLE) END END AS goal,
         CASE WHEN c_custkey % 19 <> 0 THEN CAST(150 + c_custkey % 50 AS DOUBLE) END AS cm, DATE '1950-01-01' + CAST((c_custkey * 97) % 20000 AS INTEGER) AS birth,
         CASE WHEN c_custkey % 11 = 0 THEN 40.0 END AS age, CASE WHEN c_custkey % 13 <> 0 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'female' ELSE 'male' END END AS sex,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'sedentary' WHEN 'BUILDING' THEN 'light' WHEN 'FURNITURE' THEN 'moderate' WHEN 'HOUSEHOLD' THEN 'active' ELSE 'very-active' END AS level,
         CASE WHEN c_custkey % 7 = 0 THEN 2400.0 END AS manual FROM customer""",
    "weeks": f"SELECT *, {_DAY} - CAST((dayofweek({_DAY}) - starts + 7) % 7 AS INTEGER) AS s FROM settings",
    "label": """
  SELECT p_partkey AS k, CASE WHEN p_partkey % 8 = 2 THEN upper(t) ELSE t END AS text FROM (SELECT p_partkey,
    CASE WHEN p_partkey % 3 <> 0 THEN 'Porção: ' || p_size || CASE WHEN p_partkey % 4 = 3 THEN ' ml' ELSE ' g' END || ' (4,75 unidades.)  ' ELSE '' END ||
    CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN '100 g ' ELSE 'por 100ml ' END ELSE '' END ||
    'Valor energético ' || p_size || ',5 kcal Carboidratos 6.' || p_size || ' g ' ||
    CASE WHEN p_partkey % 4 <> 0 THEN 'Proteínas ' || p_size || ' g Sódio ' || p_size || 'mg' ELSE '' END ||
    CASE WHEN p_partkey % 6 = 1 THEN ' Açúcares totais 1,25 g Gorduras trans 0,3g Fibra alimentar 2 g' ELSE '' END AS t FROM part)""",
}


def _with(sql: str, *tables: str) -> str:
    """``sql`` after the tables it needs."""
    order = list(_TABLES)
    need, stack = set(), list(tables)
    uses = {"food": ["food_all"], "intake": ["intake0"], "resolved": ["intake", "food_all"], "scaled": ["resolved"], "diary": ["scaled", "intake"], "weeks": ["settings"]}
    while stack:
        if (t := stack.pop()) not in need:
            need.add(t)
            stack += uses.get(t, [])
    return "WITH " + ", ".join(f"{t} AS ({_TABLES[t]})" for t in order if t in need) + "\n" + sql


def _decimal(text: str) -> str:
    dotted = f"regexp_replace({text}, '^([^,]*),', '\\1.')"
    return f"CASE WHEN regexp_matches({dotted}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST({dotted} AS DOUBLE) END"


def _found(pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract(t, '(?i){pattern}', {group}), '')"


_RANKED = """
SELECT r.owner_id, CAST(rank AS INTEGER) AS rank, foodId, name FROM r JOIN food ON food.id = foodId WHERE rank <= 8"""
_RECENT = "SELECT owner_id, foodId, row_number() OVER (PARTITION BY owner_id ORDER BY max(created) DESC, min((date, id)) FILTER (WHERE created = latest)) AS rank FROM (SELECT *, max(created) OVER (PARTITION BY owner_id, foodId) AS latest FROM diary WHERE foodId IS NOT NULL) GROUP BY owner_id, foodId"
_FREQUENT = "SELECT owner_id, foodId, row_number() OVER (PARTITION BY owner_id ORDER BY count(*) DESC, min((date, id))) AS rank FROM diary WHERE foodId IS NOT NULL GROUP BY owner_id, foodId"
_PRIOR = lambda days: _with(
    f"""SELECT owner_id, {_r('arg_max(kg, (date, id)) - arg_max(kg, (date, id)) FILTER (WHERE date <= ' + _DAY + f' - {days})', 'change')} FROM weight GROUP BY owner_id""", "weight"
)
_MULTIPLIER = " ".join(f"WHEN '{k}' THEN {v}" for k, v in ACTIVITY.items())
_AGE = f"(year({_DAY}) - year(birth) - CASE WHEN (month({_DAY}), day({_DAY})) < (month(birth), day(birth)) THEN 1 ELSE 0 END)"
_CARD = " UNION ALL ".join(
    f"SELECT owner_id, {k} AS position, '{n}' AS nutrient, coalesce({n}, 0.0) AS value, {f't_{t}' if t else 'CAST(NULL AS DOUBLE)'} AS target FROM j" for k, (n, t) in enumerate([("proteinG", "proteinG"), ("carbsG", "carbsG"), ("fatG", "fatG"), ("sugarsG", None), ("fiberG", None), ("sodiumMg", None)])
)
_PRODUCT = """
  SELECT p_partkey AS k, '789' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS barcode, CASE WHEN p_partkey % 9 = 0 THEN 'Produto 789' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') ELSE p_name END AS name,
         p_brand AS brand, CAST(p_size AS DOUBLE) AS kcal, CAST(p_size || '.5' AS DOUBLE) AS carbsG,
         CASE p_partkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS proteinG, CAST(p_partkey % 11 AS DOUBLE) AS sugarsG, 1.5::DOUBLE AS addedSugarsG,
         10.0::DOUBLE AS saturatedFatG, 0.0::DOUBLE AS transFatG, 0.0::DOUBLE AS fiberG, CAST(NULL AS DOUBLE) AS fatG,
         CASE WHEN p_partkey % 2 = 0 THEN CAST('0.' || p_size AS DOUBLE) * 1000 ELSE CAST(p_size AS DOUBLE) END AS sodiumMg FROM part"""
_CODES = "SELECT '789' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS barcode FROM part UNION ALL SELECT '0'"
_LABEL = f"""
, n AS (SELECT k, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM label
), p AS (
  SELECT k, t, lower({_found(BASIS)}) AS basis, {_decimal(_found(SERVING))} AS amount, lower({_found(SERVING, 2)}) AS unit, {_decimal(_found(SERVING, 3))} AS quantity, {_found(SERVING, 4)} AS label,
         {", ".join(f'{_decimal(_found(rf"{NAMES[n][0]}\s+(\d+(?:[,.]\d+)?)\s*{NAMES[n][1]}"))} AS {n}' for n in NUTRIENTS)} FROM n
), b AS (
  SELECT *, coalesce(basis, CASE WHEN amount <> 0 THEN unit END) AS kind, CASE WHEN basis IS NOT NULL THEN 100.0 ELSE amount END AS bsize,
         label IS NOT NULL AND coalesce(quantity, 0) <> 0 AND coalesce(amount, 0) <> 0 AS has_unit, regexp_replace(trim(label), '\\.$', '') AS raw,
         {" + ".join(f"CAST({n} IS NOT NULL AS INTEGER)" for n in NUTRIENTS)} AS known FROM p
), w AS (
  SELECT *, concat_ws('|', CASE WHEN kind IS NULL THEN '{NO_BASIS}' END, CASE WHEN known < 3 THEN '{FEW}' END,
         CASE WHEN NOT has_unit AND regexp_matches(t, '(?i){MENTIONS}') THEN '{NO_UNIT}' END) AS warnings FROM b
)"""

_FIXED = "format('{{:.2f}}', {0} + CASE WHEN ({0} * 8) % 2 = 1 THEN 0.001 ELSE 0 END)"


def _path(rows: str) -> str:
    return _with(
        f""", p AS (SELECT owner_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY owner_id) AS n, v, min(v) OVER (PARTITION BY owner_id) AS lo, max(v) OVER (PARTITION BY owner_id) AS hi
  FROM ({rows}) WINDOW w AS (PARTITION BY owner_id ORDER BY date, id)
), q AS (SELECT owner_id, i, n, i / (n - 1) * 100 AS x, 100.0::DOUBLE - (v - lo) / CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE hi - lo END * 86 - 7 AS y FROM p)
SELECT owner_id, CASE WHEN count(*) > 1 THEN string_agg(CASE WHEN i = 0 THEN 'M' ELSE 'L' END || {_FIXED.format('x')} || ' ' || {_FIXED.format('y')}, ' ' ORDER BY i) ELSE '' END AS path FROM q GROUP BY owner_id""",
        "weight",
    )


def backup_cases() -> list[str]:
    """Documents, good and bad: each check fails for some, and values of other types stand where a type counts."""
    good = {"version": 1, "settings": {"id": "settings"}, "foods": [], "diaryEntries": [], "weightEntries": []}
    food = {"id": "1", "name": "x", "nutritionBasis": {"type": "mass"}, "nutrition": {}}
    whole = [good, [], None, 3, "text", False, {}, {k: v for k, v in good.items() if k != "diaryEntries"}]
    whole += [{**good, "version": v} for v in (999, "1", True, 1.0, 1.5, None)]
    whole += [{**good, "settings": v} for v in ({"id": "x"}, {}, None, "settings", {"id": 7})]
    whole += [{**good, "foods": v} for v in ({}, None, "[]", [food], [None], [food, "x"])]
    whole += [{**good, "foods": [food, {**food, **v}]} for v in ({"name": ""}, {"nutritionBasis": ""}, {"nutrition": 0}, {"nutrition": False}, {"nutrition": True}, {"id": 0}, {"id": 5}, {"name": None}, {"name": []})]
    whole += [{**good, "foods": [{k: v for k, v in food.items() if k != "nutrition"}]}, {**good, "diaryEntries": [1], "weightEntries": [None]}]
    return [*map(json.dumps, whole), "not json", ""]


def _truthy(value: str) -> str:
    return f"coalesce(CASE json_type({value}) WHEN 'NULL' THEN false WHEN 'VARCHAR' THEN {value}->>'$' <> '' WHEN 'BOOLEAN' THEN {value}->>'$' = 'true' WHEN 'OBJECT' THEN true WHEN 'ARRAY' THEN true ELSE CAST({value}->>'$' AS DOUBLE) <> 0 END, false)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_VALIDATION = f"""
WITH c AS (SELECT unnest(range({len(backup_cases())})) AS k, unnest([{", ".join(map(_quoted, backup_cases()))}]) AS d
), j AS (SELECT k, CASE WHEN json_valid(d) THEN CAST(d AS JSON) END AS j FROM c
), e AS (
  SELECT k, CASE WHEN j IS NULL OR json_type(j) NOT IN ('OBJECT', 'ARRAY') THEN 'invalid'
    WHEN coalesce(json_type(j, '$.version'), 'NULL') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') OR CAST(j->>'$.version' AS DOUBLE) <> 1 THEN 'unsupported-version'
    WHEN coalesce(json_type(j, '$.settings.id'), 'NULL') <> 'VARCHAR' OR j->>'$.settings.id' <> 'settings' THEN 'no-settings'
    WHEN coalesce(json_type(j, '$.foods'), 'NULL') <> 'ARRAY' OR coalesce(json_type(j, '$.diaryEntries'), 'NULL') <> 'ARRAY' OR coalesce(json_type(j, '$.weightEntries'), 'NULL') <> 'ARRAY' THEN 'incomplete'
    WHEN len(list_filter(json_extract(j, '$.foods[*]'), lambda f: NOT ({" AND ".join(_truthy(f"json_extract(f, '$.{n}')") for n in ("id", "name", "nutritionBasis", "nutrition"))}))) > 0 THEN 'invalid-food' END AS error FROM j
)
SELECT c_custkey AS owner_id, error FROM customer JOIN e ON k = c_custkey % {len(backup_cases())}"""

SQL: dict[str, str] = {
    "portion_resolution": _with(
        f"""SELECT id, foodId, unitId, {_r('CASE WHEN alive THEN grams END', 'grams')}, {_r('CASE WHEN alive THEN ml END', 'ml')},
       CASE WHEN alive THEN label END AS label, {", ".join(_r(f'CASE WHEN alive THEN {n} END', n) for n in NUTRIENTS)},
       CASE WHEN NOT coalesce(alive, false) THEN 'food-not-found' WHEN unitId = 'cup' THEN 'unit-not-found' WHEN factor IS NULL THEN 'dimension-mismatch' END AS error FROM scaled""", "scaled"),
    "diary_snapshot": _with(f"SELECT owner_id, id, date, meal, foodId, foodName, {_r('amount')}, unitId, label AS unitLabel, {_r('grams')}, {_r('ml')}, {_known()} FROM scaled WHERE factor IS NOT NULL", "scaled"),
    "quick_calories": _with(f"SELECT owner_id, id, date, meal, 'Quick calories' AS foodName, 'kcal' AS unitId, 'kcal' AS unitLabel, {_r('amount', 'kcal')}, CAST(NULL AS DOUBLE) AS carbsG FROM intake WHERE foodId IS NULL", "intake"),
    "available_units": _with(
        """SELECT id AS food_id, 0 AS position, CASE WHEN volume THEN 'ml' ELSE 'g' END AS unit_id, CASE WHEN volume THEN 'ml' ELSE 'g' END AS label FROM food
UNION ALL SELECT id, 1, 'unit', 'unidades' FROM food""", "food"),
    "units_per_piece": _with(f"SELECT id, {_r('CASE WHEN NOT in_ml THEN size / 4.75 END', 'grams')}, {_r('CASE WHEN in_ml THEN size / 4.75 END', 'ml')}, floor((CASE WHEN in_ml THEN 0 ELSE size / 4.75 END + 2.220446049250313E-16) * 100 + 0.5) / 100 AS preview, 'unidade' AS one, 'unidades' AS many FROM food", "food"),
    "weekly_budget_summary": _with(
        f""", d AS (SELECT owner_id, date, sum(kcal) AS kcal FROM diary GROUP BY ALL
), c AS (
  SELECT w.owner_id, starts, s, CASE WHEN weekly THEN weekly_target ELSE daily * 7 END AS target, coalesce(sum(kcal), 0.0) AS consumed
  FROM weeks w LEFT JOIN d ON d.owner_id = w.owner_id AND d.date BETWEEN s AND s + 6 GROUP BY ALL
)
SELECT owner_id, s AS week_start, s + 6 AS week_end, {_r('target')}, {_r('consumed')}, {_r('target - consumed', 'remaining')}, CAST(greatest(1, s + 6 - {_DAY} + 1) AS INTEGER) AS remaining_days,
       {_r(f'(target - consumed) / greatest(1, s + 6 - {_DAY} + 1)', 'average_available_per_remaining_day')} FROM c""", "diary", "weeks"),
    "daily_nutrition": _with(f"SELECT owner_id, date, {_known(function='sum')} FROM diary GROUP BY owner_id, date", "diary"),
    "week_nutrition": _with(f"SELECT d.owner_id, {_known('d.', 'sum')} FROM diary d JOIN weeks w ON d.owner_id = w.owner_id AND date BETWEEN s AND s + 6 GROUP BY d.owner_id", "diary", "weeks"),
    "day_progress": _with(
        f""", e AS (SELECT s.owner_id, daily AS target, coalesce(sum(kcal), 0.0) AS kcal FROM settings s LEFT JOIN diary d ON d.owner_id = s.owner_id AND date = {_DAY} GROUP BY ALL)
SELECT owner_id, {_r('kcal')}, {_r('target')}, {_r('kcal / target * 100', 'percent')}, {_r('least(100, greatest(0, kcal / target * 100))', 'bar')} FROM e""", "diary", "settings"),
    "meal_totals": _with(
        f""", m AS (SELECT owner_id, unnest([0, 1, 2, 3]) AS position, unnest(['view', 'click', 'purchase', 'Lanches']) AS meal FROM settings
), e AS (SELECT m.owner_id, position, m.meal, coalesce(sum(kcal), 0.0) AS kcal FROM m LEFT JOIN diary d ON d.owner_id = m.owner_id AND d.meal = m.meal AND date = {_DAY} GROUP BY ALL)
SELECT owner_id, position, meal, {_r('kcal')} FROM e""", "diary", "settings"),
    "last_seven_days": _with(
        f""", s AS (SELECT c_custkey AS owner_id, {_DAY} - CAST(unnest([0, 1, 2, 3, 4, 5, 6]) AS INTEGER) AS date FROM customer
), e AS (SELECT s.owner_id, s.date, {", ".join(f"sum({n}) AS {n}" for n in NUTRIENTS)} FROM s LEFT JOIN diary d ON d.owner_id = s.owner_id AND d.date = s.date GROUP BY ALL)
SELECT owner_id, date, {_known()} FROM e""", "diary"),
    "macro_progress": _with(
        f""", d AS (SELECT owner_id, sum(proteinG) AS proteinG, sum(carbsG) AS carbsG, sum(fatG) AS fatG, sum(fiberG) AS fiberG, sum(sugarsG) AS sugarsG, sum(sodiumMg) AS sodiumMg FROM diary WHERE date = {_DAY} GROUP BY owner_id
), j AS (SELECT s.owner_id, t_proteinG, t_carbsG, t_fatG, d.* EXCLUDE (owner_id) FROM settings s LEFT JOIN d ON d.owner_id = s.owner_id
), m AS ({_CARD})
SELECT owner_id, position, nutrient, {_r('value')}, {_r('target')}, {_r('value / target * 100', 'percent')} FROM m""", "diary", "settings"),
    "diary_scan": _with(f"SELECT owner_id, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY date DESC, id DESC) AS INTEGER) AS position, id, meal, foodName FROM diary WHERE date = {_DAY}", "diary"),
    "weight_moving_average": _with(f"SELECT owner_id, id, date, {_r('kg')}, {_r('avg(kg) OVER (PARTITION BY owner_id ORDER BY date, id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)', 'trendKg')} FROM weight", "weight"),
    "weight_latest": _with(f"SELECT owner_id, arg_max(id, (date, id)) AS id, max(date) AS date, {_r('arg_max(kg, (date, id))', 'kg')} FROM weight GROUP BY owner_id", "weight"),
    "weight_change_7d": _PRIOR(7),
    "weight_change_30d": _PRIOR(30),
    "goal_remaining": _with(
        f""", l AS (SELECT owner_id, arg_max(kg, (date, id)) AS kg FROM weight GROUP BY owner_id)
SELECT l.owner_id, {_r('l.kg', 'kg')}, {_r('goal')}, {_r('l.kg - goal', 'remaining')} FROM l JOIN settings s ON s.owner_id = l.owner_id WHERE goal <> 0""", "weight", "settings"),
    "weight_chart_points": _with(
        f""", p AS (SELECT owner_id, row_number() OVER (PARTITION BY owner_id ORDER BY date, id) - 1 AS i, count(*) OVER (PARTITION BY owner_id) AS n,
       kg, min(kg) OVER (PARTITION BY owner_id) AS lo, max(kg) OVER (PARTITION BY owner_id) AS hi FROM weight)
SELECT owner_id, CAST(i AS INTEGER) AS index, {_r('i / (n - 1) * 100', 'x')}, {_r('100.0 - (kg - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END * 86 - 7', 'y')} FROM p WHERE n > 1""", "weight"),
    "weight_chart_path": _path("SELECT owner_id, date, id, kg AS v FROM weight"),
    "weight_trend_path": _path("SELECT owner_id, date, id, avg(kg) OVER (PARTITION BY owner_id ORDER BY date, id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS v FROM weight"),
    "weight_current_trend": _with(f"""SELECT owner_id, {_r('arg_max(t, (date, id))', 'trendKg')} FROM (SELECT owner_id, date, id, avg(kg) OVER (PARTITION BY owner_id ORDER BY date, id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS t FROM weight) GROUP BY owner_id""", "weight"),
    "weight_history": _with(f"SELECT owner_id, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY date, id) AS INTEGER) AS position, id, date, {_r('kg')} FROM weight", "weight"),
    "diary_history": _with("SELECT owner_id, CAST(row_number() OVER (PARTITION BY owner_id ORDER BY date, id) AS INTEGER) AS position, id, date, foodName FROM diary", "diary"),
    "week_progress": _with(
        f""", c AS (
  SELECT w.owner_id, coalesce(sum(kcal), 0.0) / (CASE WHEN weekly THEN weekly_target ELSE daily * 7 END) * 100 AS p
  FROM weeks w LEFT JOIN diary d ON d.owner_id = w.owner_id AND d.date BETWEEN s AND s + 6 GROUP BY w.owner_id, weekly, weekly_target, daily
) SELECT owner_id, {_r('p', 'percent')}, {_r('least(100, greatest(0, p))', 'bar')} FROM c""", "diary", "weeks"),
    "food_by_id": _with("SELECT id, name FROM food WHERE id IN (SELECT foodId FROM diary)", "diary", "food"),
    "settings_by_key": _with(f"SELECT owner_id, {_r('daily')} FROM settings WHERE owner_id IN (SELECT owner_id FROM diary)", "diary", "settings"),
    "log_guards": f"SELECT event_id, {_r('event_id + 0.5::DOUBLE', 'amount')} FROM events WHERE event_id % 3 = 0",
    "product_paths": "SELECT b AS barcode, '/api/v2/product/' || b || '%20%C3%A9%2F%2B.json' AS path FROM (SELECT '789' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS b FROM part)",
    "product_failures": "SELECT '789' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS barcode, CASE WHEN p_partkey % 10 > 1 THEN 'product-service-unavailable' END AS error FROM part",
    "save_settings": _with(f"SELECT owner_id, {_r('CASE WHEN owner_id % 3 = 0 THEN 2.0 ELSE daily END', 'daily')}, CASE WHEN owner_id % 3 = 0 THEN {_DAY} ELSE DATE '2024-01-01' END AS updated FROM settings", "settings"),
    "store_append": _with(f"SELECT owner_id, id, date, meal, foodName, {_known()} FROM diary", "diary"),
    "backup_entries": _with(f"SELECT d.owner_id, id, date, meal, foodId, foodName, {_r('amount')}, unitId, unitLabel, {_r('grams')}, {_r('ml')}, {_known()}, CAST(created AS DATE) AS created FROM diary d JOIN settings s ON s.owner_id = d.owner_id", "diary", "settings"),
    "recent_foods": _with(f", r AS ({_RECENT}){_RANKED}", "diary", "food"),
    "frequent_foods": _with(f", r AS ({_FREQUENT}){_RANKED}", "diary", "food"),
    "food_suggestions": _with(
        f""", r AS ({_RECENT}), a AS ({_RANKED}), q AS ({_FREQUENT}), b AS ({_RANKED.replace('r.', 'q.').replace('FROM r ', 'FROM q ')})
SELECT owner_id, 0 AS section, rank, foodId, name FROM a UNION ALL SELECT owner_id, 1, rank, foodId, name FROM b WHERE (owner_id, foodId) NOT IN (SELECT (owner_id, foodId) FROM a)""", "diary", "food"),
    "log_search": _with(
        f""", r AS ({_RECENT}), a AS ({_RANKED}), q AS ({_FREQUENT}), b AS ({_RANKED.replace('r.', 'q.').replace('FROM r ', 'FROM q ')})
SELECT owner_id, 0 AS section, rank, foodId, name FROM a UNION ALL SELECT owner_id, 1, rank, foodId, name FROM b WHERE (owner_id, foodId) NOT IN (SELECT (owner_id, foodId) FROM a)
UNION ALL SELECT NULL, NULL, NULL, id, name FROM food WHERE contains(lower(name), 'ring') OR contains(lower(brand), 'ring')""", "diary", "food"),
    "food_search": _with("SELECT id, name FROM food WHERE contains(lower(name), 'ring') OR contains(lower(brand), 'ring') UNION ALL SELECT id, name FROM food WHERE contains(barcode, '7890000000012')", "food"),
    "food_scan": _with("SELECT id, name FROM food", "food"),
    "barcode_lookup": _with(f", c AS ({_CODES}) SELECT c.barcode, id, name FROM c JOIN food ON food.barcode = c.barcode", "food"),
    "barcode_resolution": _with(
        f""", c AS ({_CODES}), p AS ({_PRODUCT})
SELECT c.barcode, coalesce(f.name, p.name) AS name, CASE WHEN f.id IS NOT NULL THEN 'local' ELSE 'open-food-facts' END AS origin
FROM c LEFT JOIN food f ON f.barcode = c.barcode JOIN p ON p.barcode = c.barcode""", "food"),
    "bmr_tdee": _with(
        f""", a AS (SELECT *, coalesce(age, {_AGE}) AS years FROM settings
), b AS (SELECT *, manual IS NULL AND cm IS NOT NULL AND sex IS NOT NULL AND years <> 0 AS complete, kg * 10 + cm * 6.25 - years * 5 + CASE WHEN sex = 'male' THEN 5.0 ELSE -161.0 END AS rate FROM a)
SELECT owner_id, {_r('CASE WHEN complete THEN rate END', 'bmr')}, {_r(f'CASE WHEN manual IS NOT NULL THEN manual WHEN complete THEN rate * CASE level {_MULTIPLIER} END END', 'tdee')},
       CASE WHEN manual IS NOT NULL THEN 'manual' WHEN complete THEN 'mifflin-st-jeor' ELSE 'missing-inputs' END AS reason FROM b""", "settings"),
    "parse_decimal": f"""
WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '1.' ELSE '' END || p_size || CASE p_partkey % 3 WHEN 0 THEN ',5' WHEN 1 THEN 'x' ELSE 'e1' END AS t FROM part)
SELECT p_partkey, {_r(_decimal('t'), 'parsed')}, {_r(_decimal('t'), 'product')} FROM t""",
    "display_rounding": "SELECT p_partkey, floor(((p_partkey - 100) / 8 + 2.220446049250313E-16) * 10 + 0.5) / 10 AS one, floor(((p_partkey - 100) / 8 + 2.220446049250313E-16) * 100 + 0.5) / 100 AS two FROM part",
    "format_number": """
SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '—' ELSE translate(format('{:,.2f}', round(p_retailprice * 10, 2)), ',.', '.,') END AS pt,
       CASE WHEN p_partkey % 10 = 0 THEN '—' ELSE format('{:,.0f}', round(p_retailprice * 10, 0)) END AS en FROM part""",
    "calendar_weeks": """
WITH d AS (SELECT event_id, CAST(ts AS DATE) AS d, user_id % 7 AS s FROM events), w AS (SELECT event_id, d, d - CAST((dayofweek(d) - s + 7) % 7 AS INTEGER) AS w FROM d)
SELECT event_id, w AS week_start, w + 6 AS week_end, CAST(greatest(1, w + 6 - d + 1) AS INTEGER) AS days_left, d BETWEEN w AND w + 2 AS early FROM w""",
    "ages": _with(f"SELECT owner_id, CAST({_AGE} AS INTEGER) AS age FROM settings", "settings"),
    "label_text_parse": _with(
        f"""{_LABEL}
SELECT k AS label_id, CASE kind WHEN 'g' THEN 'mass' WHEN 'ml' THEN 'volume' END AS basis, {_r("CASE WHEN kind = 'g' THEN bsize END", 'basis_g')}, {_r("CASE WHEN kind = 'ml' THEN bsize END", 'basis_ml')},
       {", ".join(_r(n) for n in NUTRIENTS)}, CASE WHEN has_unit THEN CASE WHEN lower(raw) LIKE '%es' THEN left(raw, length(raw) - 2) WHEN lower(raw) LIKE '%s' THEN left(raw, length(raw) - 1) ELSE raw END END AS singular,
       CASE WHEN has_unit THEN raw END AS plural, {_r('CASE WHEN has_unit THEN quantity END', 'quantity')}, {_r("CASE WHEN has_unit AND unit = 'g' THEN amount END", 'unit_g')}, {_r("CASE WHEN has_unit AND unit = 'ml' THEN amount END", 'unit_ml')},
       warnings, CASE WHEN warnings = '' THEN 'high' WHEN known >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM w""", "label"),
    "label_food_drafts": _with(
        f"""{_LABEL}
SELECT 'label-ocr' AS source, 'Produto ' || k AS name, CASE kind WHEN 'g' THEN 'mass' WHEN 'ml' THEN 'volume' END AS basis, {_r("CASE WHEN kind = 'g' THEN bsize END", 'basis_g')}, {_r("CASE WHEN kind = 'ml' THEN bsize END", 'basis_ml')},
       {", ".join(_r(n) for n in NUTRIENTS)}, CAST(has_unit AS INTEGER) AS units, CASE WHEN warnings = '' THEN 'high' WHEN known >= 3 THEN 'medium' ELSE 'low' END AS confidence, label.text AS "rawText" FROM w JOIN label USING (k)""", "label"),
    "product_json_normalize": f"WITH p AS ({_PRODUCT}) SELECT name, brand, barcode, 100.0::DOUBLE AS basis_g, {_known()}, 'open-food-facts' AS source FROM p",
    "product_responses": f"WITH p AS ({_PRODUCT}) SELECT barcode, name, {_r('kcal')} FROM p WHERE k % 10 NOT IN (3, 5)",
    "upsert_foods": _with(
        f"""SELECT id, CASE WHEN k % 14 = 0 THEN 'b ' || name WHEN k % 7 = 0 THEN 'a ' || name ELSE name END AS name, DATE '2023-12-01' AS created, CASE WHEN k % 7 = 0 THEN {_DAY} ELSE DATE '2023-12-01' END AS updated FROM food
UNION ALL SELECT 'new' || id, name, {_DAY}, {_DAY} FROM food WHERE k % 700 = 0""", "food"),
    "delete_foods": _with("SELECT id, name FROM food WHERE NOT starts_with(name, 'red')", "food"),
    "barcode_conflicts": _with("SELECT barcode, CAST(2 AS BIGINT) AS n FROM food WHERE k % 50 = 0", "food"),
    "weight_sync_profile": _with(
        f""", f AS (SELECT owner_id, arg_max(kg, id) + 1 AS fresh FROM weight WHERE CAST(id AS BIGINT) % 3 = 0 AND date = {_DAY} GROUP BY owner_id)
SELECT s.owner_id, {_r('coalesce(fresh, kg)', 'kg')}, CASE WHEN fresh IS NULL THEN DATE '2024-01-01' ELSE {_DAY} END AS updated FROM settings s LEFT JOIN f ON f.owner_id = s.owner_id""", "weight", "settings"),
    "upsert_weights": _with(f"SELECT owner_id, id, date, {_r('CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN kg + 1 ELSE kg END', 'kg')} FROM weight", "weight"),
    "settings_derived": _with(
        f"""SELECT owner_id, {_r('owner_id + 0.5::DOUBLE', 'daily')}, {_r('CASE WHEN NOT weekly THEN (owner_id + 0.5::DOUBLE) * 7 WHEN owner_id % 2 = 0 THEN 0 ELSE 9000 END', 'weekly')},
       {_r('owner_id + 0.5::DOUBLE', 'macro_kcal')}, 'A|B' AS meals FROM settings""", "settings"),
    "settings_defaults": _with(
        f"""SELECT owner_id, CAST(CASE WHEN owner_id % 2 = 0 THEN starts ELSE 1 END AS INTEGER) AS "weekStartsOn", {_r('CASE WHEN owner_id % 2 = 0 THEN daily ELSE 2000 END', 'daily')},
       4 AS meals, 4 AS reminders, CASE WHEN owner_id % 2 = 0 THEN level ELSE 'moderate' END AS level FROM settings""", "settings"),
    "food_forms": f"""
WITH t AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name END AS name, p_partkey % 4 = 3 AS v, CASE WHEN p_partkey % 13 <> 0 THEN 100.0::DOUBLE END AS amount, p_size + 0.25::DOUBLE AS kcal FROM part)
SELECT CAST(CASE WHEN k % 7 = 0 THEN 64 ELSE 1 END AS INTEGER) AS unit_id, CASE WHEN k % 2 = 0 THEN 'label-ocr' ELSE 'manual' END AS source, CASE WHEN k % 2 = 0 THEN '{{}}' END AS "sourceMetadata",
       CASE WHEN k % 2 = 0 THEN {_DAY} ELSE DATE '2023-12-01' END AS created, {_DAY} AS updated, CAST(k AS VARCHAR) AS id, name, CAST(NULL AS VARCHAR) AS brand, {_r('CASE WHEN NOT v THEN amount END', 'basis_g')}, {_r('CASE WHEN v THEN amount END', 'basis_ml')}, {_r('kcal')}, CAST(NULL AS DOUBLE) AS "fatG",
       CASE WHEN k % 3 = 0 THEN 'fatia' ELSE 'unidade' END AS singular, CASE WHEN k % 3 = 0 THEN 'fatias' ELSE 's' END AS plural, {_r('CASE WHEN NOT v THEN 30.0 END', 'unit_g')}, {_r('CASE WHEN v THEN 20.0 END', 'unit_ml')},
       CASE WHEN amount IS NULL THEN 'basis-required' WHEN k % 5 = 0 THEN 'unit-incomplete' WHEN name = '' THEN 'name-required' END AS error FROM t""",
    "food_prefill": _with(
        f""", p AS ({_PRODUCT})
SELECT CAST(p.k AS VARCHAR) AS id, CASE WHEN f.id IS NOT NULL AND f.k % 2 = 0 THEN f.name ELSE p.name END AS name, p.barcode,
       {_r('CASE WHEN f.id IS NULL OR NOT f.volume THEN 100.0 END', 'basis_g')}, {", ".join(_r(f'CASE WHEN f.id IS NULL THEN p.{n} ELSE f.{n} END', n) for n in NUTRIENTS)},
       CASE WHEN f.id IS NULL THEN 'open-food-facts' ELSE 'manual' END AS source, 'Open Food Facts' AS provider FROM p LEFT JOIN food f ON f.k = p.k""", "food"),
    "backup_roundtrip": _with(
        f""", d AS (SELECT owner_id, count(*) AS entries, sum(kcal) AS kcal FROM diary GROUP BY owner_id
), w AS (SELECT owner_id, count(*) AS weights, sum(kg) AS kg FROM weight GROUP BY owner_id
), f AS (SELECT owner_id, count(DISTINCT foodId) AS foods FROM diary JOIN food ON food.id = foodId GROUP BY owner_id)
SELECT s.owner_id, {_r('daily')}, coalesce(entries, 0) AS entries, {_r('kcal')}, coalesce(weights, 0) AS weights, {_r('w.kg', 'kg')}, coalesce(foods, 0) AS foods
FROM settings s LEFT JOIN d ON d.owner_id = s.owner_id LEFT JOIN w ON w.owner_id = s.owner_id LEFT JOIN f ON f.owner_id = s.owner_id""", "diary", "weight", "food", "settings"),
    "backup_validation": _VALIDATION,
    "streaming_daily_totals": f"SELECT user_id AS owner_id, CAST(ts AS DATE) AS date, {_r('sum(value)', 'kcal')} FROM events WHERE event_type <> 'signup' AND event_id % 11 = 0 GROUP BY ALL",
}

_K = "CAST(id AS BIGINT)"
_exact = lambda expression, name: f'floor(({expression} + 2.220446049250313E-16) * 1e8 + 0.5) / 1e8 AS "{name}"'
_FOUND = " UNION ALL ".join(
    f"SELECT '{needle}' AS needle, id FROM food WHERE contains(lower(name), '{low}') OR contains(lower(brand), '{low}') OR contains(barcode, '{low}')"
    for needle, low in ((" Ring ", "ring"), ("7890000000012", "7890000000012"), ("e", "e"), ("ED", "ed"), ("#1", "#1"), ("zzz", "zzz"), ("%", "%"), ("_", "_"))
)
_LOST = " UNION ALL ".join(
    f"SELECT c_custkey AS owner_id, '{table}' AS \"table\", CAST({position} AS INTEGER) AS position, '{id_}' AS id, '{field}' AS field, '{value}' AS value FROM customer WHERE c_custkey % {n} = 0"
    for n, table, position, id_, field, value in (
        (11, "settings", 0, "settings", "dailyCalorieTarget", "true"), (13, "foods", 0, "f", "servingUnits[1].grams", '"3"'), (5, "diaryEntries", 1, "b", "date", '"someday"'),
        (2, "diaryEntries", 1, "b", "grams", '"abc"'), (3, "diaryEntries", 1, "b", "nutritionSnapshot.kcal", '"7"'), (7, "weightEntries", 0, "w", "kg", "{}"),
    )
)
SQL |= {
    "store_unique_barcodes": _with("SELECT id, barcode, CAST(4 AS INTEGER) AS refused FROM food", "food"),
    "store_upsert": SQL["upsert_foods"],
    "store_delete": SQL["delete_foods"],
    "store_lookup": _with("SELECT 'id' AS by, id, name FROM food WHERE k BETWEEN 5 AND 139 AND k % 14 = 5 UNION ALL SELECT 'barcode', id, name FROM food WHERE k BETWEEN 12 AND 129 AND k % 13 = 12", "food"),
    "store_daily_sums": _with(
        f"SELECT owner_id, date, count(*) AS entries, {_exact(f'sum(kcal * CASE WHEN {_K} % 5 = 0 THEN 2 ELSE 1 END)', 'kcal')}, {', '.join(_exact(f'sum({n})', n) for n in NUTRIENTS if n != 'kcal')} FROM diary WHERE {_K} % 7 <> 0 GROUP BY owner_id, date", "diary"),
    "store_weekly_summary": _with(
        f""", c AS (
  SELECT w.owner_id, s, CASE WHEN weekly THEN weekly_target ELSE daily * 7 END AS target, coalesce(sum(kcal), 0.0) AS consumed
  FROM weeks w LEFT JOIN diary d ON d.owner_id = w.owner_id AND d.date BETWEEN s AND s + 6 GROUP BY ALL
) SELECT owner_id, s AS week_start, s + 6 AS week_end, {_exact('target', 'target')}, {_exact('consumed', 'consumed')}, {_exact('target - consumed', 'remaining')}, CAST(greatest(1, s + 6 - {_DAY} + 1) AS INTEGER) AS remaining_days FROM c""", "diary", "weeks"),
    "store_guards": _with("SELECT id, name, CAST(2 AS INTEGER) AS refused FROM food WHERE k % 10 NOT IN (3, 4) AND k % 20 <> 6", "food"),
    "guard_reasons": _with(
        """SELECT * FROM (SELECT 'id: missing' AS reason, count(*) AS n FROM food WHERE k % 10 = 4 UNION ALL SELECT 'nutrition: not finite', count(*) FROM food WHERE k % 10 = 3
UNION ALL SELECT 'servingUnits: not finite', count(*) FROM food WHERE k % 20 = 6) WHERE n > 0""", "food"),
    "store_stream": _with(f"SELECT owner_id, id, date, meal, 'Quick calories' AS foodName, {_r('amount', 'kcal')} FROM intake WHERE foodId IS NULL", "intake"),
    "store_erase": f"SELECT c_custkey AS owner_id, {_r('2000.0::DOUBLE', 'daily')}, {_DAY} AS updated, CAST(0 AS INTEGER) AS left FROM customer",
    "food_search_indexed": _with(_FOUND, "food"),
    "food_search_many": _with(
        """, n AS (SELECT upper(p_brand) AS needle FROM part UNION SELECT left(p_name, 2) FROM part UNION SELECT left(p_name, 1) FROM part)
SELECT needle, id FROM n JOIN food ON contains(lower(name), lower(trim(needle))) OR contains(lower(brand), lower(trim(needle))) OR contains(barcode, lower(trim(needle)))""", "food"),
    "weight_known_daily": _with(
        f""", d AS (SELECT DISTINCT owner_id, date FROM diary), w AS (SELECT owner_id, date, arg_max(kg, id) AS kg FROM weight GROUP BY owner_id, date)
SELECT d.owner_id, d.date, {_r('kg')} FROM d ASOF LEFT JOIN w ON d.owner_id = w.owner_id AND d.date >= w.date""", "diary", "weight"),
    "hot_food_join": _with("SELECT i.id, i.f AS foodId, name FROM (SELECT id, CASE WHEN e % 2 = 0 THEN '1' ELSE foodId END AS f FROM intake) i LEFT JOIN food_all ON food_all.id = i.f", "intake", "food_all"),
    "portion_resolution_salted": SQL["portion_resolution"],
    "loggable_lines": _with(f"SELECT i.id, i.foodId, {_r('i.e + 0.5::DOUBLE', 'amount')} FROM intake i JOIN food ON food.id = i.foodId WHERE i.e % 3 = 0", "intake", "food"),
    "required_decimals": f"SELECT event_id, {_r('event_id + 0.5::DOUBLE', 'amount')} FROM events",
    "backup_restore": _with("SELECT food.id, name || ' of ' || max(d.owner_id) AS name, barcode FROM diary d JOIN settings s ON s.owner_id = d.owner_id JOIN food ON food.id = d.foodId GROUP BY food.id, name, barcode", "diary", "settings", "food"),
    "backup_rejected_values": _LOST,
    "backup_fragment_entries": SQL["backup_entries"],
    "backup_repeated_ids": _with(f"SELECT d.owner_id, id, {_r('amount + 1', 'amount')} FROM diary d JOIN settings s ON s.owner_id = d.owner_id", "diary", "settings"),
    "backup_names": "SELECT c_custkey AS owner_id, 'backup-2024-01-24.json' AS name FROM customer",
    "backup_files": _with(f"SELECT w.owner_id, id, date, {_r('w.kg', 'kg')} FROM weight w JOIN settings s ON s.owner_id = w.owner_id", "weight", "settings"),
}
