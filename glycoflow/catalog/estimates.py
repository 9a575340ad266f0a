"""Accuracy, corrections, calibration, foods, volumes and presets over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from glycoflow import values
from glycoflow.catalog.adapter import table
from glycoflow.catalog.kernels import groups_sql
from glycoflow.catalog.logs import _with
from glycoflow.catalog.registry import query, r6
from glycoflow.functions import macros, volume
from glycoflow.functions.text import serving_shape
from glycoflow.operators import accuracy, calibration, foods, presets
from glycoflow.operators.log import items_total

# -- accuracy of estimates: line items are results, parts are the test entries ---------------

RESULTS = """
res AS (SELECT l_partkey AS test_entry_id, l_returnflag AS provider, p_brand AS category,
    l_extendedprice/100 AS pc, l_quantity AS pb, l_quantity/2 AS pp, l_tax*100 AS pf,
    p_retailprice/2 AS ac, p_size AS ab, p_size/3.0 AS ap, CAST(p_size % 9 AS DOUBLE) AS af,
    l_discount*10 AS confidence, l_extendedprice AS ms, l_linenumber
  FROM lineitem JOIN part ON p_partkey = l_partkey)
"""


def _mape(p: str, a: str) -> str:
    return f"(CASE WHEN {a} = 0 THEN CASE WHEN {p} = 0 THEN 0 ELSE 100 END ELSE abs(({p}-{a})/{a})*100 END)::DOUBLE"


_PAIRS = {"calories": ("pc", "ac"), "carbs": ("pb", "ab"), "protein": ("pp", "ap"), "fat": ("pf", "af")}
_MAE = {n: f"abs({p}-{a})" for n, (p, a) in _PAIRS.items()}
_MAPE = {n: _mape(p, a) for n, (p, a) in _PAIRS.items()}


def _overall(parts):
    return " + ".join(f"({parts[n]})*{w}::DOUBLE" for n, w in macros.WEIGHTS.items())


_MAE["overall"], _MAPE["overall"] = _overall(_MAE), _overall(_MAPE)


def results(spark, sf):
    part = table(spark, sf, "part")
    lines = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    size = F.col("p_size")
    return lines.select(
        F.col("l_partkey").alias("test_entry_id"),
        F.col("l_returnflag").alias("provider"),
        (F.col("l_extendedprice") / 100).alias("predicted_calories"),
        F.col("l_quantity").alias("predicted_carbs"),
        (F.col("l_quantity") / 2).alias("predicted_protein"),
        (F.col("l_tax") * 100).alias("predicted_fat"),
        (F.col("p_retailprice") / 2).alias("actual_calories"),
        size.cast("double").alias("actual_carbs"),
        (size / 3.0).alias("actual_protein"),
        (size % 9).cast("double").alias("actual_fat"),
        (F.col("l_discount") * 10).alias("confidence"),
        F.col("l_extendedprice").alias("processing_ms"),
        F.col("p_brand").alias("category"),
        "l_linenumber",
    )


def entries(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"))


@query("a5_accuracy_metrics", _with(RESULTS) + f"""
SELECT CASE WHEN grouping(provider) = 1 THEN 'all' ELSE provider END AS provider, CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS category,
  CAST(count(*) AS BIGINT) AS sample_count, {', '.join(f"{r6(f'avg({e})')} AS mae_{n}" for n, e in _MAE.items())},
  {', '.join(f"{r6(f'avg({e})')} AS mape_{n}" for n, e in _MAPE.items())}, {r6('avg(confidence)')} AS avg_confidence, {r6('avg(ms)')} AS avg_processing_ms
FROM res GROUP BY CUBE (provider, category)""")
def accuracy_metrics(spark, sf):
    rows = accuracy.with_errors(results(spark, sf).drop("category"))
    return accuracy.accuracy_metrics(rows, entries(spark, sf))


@query("j3_results_of_category", _with(RESULTS) + f"""
SELECT provider, CAST(count(*) AS BIGINT) AS n, {r6('avg(confidence)')} AS avg_confidence FROM res WHERE category = 'Brand#7' GROUP BY provider""")
def results_of_category(spark, sf):
    rows = accuracy.of_category(results(spark, sf).drop("category"), entries(spark, sf), "Brand#7")
    return rows.groupBy("provider").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence")
    )


CORR = RESULTS + """,
corr AS (SELECT CASE WHEN l_linenumber > 1 THEN category END AS category, pc - ac AS dc, pb - ab AS db, pp - ap AS dp, pf - af AS df, confidence FROM res),
pat AS (SELECT category, count(*) AS n, avg(confidence) AS conf, sum(greatest(dc,0))/count(*) AS oc, sum(greatest(-dc,0))/count(*) AS uc,
    sum(greatest(db,0))/count(*) AS ob, sum(greatest(-db,0))/count(*) AS ub, sum(greatest(dp,0))/count(*) AS op, sum(greatest(-dp,0))/count(*) AS up,
    sum(greatest(df,0))/count(*) AS of_, sum(greatest(-df,0))/count(*) AS uf FROM corr WHERE category IS NOT NULL GROUP BY category)
"""


def corrections(spark, sf):
    rows = results(spark, sf)
    return rows.select(
        F.when(F.col("l_linenumber") > 1, F.col("category")).alias("category"),
        "confidence",
        *[F.col(f"predicted_{n}") for n in macros.FIELDS],
        *[F.col(f"actual_{n}").alias(f"corrected_{n}") for n in macros.FIELDS],
    )


@query("a6_correction_patterns", _with(CORR) + f"""
SELECT category, {r6('oc')} AS over_calories, {r6('ob')} AS over_carbs, {r6('op')} AS over_protein, {r6('of_')} AS over_fat,
  {r6('uc')} AS under_calories, {r6('ub')} AS under_carbs, {r6('up')} AS under_protein, {r6('uf')} AS under_fat,
  CAST(n AS BIGINT) AS correction_count, {r6('conf')} AS avg_confidence, 0.0::DOUBLE AS over_overall, 0.0::DOUBLE AS under_overall FROM pat""")
def correction_patterns(spark, sf):
    return accuracy.correction_patterns(corrections(spark, sf))


@query("a7_adjustment_suggestions", _with(CORR) + f"""
SELECT category, field, CASE WHEN o > u THEN 'decrease' ELSE 'increase' END AS adjustment, {r6('least(greatest(o, u), 30.0::DOUBLE)')} AS percentage_adjustment,
  {r6('least(n/20, 1.0::DOUBLE)')} AS confidence, CAST(n AS BIGINT) AS sample_size FROM (
    SELECT category, n, 'calories' AS field, oc AS o, uc AS u FROM pat UNION ALL SELECT category, n, 'carbs', ob, ub FROM pat
    UNION ALL SELECT category, n, 'protein', op, up FROM pat UNION ALL SELECT category, n, 'fat', of_, uf FROM pat)
WHERE n >= 5 AND ((o > u AND o > 10) OR (u > o AND u > 10))""")
def adjustment_suggestions(spark, sf):
    return accuracy.adjustment_suggestions(accuracy.correction_patterns(corrections(spark, sf)))


def dataset(spark, sf):
    """Pages and documents as ground-truth rows, some of them incomplete."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("line"),
        F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("img/"), "doc_id")).alias("image_url"),
        F.when(F.col("doc_id") % 11 != 0, F.col("n_chars")).alias("ground_truth"),
        F.col("source"),
        F.col("lang").alias("category"),
    )


@query("s22_dataset_import", """
SELECT doc_id AS line, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 OR coalesce(source, '') = '' THEN 'MISSING_FIELDS' END AS error FROM documents""")
def dataset_import(spark, sf):
    return accuracy.check_entries(dataset(spark, sf)).select("line", "error")


@query("a15_dataset_manifest", """
SELECT '1.0' AS version, CAST(count(*) AS BIGINT) AS count, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources,
  array_to_string(list_sort(list(DISTINCT lang)), '|') AS categories FROM documents""")
def dataset_manifest(spark, sf):
    return accuracy.dataset_manifest(dataset(spark, sf))


@query("s25_validation_scans", _with(RESULTS) + f"""
SELECT test_entry_id, provider, {r6('pb')} AS predicted_carbs, {r6('ms')} AS processing_ms FROM res
WHERE provider = 'A' AND category = 'Brand#3'""")
def validation_scans(spark, sf):
    """Results of one provider and category, newest first."""
    rows = results(spark, sf).filter((F.col("provider") == "A") & (F.col("category") == "Brand#3"))
    ordered = rows.orderBy(F.desc("processing_ms"), "test_entry_id", "predicted_carbs")
    return ordered.select("test_entry_id", "provider", "predicted_carbs", "processing_ms")


ENTRIES_SQL = """
ent AS (SELECT p_partkey AS id, p_brand AS category, CASE p_partkey % 3 WHEN 0 THEN 'usda' WHEN 1 THEN 'manual' END AS source, p_size AS stamp FROM part)
"""
CORRECTED_SQL = RESULTS + """,
cor AS (SELECT test_entry_id AS event_id, provider AS ai_provider, CASE WHEN l_linenumber > 1 THEN category END AS category, ms, l_linenumber FROM res)
"""


def stamped_entries(spark, sf):
    n = F.col("p_partkey") % 3
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"),
        F.when(n == 0, F.lit("usda")).when(n == 1, F.lit("manual")).alias("source"),
        F.col("p_size").alias("stamp"),
    )


def stamped_corrections(spark, sf):
    return results(spark, sf).select(
        F.col("test_entry_id").alias("event_id"), F.col("provider").alias("ai_provider"),
        F.when(F.col("l_linenumber") > 1, F.col("category")).alias("category"),
        F.col("processing_ms").alias("ms"), "l_linenumber",
    )


@query("s25_entries_newest", _with(ENTRIES_SQL) + "SELECT id, source, stamp, row_number() OVER (ORDER BY stamp DESC, id) AS place FROM ent")
def entries_newest(spark, sf):
    """All entries, newest first; the place follows from how many are newer."""
    rows = stamped_entries(spark, sf)
    return accuracy.with_place(rows, "stamp", "id").select("id", "source", "stamp", "place")


@query("s25_entries_of_source", _with(ENTRIES_SQL) + "SELECT id, category, stamp FROM ent WHERE source = 'usda'")
def entries_of_source(spark, sf):
    return accuracy.where_equal(stamped_entries(spark, sf), "stamp", source="usda").select("id", "category", "stamp")


@query("s25_results_of_entry", _with(RESULTS) + f"SELECT test_entry_id, provider, {r6('ms')} AS ms FROM res WHERE test_entry_id = 7")
def results_of_entry(spark, sf):
    rows = results(spark, sf).withColumnRenamed("processing_ms", "ms")
    return accuracy.where_equal(rows, "ms", test_entry_id=7).select("test_entry_id", "provider", "ms")


@query("s25_corrections_of_event", _with(CORRECTED_SQL) + f"SELECT event_id, ai_provider, {r6('ms')} AS ms FROM cor WHERE event_id = 11")
def corrections_of_event(spark, sf):
    return accuracy.where_equal(stamped_corrections(spark, sf), "ms", event_id=11).select("event_id", "ai_provider", "ms")


@query("s25_corrections_of_provider", _with(CORRECTED_SQL) + f"SELECT event_id, {r6('ms')} AS ms, l_linenumber FROM cor WHERE ai_provider = 'R'")
def corrections_of_provider(spark, sf):
    return accuracy.where_equal(stamped_corrections(spark, sf), "ms", ai_provider="R").select("event_id", "ms", "l_linenumber")


@query("s25_corrections_of_category", _with(CORRECTED_SQL) + f"SELECT event_id, {r6('ms')} AS ms, l_linenumber FROM cor WHERE category = 'Brand#5'")
def corrections_of_category(spark, sf):
    return accuracy.where_equal(stamped_corrections(spark, sf), "ms", category="Brand#5").select("event_id", "ms", "l_linenumber")


# -- calibration -------------------------------------------------------------------------------

FOLD = """
cal0 AS (SELECT {key} AS food_type_id, count(*) AS n, max(l_shipdate) AS last_ts,
    list(l_quantity*(0.6::DOUBLE + l_discount*8)/l_quantity ORDER BY l_shipdate, l_orderkey*8 + l_linenumber, l_quantity*(0.6::DOUBLE + l_discount*8)/l_quantity) AS rs
  FROM lineitem WHERE l_quantity - 1 <> 0 GROUP BY 1),
cal AS (SELECT food_type_id, n, epoch_us(last_ts) // 1000 AS last_ms,
    list_reduce(list_concat([floor(rs[1]*1000+0.5)/1000], rs[2:]), lambda acc, x: floor((x*0.3::DOUBLE + acc*0.7::DOUBLE)*1000+0.5)/1000) AS f FROM cal0)
"""
_CAL_OUT = f"""
SELECT food_type_id, {r6('f')} AS correction_factor, CAST(n AS BIGINT) AS sample_count, last_ms AS last_updated FROM cal"""
FOOD_IDS = "[" + ",".join(f"'{row[0]}'" for row in values.FOODS) + "]"


def correction_events(spark, sf, key):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        key.alias("food_type_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.when(q == 1, F.lit(0.0)).otherwise(q).alias("estimated"),
        (q * (F.lit(0.6) + F.col("l_discount") * 8)).alias("corrected"),
    )


def by_part(spark, sf):
    return correction_events(spark, sf, F.col("l_partkey").cast("string"))


def food_of(number):
    ids = F.array(*[F.lit(row[0]) for row in values.FOODS])
    return F.get(ids, F.pmod(number, F.lit(len(values.FOODS))))


def by_food(spark, sf):
    return correction_events(spark, sf, food_of(F.col("l_partkey")))


@query("w4_calibration", _with(FOLD.format(key="CAST(l_partkey AS VARCHAR)")) + _CAL_OUT)
def calibration_by_part(spark, sf):
    return calibration.calibrate(by_part(spark, sf))


@query("w4_calibration_large_foods", _with(FOLD.format(key=f"{FOOD_IDS}[l_partkey % 69 + 1]")) + _CAL_OUT)
def calibration_by_food(spark, sf):
    """Foods with very many corrections, folded in ordered chunks."""
    return calibration.calibrate(by_food(spark, sf), chunk=150)


@query("a16_calibration_stats", _with(FOLD.format(key="CAST(l_partkey AS VARCHAR)")) + """
SELECT CAST(count(*) AS BIGINT) AS total_foods, CAST(sum(n) AS BIGINT) AS total_corrections,
  CAST(floor(avg(abs(f - 1))*100 + 0.5) AS BIGINT) AS average_deviation FROM cal""")
def calibration_stats(spark, sf):
    return calibration.stats(calibration.calibrate(by_part(spark, sf)))


@query("s26_calibration_json", _with(FOLD.format(key="CAST(l_partkey AS VARCHAR)")) + _CAL_OUT)
def calibration_json(spark, sf):
    """Out to JSON lines and back."""
    known = calibration.calibrate(by_part(spark, sf))
    return calibration.import_lines(calibration.export_lines(known))


@query("j8_calibration_join", _with(FOLD.format(key="CAST(l_partkey AS VARCHAR)")) + f"""
SELECT p_partkey, {r6('coalesce(f, 1)')} AS correction_factor, {r6('floor(p_retailprice*coalesce(f, 1)*10+0.5)/10')} AS calibrated
FROM part LEFT JOIN cal ON food_type_id = CAST(p_partkey AS VARCHAR)""")
def calibration_join(spark, sf):
    known = calibration.calibrate(by_part(spark, sf))
    parts = table(spark, sf, "part").select(
        "p_partkey", F.col("p_partkey").cast("string").alias("food_type_id"), "p_retailprice"
    )
    joined = calibration.with_factor(parts, known)
    return joined.select(
        "p_partkey", "correction_factor",
        calibration.apply_factor(F.col("p_retailprice"), F.col("correction_factor")).alias("calibrated"),
    )


# -- foods -----------------------------------------------------------------------------------------

FOODS = "foods(pos, id, name, category, density, kcal, carbs, protein, fat) AS (VALUES " + ",".join(
    f"({pos}, '{r[0]}', '{r[1]}', '{r[2]}', {','.join(f'{x!r}::DOUBLE' for x in r[3:])})"
    for pos, r in enumerate(values.FOODS)
) + ")"


@query("j7_food_lookup", _with(FOODS) + f"""
SELECT category AS food_category, CAST(count(*) AS BIGINT) AS n, {r6('sum(l_quantity*density)')} AS grams, {r6('sum(l_quantity*density*carbs)')} AS carbs
FROM lineitem LEFT JOIN foods ON id = {FOOD_IDS}[l_partkey % 71 + 1] GROUP BY category""")
def food_lookup(spark, sf):
    ids = F.array(*[F.lit(row[0]) for row in values.FOODS])
    lines = table(spark, sf, "lineitem").select(
        F.get(ids, (F.col("l_partkey") % 71).cast("int")).alias("food_id"), "l_quantity"
    )
    weight = volume.grams(F.col("l_quantity"), F.col("density"))
    return foods.with_food(lines, foods.foods(spark)).groupBy("food_category").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(weight).alias("grams"),
        F.sum(weight * F.col("carbs_per_gram")).alias("carbs"),
    )


PHRASES = ["white rice", "ch", "cooked potato", "Sauce", " Egg ", "bread", "cream", "mixed fruits", "pizza", "x", "(cooked)", "o"]
_PHRASE_SQL = "[" + ",".join(f"'{p}'" for p in PHRASES) + "]"


@query("t2_food_search", _with(FOODS, f"""
qs AS (SELECT p_partkey AS query_id, lower(trim({_PHRASE_SQL}[p_partkey % {len(PHRASES)} + 1] || CASE WHEN p_partkey % 5 = 0 THEN ' ' || p_name ELSE '' END)) AS q FROM part),
tx AS (SELECT DISTINCT q FROM qs),
sc AS (SELECT q, id, pos, CASE WHEN lower(name) = q THEN 100 WHEN starts_with(lower(name), q) THEN 50 WHEN contains(lower(name), q) THEN 25 ELSE 0 END
    + list_sum(list_transform(string_split_regex(q, '\\s+'), lambda t: CASE WHEN length(t) < 2 THEN 0 ELSE
        CASE WHEN contains(lower(name), t) THEN 10 + CASE WHEN regexp_matches(lower(name), '\\b\\Q' || t || '\\E') THEN 5 ELSE 0 END ELSE 0 END
        + CASE WHEN contains(lower(category), t) THEN 5 ELSE 0 END END)) AS score FROM tx, foods)""") + """
SELECT query_id, rank, id AS food_id, CAST(score AS BIGINT) AS score FROM qs JOIN (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, pos) AS rank FROM sc WHERE score > 0) r ON r.q = qs.q WHERE rank <= 10""")
def food_search(spark, sf):
    phrases = F.array(*[F.lit(p) for p in PHRASES])
    key = F.col("p_partkey")
    text = F.concat(
        F.get(phrases, (key % len(PHRASES)).cast("int")),
        F.when(key % 5 == 0, F.concat(F.lit(" "), "p_name")).otherwise(F.lit("")),
    )
    return foods.search(table(spark, sf, "part").select(key.alias("query_id"), text.alias("query")))


@query("t3_popular_items", """
SELECT p_partkey AS pos, p_brand AS category FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part)
ORDER BY rn > 1, p_partkey LIMIT 40""")
def popular_items(spark, sf):
    """Parts as the dimension: the first of every brand, then on in table order."""
    dim = table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("category"))
    return foods.popular(dim, 40).select("pos", "category")


@query("f17_serving_shape", f"""
SELECT 'part' || p_partkey AS id, {groups_sql("(p_name || ' ' || p_type)", values.SHAPE_KEYWORDS, 'irregular')} AS shape FROM part
UNION ALL SELECT 'doc' || doc_id, {groups_sql('text', values.SHAPE_KEYWORDS, 'irregular')} FROM documents""")
def serving_shapes(spark, sf):
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("part"), "p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("d")
    )
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("doc"), "doc_id").alias("id"), F.col("text").alias("d")
    )
    return parts.union(docs).select("id", serving_shape(F.col("d")).alias("shape"))


# -- volumes -----------------------------------------------------------------------------------------

_SHAPES = list(values.SHAPES)
_SHAPE_SQL = "[" + ",".join(f"'{s}'" for s in _SHAPES) + "]"
REGIONS = f"""
rg0 AS (SELECT l_orderkey AS meal_id, l_linenumber, l_partkey, [0, l_quantity*10, l_quantity*10, l_quantity*5, 0] AS xs,
    [0, 0, l_discount*1000+10, l_discount*1000+50, l_discount*1000+10] AS ys,
    CASE WHEN l_orderkey % 4 <> 0 THEN 2.0::DOUBLE + l_orderkey % 3 END AS ppm, CASE WHEN l_orderkey % 4 <> 0 THEN 0.5::DOUBLE + (l_orderkey % 5)/10.0::DOUBLE END AS rc,
    {_SHAPE_SQL}[l_orderkey % 6 + 1] AS shape FROM lineitem),
hr AS (SELECT * FROM (VALUES {','.join(f"('{s}', {h}::DOUBLE, {m}::DOUBLE)" for s, (h, m) in values.SHAPES.items())}) v(sname, hratio, vmult)),
rg AS (SELECT *, abs(list_sum(list_transform(range(5), lambda i: xs[i+1]*ys[(i+1)%5+1] - xs[(i+1)%5+1]*ys[i+1]))/2) / (coalesce(ppm, 3.0)*coalesce(ppm, 3.0)) AS area FROM rg0)
"""


def _meal_sql(shape: str, source: str = "rg") -> str:
    return f"""
vol AS (SELECT meal_id, sum(area*(sqrt(area/pi())*hratio)*vmult/1000) AS total, count(*) AS n, max(rc) AS rc, max(ppm) AS ppm FROM {source} JOIN hr ON sname = {shape} GROUP BY meal_id),
vc AS (SELECT *, floor(total+0.5) AS ml, floor((coalesce(rc, 0.5)*0.6::DOUBLE + least(1.0::DOUBLE, 0.7::DOUBLE + n*0.1::DOUBLE)*0.4::DOUBLE)*100+0.5)/100 AS conf FROM vol),
ve AS (SELECT *, CASE WHEN rc IS NULL THEN 0.5::DOUBLE WHEN rc < 0.7::DOUBLE THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END * CASE WHEN conf > 0.8 THEN 0.9 ELSE 1.0 END::DOUBLE AS u FROM vc)
"""


def regions(spark, sf):
    q, d, key = F.col("l_quantity"), F.col("l_discount") * 1000, F.col("l_orderkey")

    def corner(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    zero = F.lit(0.0)
    outline = F.array(
        corner(zero, zero), corner(q * 10, zero), corner(q * 10, d + 10), corner(q * 5, d + 50),
        corner(zero, d + 10),
    )
    seen = key % 4 != 0
    return table(spark, sf, "lineitem").select(
        key.alias("meal_id"),
        F.col("l_linenumber").alias("region_id"),
        "l_partkey",
        outline.alias("boundary"),
        F.when(seen, F.lit(2.0) + key % 3).alias("pixels_per_mm"),
        F.when(seen, F.lit(0.5) + (key % 5) / 10.0).alias("ref_confidence"),
        F.get(F.array(*[F.lit(s) for s in _SHAPES]), (key % 6).cast("int")).alias("shape"),
    )


@query("f16_region_geometry", _with(REGIONS) + f"""
SELECT meal_id, CAST(l_linenumber AS BIGINT) AS region_id, l_partkey, {r6('area')} AS area_mm2, {r6('sqrt(area/pi())*hratio')} AS height_mm, {r6('area*(sqrt(area/pi())*hratio)*vmult/1000')} AS volume_ml,
  {r6('list_sum(xs)/5')} AS centre_x, {r6('list_sum(ys)/5')} AS centre_y,
  {r6('floor(area+0.5)*(sqrt(floor(area+0.5)/pi())*0.4::DOUBLE)*0.67::DOUBLE/1000')} AS dome_ml
FROM rg JOIN hr ON sname = shape""")
def region_geometry(spark, sf):
    sized = foods.region_sizes(regions(spark, sf))
    centre = volume.centroid(F.col("boundary"))
    return sized.select(
        "meal_id", "region_id", "l_partkey", "area_mm2", "height_mm", "volume_ml",
        centre.getField("x").alias("centre_x"), centre.getField("y").alias("centre_y"),
        volume.volume_ml_with_shape(F.col("area_mm2"), F.lit("dome")).alias("dome_ml"),
    )


@query("a20_meal_volumes", _with(REGIONS, _meal_sql("shape")) + f"""
SELECT meal_id, CAST(n AS BIGINT) AS n_regions, {r6('ml')} AS total_volume_ml, {r6('conf')} AS confidence, {r6('floor(u*100+0.5)')} AS uncertainty_pct,
  {r6('floor(ml*(1-u)+0.5)')} AS low_ml, {r6('floor(ml*(1+u)+0.5)')} AS high_ml,
  array_to_string(list_filter([CASE WHEN ppm IS NULL THEN 'NO_REFERENCE' END, CASE WHEN total > 2000 THEN 'VOLUME_LARGE' END, CASE WHEN total < 10 THEN 'VOLUME_SMALL' END], lambda x: x IS NOT NULL), '|') AS warnings FROM ve""")
def meal_volumes(spark, sf):
    return foods.meal_volumes(regions(spark, sf))


_EST = {"calories": ("kcal", 0), "carbs": ("carbs", 1), "protein": ("protein", 1), "fat": ("fat", 1)}


def _amount(per_gram: str, digits: int) -> str:
    k = 10**digits
    return f"floor({per_gram}*g*{k}+0.5)/{k}"


def _moved(amount: str, digits: int) -> str:
    k = 10**digits
    return f"CASE WHEN cf = 1 THEN {amount} ELSE floor(({amount})*cf*{k}+0.5)/{k} END"


@query("f18_macros_from_volume", _with(FOODS) + f"""
SELECT l_orderkey, l_linenumber, {r6('floor(g+0.5)')} AS weight_grams, {', '.join(f"{r6(_amount(c, k))} AS {n}" for n, (c, k) in _EST.items())}
FROM (SELECT *, l_quantity*20*density AS g FROM lineitem JOIN foods ON id = {FOOD_IDS}[l_partkey % 69 + 1])""")
def macros_from_volume(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", food_of(F.col("l_partkey")).alias("food_id"),
        (F.col("l_quantity") * 20).alias("ml"),
    )
    known = foods.macros_of(foods.with_food(lines, foods.foods(spark)), "ml")
    return known.select("l_orderkey", "l_linenumber", "weight_grams", *macros.FIELDS)


@query("m10_meal_estimates", _with(
    FOODS, FOLD.format(key=f"{FOOD_IDS}[l_partkey % 69 + 1]"), REGIONS,
    f"""mf AS (SELECT DISTINCT l_orderkey AS meal_id, {FOOD_IDS}[l_orderkey % 71 + 1] AS fid FROM lineitem),
rs AS (SELECT rg.*, CASE WHEN rg.meal_id % 2 = 0 THEN {groups_sql('name', values.SHAPE_KEYWORDS, 'irregular')} ELSE shape END AS sh FROM rg JOIN mf ON mf.meal_id = rg.meal_id JOIN foods ON id = fid)""",
    _meal_sql("sh", "rs")) + f"""
SELECT meal_id, fid AS food_id, {r6('ml')} AS total_volume_ml, {r6('conf')} AS confidence, {r6(_moved('floor(g+0.5)', 0))} AS weight_grams,
  {', '.join(f"{r6(_moved(_amount(c, k), k))} AS {n}" for n, (c, k) in _EST.items())}
FROM (SELECT ve.*, fid, foods.*, ml*density AS g, coalesce(f, 1) AS cf FROM ve JOIN mf ON mf.meal_id = ve.meal_id JOIN foods ON id = fid LEFT JOIN cal ON food_type_id = fid)""")
def meal_estimates(spark, sf):
    """Orders as meals of one food each; even ones take their shape from the food's name."""
    key = F.col("l_orderkey")
    ids = F.array(*[F.lit(row[0]) for row in values.FOODS])
    meal_foods = table(spark, sf, "lineitem").select(
        key.alias("meal_id"), F.get(ids, (key % 71).cast("int")).alias("food_id")
    ).distinct()
    outlined = regions(spark, sf).withColumn(
        "shape", F.when(F.col("meal_id") % 2 != 0, F.col("shape"))
    )
    known = calibration.calibrate(by_food(spark, sf))
    out = foods.estimate_meals(outlined, meal_foods, foods.foods(spark), known)
    return out.select(
        "meal_id", "food_id", "total_volume_ml", "confidence", "weight_grams", *macros.FIELDS
    )


# -- presets ---------------------------------------------------------------------------------------------

PRESETS = """
ps AS (SELECT p_partkey AS preset_id, p_name AS name, p_retailprice AS updated_at FROM part),
old AS (SELECT min(preset_id) AS preset_id, name FROM ps WHERE preset_id % 2 = 0 GROUP BY name),
new AS (SELECT preset_id, name FROM ps WHERE preset_id % 2 = 1),
pit AS (SELECT l_partkey AS preset_id, l_orderkey*8 + l_linenumber AS pos, l_extendedprice AS calories, l_quantity AS carbs, l_tax*100 AS protein, l_discount*100 AS fat FROM lineitem)
"""


def preset_rows(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("preset_id"), F.col("p_name").alias("name"),
        F.timestamp_millis((F.col("p_retailprice") * 100000).cast("bigint")).alias("updated_at"),
    )


def preset_items(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("preset_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"),
        F.col("l_extendedprice").alias("calories"), F.col("l_quantity").alias("carbs"),
        (F.col("l_tax") * 100).alias("protein"), (F.col("l_discount") * 100).alias("fat"),
    )


def preset_import(spark, sf):
    """Even parts, one per name, are there already; odd parts are imported in key order."""
    rows = preset_rows(spark, sf)
    even = rows.filter(F.col("preset_id") % 2 == 0)
    existing = even.groupBy("name").agg(F.min("preset_id").alias("preset_id"))
    batch = rows.filter(F.col("preset_id") % 2 == 1).withColumn("seq", F.col("preset_id"))
    return existing.select("preset_id", "name"), batch.select("preset_id", "name", "seq")


_PLACED = {
    "skip": "SELECT preset_id, name FROM old UNION ALL SELECT min(preset_id), name FROM new WHERE name NOT IN (SELECT name FROM old) GROUP BY name",
    "replace": "SELECT preset_id, name FROM old WHERE name NOT IN (SELECT name FROM new) UNION ALL SELECT max(preset_id), name FROM new GROUP BY name",
    "merge": "SELECT preset_id, name FROM old UNION ALL SELECT min(preset_id), name FROM new WHERE name NOT IN (SELECT name FROM old) GROUP BY name",
}
_OWNER = {
    "skip": "SELECT preset_id AS item_of, preset_id FROM kept",
    "replace": "SELECT preset_id AS item_of, preset_id FROM kept",
    "merge": "SELECT preset_id AS item_of, preset_id FROM old UNION ALL SELECT new.preset_id, kept.preset_id FROM new JOIN kept ON kept.name = new.name",
}


def _register_preset_import(strategy: str) -> None:
    sql = _with(PRESETS, f"kept AS ({_PLACED[strategy]})", f"owner AS ({_OWNER[strategy]})") + f"""
SELECT k.preset_id, k.name, CAST(count(pos) AS BIGINT) AS n_items, {r6('coalesce(sum(calories),0)')} AS calories, {r6('coalesce(sum(carbs),0)')} AS carbs,
  {r6('coalesce(sum(protein),0)')} AS protein, {r6('coalesce(sum(fat),0)')} AS fat
FROM kept k LEFT JOIN owner o ON o.preset_id = k.preset_id LEFT JOIN pit ON pit.preset_id = o.item_of GROUP BY k.preset_id, k.name"""

    @query(f"j9_preset_import_{strategy}", sql)
    def run(spark, sf):
        existing, batch = preset_import(spark, sf)
        items = preset_items(spark, sf)
        held, moved = presets.import_presets(existing, items, batch, items, strategy)
        summed = presets.totals(moved)
        return held.join(summed, "preset_id", "left").fillna(0)


for _strategy in presets.STRATEGIES:
    _register_preset_import(_strategy)


@query("j9_preset_import_counts", _with(PRESETS) + """
SELECT CAST(count(DISTINCT name) FILTER (name NOT IN (SELECT name FROM old)) AS BIGINT) AS imported,
  CAST(count(*) - count(DISTINCT name) FILTER (name NOT IN (SELECT name FROM old)) AS BIGINT) AS skipped FROM new""")
def preset_import_counts(spark, sf):
    return presets.import_counts(*preset_import(spark, sf), "skip")


@query("s24_preset_scans", """
(SELECT 'recent' AS scan, p_partkey AS preset_id, p_name AS name FROM part ORDER BY CAST(floor(p_retailprice*100000) AS BIGINT) DESC, p_partkey LIMIT 5)
UNION ALL SELECT 'named', p_partkey, p_name FROM part WHERE lower(p_name) = 'red widget'
UNION ALL SELECT 'search', p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')""")
def preset_scans(spark, sf):
    rows = preset_rows(spark, sf)
    found = {
        "recent": presets.by_last_use(rows, 5),
        "named": presets.named(rows, "Red Widget", ignore_case=True),
        "search": presets.search_name(rows, "RING"),
    }
    out = None
    for scan, part in found.items():
        marked = part.select(F.lit(scan).alias("scan"), "preset_id", "name")
        out = marked if out is None else out.unionByName(marked)
    return out


@query("t4_preset_mark_used", """
SELECT p_partkey AS preset_id, CASE WHEN u IS NULL THEN CAST(floor(p_retailprice*100000) AS BIGINT) ELSE epoch_us(u) // 1000 END AS updated_at
FROM part LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS u FROM lineitem WHERE l_quantity > 49 GROUP BY l_partkey) ON l_partkey = p_partkey""")
def preset_mark_used(spark, sf):
    used = table(spark, sf, "lineitem").filter(F.col("l_quantity") > 49).select(
        F.col("l_partkey").alias("preset_id"), F.col("l_shipdate").cast("timestamp").alias("used_at")
    )
    return presets.mark_used(preset_rows(spark, sf), used).select("preset_id", "updated_at")


@query("a13_u3_item_totals", f"""
SELECT p_partkey, {r6('p_retailprice*3')} AS total_calories, {r6('p_size*2')} AS total_carbs, {r6('p_size')} AS total_protein, 0.0::DOUBLE AS total_fat,
  3 AS n_items FROM part""")
def item_totals(spark, sf):
    """Two items joined with one more; missing macros count as 0."""

    def item(calories, carbs, protein):
        return F.struct(
            F.struct(
                calories.cast("double").alias("calories"), carbs.cast("double").alias("carbs"),
                protein.cast("double").alias("protein"), F.lit(None).cast("double").alias("fat"),
            ).alias("macros")
        )

    price, size, none = F.col("p_retailprice"), F.col("p_size"), F.lit(None)
    items = F.concat(
        F.array(item(price, size, none), item(price * 2, none, none)), F.array(item(none, size, size))
    )
    rows = table(spark, sf, "part").select("p_partkey", items.alias("items"))
    return items_total(rows, "items").withColumn("n_items", F.size("items")).drop("items")
