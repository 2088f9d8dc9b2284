"""Correlation study and type comparison (G-4, G-6 ... G-18, F-12)."""

from __future__ import annotations

from pooltide.catalog.base import register, rnd, stored
from pooltide.catalog.features import FEATURE_CTES, features
from pooltide.operators.legs import with_exprs
from pooltide.plans import correlations as K
from pooltide.plans import crosstype as X
from pooltide.plans import metrics as M
from pooltide.sources import adapter as A  # noqa: F401

F_SQL = f"WITH {FEATURE_CTES}"


def feats(spark, sf):
    return stored(spark, sf, "features", features)


def long_sql(columns, keep, name="metric", value="x", source="features"):
    """Unpivot as a lateral VALUES list."""
    rows = ", ".join(f"('{c}', CAST({c} AS DOUBLE))" for c in columns)
    return f"(SELECT {keep + ', ' if keep else ''}{name}, {value} FROM {source} CROSS JOIN LATERAL (VALUES {rows}) v({name}, {value}))"


def pairs_sql(left, right, keep="coupon_id"):
    return f"""pre_long AS MATERIALIZED {long_sql(left, keep, 'lname', 'x')}, post_long AS MATERIALIZED {long_sql(right, 'coupon_id', 'rname', 'y')}"""


# r and the least-squares line from centred sums.
CENTRED = """centred AS MATERIALIZED (
  SELECT {keys}, count(*) AS n, count(DISTINCT x) AS dx, count(DISTINCT y) AS dy, covar_pop(x, y) AS c, var_pop(x) AS vx, var_pop(y) AS vy,
    avg(x) AS mx, avg(y) AS my FROM pre_long JOIN post_long USING (coupon_id) GROUP BY {keys}
), fits AS MATERIALIZED (
  SELECT *, c / sqrt(vx * vy) AS r, c / vx AS slope, my - c / vx * mx AS intercept, sqrt(greatest(vy - c * c / vx, 0)) AS sd
  FROM centred WHERE n >= 10 AND dx >= 3 AND dy >= 3)"""

G6 = f"""{F_SQL}, {pairs_sql(M.PRE, M.POST)}, {CENTRED.format(keys="lname, rname")}, bands AS (
  SELECT lname, rname, count(*) FILTER (abs(y - (slope * x + intercept)) < sd) AS wide,
    count(*) FILTER (abs(y - (slope * x + intercept)) < 0.5 * sd) AS tight
  FROM pre_long JOIN post_long USING (coupon_id) JOIN fits USING (lname, rname) GROUP BY lname, rname)
SELECT lname AS pre, rname AS post, {rnd("r", 4)} AS r, {rnd("r * r", 4)} AS r2, {rnd("slope", 6)} AS slope,
  {rnd("intercept", 4)} AS intercept, n, {rnd("wide / n::DOUBLE * 100", 1)} AS pct_in_1std,
  {rnd("tight / n::DOUBLE * 100", 1)} AS pct_in_half_std, {rnd("sd", 4)} AS std_residuals
FROM fits JOIN bands USING (lname, rname)"""


@register("correlation_table", G6, doubles="r r2 slope intercept pct_in_1std pct_in_half_std std_residuals")
def correlation_table(spark, sf):
    return K.correlation_table(feats(spark, sf))


MATRIX = M.DESCRIPTIVE


@register("correlation_matrix", f"""{F_SQL}, {pairs_sql(MATRIX, MATRIX)}
SELECT lname AS feature_a, rname AS feature_b, count(*) AS n,
  CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) END AS r
FROM pre_long JOIN post_long USING (coupon_id) GROUP BY lname, rname""", doubles="r", digits=4)
def correlation_matrix(spark, sf):
    return K.correlation_matrix(feats(spark, sf), list(MATRIX))


_COMBO_ROWS = ", ".join(
    f"('{a}/{b}', {2 * k}, CASE WHEN {b} <> 0 THEN {a}::DOUBLE / {b} END), ('{a}*{b}', {2 * k + 1}, {a}::DOUBLE * {b})"
    for k, (a, b) in enumerate(K.COMBO_PAIRS))


@register("combo_correlations", f"""{F_SQL}, combos AS (SELECT coupon_id, combo, p, x FROM features CROSS JOIN LATERAL (VALUES {_COMBO_ROWS}) v(combo, p, x) WHERE x IS NOT NULL),
post_long AS MATERIALIZED {long_sql(M.COMBO_TARGETS, "coupon_id", "post", "y")},
fits AS (SELECT combo, p, post, count(*) AS n, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) END AS r,
  count(DISTINCT x) AS dx, count(DISTINCT y) AS dy FROM combos JOIN post_long USING (coupon_id) GROUP BY combo, p, post)
SELECT combo, post, {rnd("r", 4)} AS r, {rnd("r * r", 4)} AS r2, n, CASE WHEN p % 2 = 0 THEN 'ratio' ELSE 'product' END AS kind
FROM fits WHERE n >= 10 AND dx >= 3 AND dy >= 3 AND abs(r) > 0.35
ORDER BY abs({rnd("r", 4)}) DESC, p // 2, list_position({list(M.COMBO_TARGETS)!r}, post), p LIMIT 50""", doubles="r r2")
def combo_correlations(spark, sf):
    return K.combo_correlations(feats(spark, sf))


@register("profile_analysis", f"""{F_SQL}
SELECT profil, count(*) AS n, {", ".join(f"CASE WHEN count(*) >= 2 THEN {rnd(f'avg({c})', d)} END AS {k}" for k, c, d in (
  ("moy_difficulty", "difficulty", 2), ("moy_cote_fav", "moy_cote_fav", 2), ("moy_nb_surprises", "nb_surprises", 2),
  ("moy_montant_parfait", "montant_parfait", 2), ("moy_gagnants_parfait", "gagnants_parfait", 1),
  ("moy_pct_fav_gagne", "pct_fav_gagne", 3), ("moy_accord_cotes_joueurs", "accord_cotes_joueurs", 3)))}
FROM features GROUP BY profil""",
          doubles="moy_difficulty moy_cote_fav moy_nb_surprises moy_montant_parfait moy_gagnants_parfait moy_pct_fav_gagne moy_accord_cotes_joueurs")
def profile_analysis(spark, sf):
    return K.profile_analysis(feats(spark, sf))


@register("threshold_effects", f"""{F_SQL}, pre_long AS MATERIALIZED {long_sql(M.THRESHOLD_PRE, "coupon_id", "pre")},
post_long AS MATERIALIZED {long_sql(M.THRESHOLD_TARGETS, "coupon_id", "target", "y")},
cuts AS (SELECT pre, unnest([0.25e0, 0.33e0, 0.5e0, 0.67e0, 0.75e0]) AS quantile, unnest(quantile_cont(x, [0.25, 0.33, 0.5, 0.67, 0.75])) AS t0
  FROM pre_long GROUP BY pre HAVING count(DISTINCT x) >= 5),
rounded_cuts AS (SELECT pre, quantile, {rnd("t0", 9)} AS t FROM cuts),
split AS (SELECT pre, target, quantile, t, count(*) FILTER (x <= t) AS n_below, count(*) FILTER (x > t) AS n_above,
  avg(y) FILTER (x <= t) AS mb, avg(y) FILTER (x > t) AS ma, stddev_samp(y) AS sd
  FROM pre_long JOIN rounded_cuts USING (pre) JOIN post_long USING (coupon_id) GROUP BY ALL),
effects AS (SELECT *, {rnd("CASE WHEN sd > 0 THEN abs(ma - mb) / sd ELSE 0e0 END", 9)} AS effect FROM split WHERE n_below >= 5 AND n_above >= 5)
SELECT pre, target, {rnd("t", 3)} AS threshold, quantile, {rnd("mb", 3)} AS mean_below, {rnd("ma", 3)} AS mean_above, n_below, n_above,
  {rnd("effect", 3)} AS effect_size, CASE WHEN mb <> 0 THEN {rnd("abs(ma - mb) / abs(mb) * 100", 1)} ELSE 0e0 END AS diff_pct
FROM (SELECT *, row_number() OVER (PARTITION BY pre, target ORDER BY effect DESC, quantile) AS place FROM effects WHERE effect > 0)
WHERE place = 1 AND {rnd("effect", 3)} > 0.4""", doubles="threshold quantile mean_below mean_above effect_size diff_pct")
def threshold_effects(spark, sf):
    return K.threshold_effects(feats(spark, sf))


@register("descriptive_statistics", f"""{F_SQL}
SELECT metric, count(*) AS n, avg(x) AS mean, min(x) AS min, max(x) AS max, coalesce(stddev_samp(x), 0e0) AS std, median(x) AS median
FROM {long_sql(M.DESCRIPTIVE, "")} GROUP BY metric""", doubles="mean min max std median")
def descriptive_statistics(spark, sf):
    return K.describe(feats(spark, sf), list(M.DESCRIPTIVE))


def _stats_sql(columns, source="features"):
    cols = ", ".join(f"{rnd(e, 4)} AS {n}" for e, n in (
        ("avg(x)", "mean"), ("median(x)", "median"), ("coalesce(stddev_samp(x), 0e0)", "std"), ("min(x)", "min"), ("max(x)", "max")))
    return f"SELECT grid_type, metric, count(*) AS n, {cols} FROM {long_sql(columns, 'grid_type', source=source)} GROUP BY grid_type, metric"


@register("type_statistics", f"{F_SQL} {_stats_sql(M.TYPE_METRICS)}", doubles="mean median std min max")
def type_statistics(spark, sf):
    return X.type_statistics(feats(spark, sf), M.TYPE_METRICS)


@register("per_leg_statistics", f"""{F_SQL}, scaled AS (SELECT grid_type, {", ".join(f"{rnd(f'{m} / nb_matchs::DOUBLE', 9)} AS {m}_norm" for m in M.PER_LEG)} FROM features)
{_stats_sql([f"{m}_norm" for m in M.PER_LEG], "scaled")}""", doubles="mean median std min max")
def per_leg_statistics(spark, sf):
    return X.per_leg_statistics(feats(spark, sf))


MEANS = f"""{F_SQL}, means AS (SELECT grid_type, metric, count(*) AS n, avg(x) AS mean, coalesce(stddev_samp(x), 0e0) AS sd,
  CAST(substr(grid_type, 3) AS INTEGER) AS size FROM {{long}} GROUP BY grid_type, metric)"""


@register("type_rankings", f"""{MEANS.format(long=long_sql(M.TYPE_METRICS, "grid_type"))}
SELECT metric, grid_type, {rnd("mean", 4)} AS mean, CAST(row_number() OVER (PARTITION BY metric ORDER BY {rnd("mean", 4)} DESC, size) AS INTEGER) AS place FROM means""",
          doubles="mean", digits=3)
def type_rankings(spark, sf):
    return X.type_rankings(feats(spark, sf))


PREDICT = f"""{MEANS.format(long=long_sql(M.PREDICTABILITY, "grid_type"))}, predictable AS (
  SELECT grid_type, {rnd("avg(mean)", 4)} AS score, any_value(size) AS size FROM means GROUP BY grid_type)"""


@register("type_predictability", f"""{PREDICT}
SELECT grid_type, score, CAST(row_number() OVER (ORDER BY score DESC, size) AS INTEGER) AS place FROM predictable""", doubles="score")
def type_predictability(spark, sf):
    return X.predictability(feats(spark, sf))


VALUE = f"""worth AS (
  SELECT grid_type, p_perfect, mean_perfect, p_near, mean_near, {rnd("p_perfect * mean_perfect + p_near * mean_near - 1", 2)} AS expected FROM (
    SELECT grid_type, avg(has_gagnant_parfait) AS p_perfect, coalesce(avg(montant_parfait) FILTER (montant_parfait > 0), 0e0) AS mean_perfect,
      avg((gagnants_presque > 0)::INT) AS p_near, coalesce(avg(montant_presque) FILTER (montant_presque > 0), 0e0) AS mean_near
    FROM features GROUP BY grid_type))"""


@register("type_value", f"""{F_SQL}, {VALUE}
SELECT *, CAST(row_number() OVER (ORDER BY expected DESC, CAST(substr(grid_type, 3) AS INTEGER)) AS INTEGER) AS place FROM worth""",
          doubles="p_perfect mean_perfect p_near mean_near expected")
def type_value(spark, sf):
    return X.value_by_type(feats(spark, sf))


@register("separating_features", f"""{MEANS.format(long=long_sql(M.TYPE_METRICS, "grid_type"))},
pooled AS (SELECT metric, count(*) AS n, stddev_samp(x) AS sd_all FROM {long_sql(M.TYPE_METRICS, "")} GROUP BY metric HAVING count(*) >= 10),
effects AS (SELECT a.metric, a.grid_type AS type_a, b.grid_type AS type_b, a.mean AS ma, b.mean AS mb, a.size AS sa, b.size AS sb,
  {rnd("abs(a.mean - b.mean) / sd_all", 9)} AS effect
  FROM means a JOIN means b ON a.metric = b.metric AND a.size < b.size JOIN pooled p ON p.metric = a.metric WHERE sd_all > 0)
SELECT metric, {rnd("effect", 3)} AS effect_size, type_a, type_b, {rnd("ma", 4)} AS mean_a, {rnd("mb", 4)} AS mean_b
FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY effect DESC, sa, sb) AS place FROM effects)
WHERE place = 1 AND effect > 0.3
ORDER BY {rnd("effect", 3)} DESC, list_position({list(M.TYPE_METRICS)!r}, metric) LIMIT 30""", doubles="effect_size mean_a mean_b", digits=3)
def separating_features(spark, sf):
    return X.separating_features(feats(spark, sf))


STRONG = f"""{F_SQL}, {pairs_sql(M.PRE, M.POST, "coupon_id, grid_type")}, {CENTRED.format(keys="grid_type, lname, rname")},
types AS (SELECT grid_type, count(*) OVER () AS n_types FROM (SELECT grid_type FROM features GROUP BY grid_type HAVING count(*) >= 15)),
strong AS (SELECT grid_type, lname, rname, {rnd("r", 4)} AS r, n_types FROM fits JOIN types USING (grid_type) WHERE abs({rnd("r", 4)}) > 0.2 AND n_types >= 2)"""


@register("stable_correlations", f"""{STRONG}
SELECT lname AS pre, rname AS post, {rnd("avg(r)", 4)} AS r_mean, count(*) AS n_types FROM strong GROUP BY lname, rname
HAVING count(*) = any_value(n_types) AND count(*) FILTER (r > 0) IN (0, count(*))
ORDER BY abs({rnd("avg(r)", 4)}) DESC, list_position({list(M.PRE)!r}, lname), list_position({list(M.POST)!r}, rname) LIMIT 20""",
          doubles="r_mean")
def stable_correlations(spark, sf):
    return X.stable_correlations(feats(spark, sf))


@register("type_specific_correlations", f"""{STRONG}
SELECT any_value(grid_type) AS grid_type, lname AS pre, rname AS post, any_value(r) AS r FROM strong GROUP BY lname, rname HAVING count(*) = 1""",
          doubles="r")
def type_specific_correlations(spark, sf):
    return X.type_specific_correlations(feats(spark, sf))


@register("type_roi", f"""{F_SQL} SELECT *, hit_rate * (mean_fav - 1) - (1 - hit_rate) AS roi_implied FROM (
  SELECT grid_type, avg(marge_bookmaker_moy) AS margin, avg(moy_cote_fav) AS mean_fav, avg(pct_fav_gagne) AS hit_rate, avg(roi_theorique) AS roi
  FROM features GROUP BY grid_type)""", doubles="margin mean_fav hit_rate roi roi_implied")
def type_roi(spark, sf):
    return X.roi_by_type(feats(spark, sf))


# Payouts of the test tables are thousands of stakes; as shares of 2000 they let similarity and predictability count too.
_SCALED = "montant_parfait / 2000e0 AS montant_parfait, montant_presque / 2000e0 AS montant_presque"
_KNOWN = " + ".join(f"(s_{m} IS NOT NULL)::INT" for m in M.SIMILARITY)


@register("type_recommendations", f"""{F_SQL}, scaled AS MATERIALIZED (SELECT * REPLACE ({_SCALED}) FROM features),
profiles AS MATERIALIZED (SELECT grid_type, {", ".join(
    f"CASE WHEN count({m}) >= 5 AND stddev_samp({m}) > 0 THEN avg({m}) END AS m_{m}, CASE WHEN count({m}) >= 5 AND stddev_samp({m}) > 0 THEN stddev_samp({m}) END AS s_{m}"
    for m in M.SIMILARITY)}, {" + ".join(f"avg({m})" for m in M.PREDICTABILITY)} AS p FROM scaled GROUP BY grid_type), {VALUE.replace("FROM features", "FROM scaled")},
types AS MATERIALIZED (SELECT *, CAST(substr(grid_type, 3) AS INTEGER) AS size, {rnd(f"p / {len(M.PREDICTABILITY)}", 4)} AS predictable FROM profiles JOIN worth USING (grid_type)),
scores AS (SELECT f.coupon_id, t.grid_type, t.size,
  ({" + ".join(f"coalesce(exp(-0.5 * ((f.{m} - m_{m}) / s_{m}) ** 2), 0)" for m in M.SIMILARITY)}) / greatest(1, {_KNOWN}) AS sim, expected, predictable
  FROM scaled f CROSS JOIN types t),
best AS (SELECT coupon_id, list(struct_pack(score := {rnd("0.4 * sim + 0.35 * greatest(0, (expected + 1) / 2) + 0.25 * predictable", 4)}, neg := -size, grid_type := grid_type)) AS all_types
  FROM scores GROUP BY coupon_id),
ranked AS (SELECT coupon_id, list_reverse_sort(all_types) AS r FROM best)
SELECT coupon_id, r[1].grid_type AS recommended, r[1].score AS score,
  CASE WHEN coalesce(r[2].score, 0) > 0 THEN {rnd("least(1.0, (r[1].score - r[2].score) * 5 + 0.3)", 3)} ELSE 0.5e0 END AS confidence FROM ranked""", doubles="score confidence")
def type_recommendations(spark, sf):
    table = feats(spark, sf)
    scaled = with_exprs(table, {c: f"{c} / 2000.0D" for c in ("montant_parfait", "montant_presque")})
    return X.recommend_type(scaled, scaled)
