"""Fold, scaler and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.base import BARS, TICKS, query, sql
from barloom.catalog.sessions import RETURNS, returns
from barloom.operators import clean, folds, quality, scaling
from barloom.session import checkpoint_dir, durable

ROWS = f"""{TICKS}, rows0 AS (SELECT row_number() OVER (ORDER BY ts, seq) - 1 AS idx, seq, ts, symbol, CASE WHEN seq % 17 > 0 THEN price END AS x, volume AS y,
  CASE WHEN (seq * 7) % 10 < 4 THEN 1 ELSE 0 END AS target, count(*) OVER () AS total FROM ticks)"""


def rows(t):
    df = folds.indexed(t.ticks())
    return df.select(
        "idx",
        "seq",
        "ts",
        "symbol",
        F.when(F.col("seq") % 17 > 0, F.col("price")).alias("x"),
        F.col("volume").alias("y"),
        F.when((F.col("seq") * 7) % 10 < 4, 1).otherwise(0).alias("target"),
    )


# -- sequences -------------------------------------------------------------------------------------

LAG = "OVER (PARTITION BY symbol ORDER BY ts, seq)"
PAST = "OVER (PARTITION BY symbol ORDER BY ts, seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
SEQ_CELLS = [(f"{c}_{i}", c, 5 - i) for i in range(5) for c in ("price", "volume")]  # oldest row first
SEQ = f"""sq AS (SELECT symbol, seq, {', '.join(f'lag({c}, {back}) {LAG} AS {name}' for name, c, back in SEQ_CELLS)},
  lag(price) {LAG} AS feature_price, lag(volume) {LAG} AS feature_volume, count(*) {PAST} AS n, price AS target FROM ticks)"""


def samples(t):
    df = t.ticks().withColumn("target", F.col("price"))
    return folds.supervised(df, ["price", "volume"], 5)


def cell(name: str, i: int, j: int):
    return F.get(F.get(name, F.lit(i)), F.lit(j))


@query("prp_01", sql(f"{TICKS}, {SEQ}, final AS (SELECT * FROM sq WHERE n = 5)", "symbol, seq", " ".join(x[0] for x in SEQ_CELLS) + " feature_price feature_volume target"))
def _sequences(t):
    """Every cell of the history, the features and the target of each sample."""
    history = [cell("sequence", i, j).alias(f"{c}_{i}") for i in range(5) for j, c in enumerate(("price", "volume"))]
    features = [F.get("features", F.lit(j)).alias(f"feature_{c}") for j, c in enumerate(("price", "volume"))]
    return samples(t).select("symbol", "seq", *history, *features, "target")


@query("prp_02", sql(f"{TICKS}, {SEQ}, final AS (SELECT symbol, seq, 10 AS width, {', '.join(f'{x[0]} AS x{k}' for k, x in enumerate(SEQ_CELLS))} FROM sq WHERE n = 5)", "symbol, seq, width", " ".join(f"x{k}" for k in range(10))))
def _flat(t):
    f = folds.flat(F.col("sequence"))
    return samples(t).select("symbol", "seq", F.size(f).alias("width"), *[F.get(f, F.lit(k)).alias(f"x{k}") for k in range(10)])


# -- folds -----------------------------------------------------------------------------------------


@query("prp_03", f"WITH {ROWS} SELECT seq, idx, CASE WHEN idx < floor(0.8e0 * total) THEN 'train' ELSE 'val' END AS role FROM rows0")
def _chronological(t):
    return folds.chronological(rows(t)).select("seq", "idx", "role")


@query(
    "prp_04",
    f"""WITH {ROWS}, f AS (SELECT fold, fold * 500 AS a FROM (SELECT unnest(range(0, (SELECT max(total) FROM rows0) // 500)) AS fold) WHERE fold * 500 + 4500 <= (SELECT max(total) FROM rows0))
SELECT seq, fold, CASE WHEN idx < a + 4000 THEN 'train' ELSE 'val' END AS role FROM rows0 JOIN f ON idx >= a AND idx < a + 4500
UNION ALL SELECT seq, 0, CASE WHEN idx < floor(0.8e0 * total) THEN 'train' ELSE 'val' END FROM rows0 WHERE total < 4500""",
)
def _walk(t):
    return folds.walk_forward(rows(t), 4000, 500).select("seq", "fold", "role")


@query(
    "prp_05",
    f"""WITH {ROWS}, n AS (SELECT max(total) AS n FROM rows0), s AS (SELECT n, CASE WHEN n - 4000 < 1500 * 5 THEN greatest((n - 4000) // 5, 375) ELSE 1500 END AS size FROM n),
f AS (SELECT k AS fold, 4000 + k * size AS a, least(4000 + (k + 1) * size, n) AS b FROM s, range(5) r(k) WHERE least(4000 + (k + 1) * size, n) > 4000 + k * size)
SELECT seq, fold, CASE WHEN idx < a THEN 'train' ELSE 'val' END AS role FROM rows0 JOIN f ON idx < b WHERE 4000 + (SELECT size FROM s) <= total
UNION ALL SELECT seq, 0, CASE WHEN idx < floor(0.8e0 * total) THEN 'train' ELSE 'val' END FROM rows0 WHERE 4000 + (SELECT size FROM s) > total""",
)
def _anchored(t):
    df = rows(t)
    return folds.assign(df, folds.anchored_table(folds.totals(df), 4000, 1500)).select("seq", "fold", "role")


RATIO = """n AS (SELECT max(total) AS n FROM rows0), s AS (SELECT n, n // 2 AS m, greatest((n - n // 2) // 5, 10) AS size FROM n),
f AS (SELECT k AS fold, m + k * size AS a, least(m + (k + 1) * size, n) AS b FROM s, range(5) r(k) WHERE least(m + (k + 1) * size, n) - (m + k * size) >= 10),
folded AS (SELECT rows0.*, fold, CASE WHEN idx < a THEN 'train' ELSE 'val' END AS role FROM rows0 JOIN f ON idx < b)"""


def folded(t):
    df = rows(t)
    return folds.assign(df, folds.anchored_ratio_table(folds.totals(df)))


@query("prp_06", f"WITH {ROWS}, {RATIO} SELECT seq, fold, role FROM folded")
def _ratio(t):
    return folded(t).select("seq", "fold", "role")


PURGED = f"""{BARS}, b0 AS (SELECT row_number() OVER (ORDER BY ts, seq) - 1 AS idx, seq, ts, row_number() OVER (PARTITION BY session_date ORDER BY ts, seq) - 1 AS bar_index, count(*) OVER () AS n FROM bars),
f AS (SELECT k AS fold, n - (6 - k) * (n // 6) AS a, n - (5 - k) * (n // 6) AS b FROM (SELECT max(n) AS n FROM b0), range(1, 6) r(k)),
tr AS (SELECT fold, seq, ts FROM b0 JOIN f ON idx < a), em AS (SELECT fold, max(ts) + INTERVAL 30 MINUTE AS em FROM tr GROUP BY fold),
v0 AS (SELECT fold, seq, ts, bar_index FROM b0 JOIN f ON idx >= a AND idx < b JOIN em USING (fold) WHERE ts >= em),
op AS (SELECT fold, min(ts) FILTER (bar_index = 0) AS op FROM v0 GROUP BY fold)"""


@query(
    "prp_07",
    f"""WITH {PURGED} SELECT fold, seq, 'val' AS role FROM v0 JOIN op USING (fold) WHERE op IS NULL OR ts >= op
UNION ALL SELECT fold, seq, 'train' FROM tr WHERE fold IN (SELECT fold FROM op)""",
)
def _purged(t):
    df = folds.indexed(clean.session_index(t.bars(), ("session_date",)))
    return folds.purged(df).select("fold", "seq", "role")


COMBOS = folds.combination_rows(16, 8, 200, 42)


@query(
    "prp_08",
    f"""WITH {ROWS}, combos(combo, grp, cl, cr) AS (VALUES {', '.join(f'({c},{g},{str(a).lower()},{str(b).lower()})' for c, g, a, b in COMBOS)}),
uses AS (SELECT grp, cl, cr, count(*) AS n FROM combos GROUP BY ALL),
g AS (SELECT seq, idx, total, ((idx + 1) * 16 - 1) // total AS grp FROM rows0),
s AS (SELECT *, idx - (grp * total) // 16 AS from_left, ((grp + 1) * total) // 16 - 1 - idx AS from_right FROM g)
SELECT seq, s.grp, CAST(sum(n) AS BIGINT) AS test_sets FROM s JOIN uses USING (grp) WHERE (NOT cl OR from_left >= 45) AND (NOT cr OR from_right >= 45) GROUP BY seq, s.grp""",
)
def _groups(t):
    """Group of each row and the number of sampled test sets that keep it after trimming."""
    return folds.test_membership(rows(t), trim=45).select("seq", "grp", "test_sets")


@query("prp_17", sql(f"{ROWS}, {RATIO}, final AS (SELECT fold, count(*) FILTER (target = 0) / greatest(count(*) FILTER (target = 1), 1) AS scale_pos_weight FROM folded WHERE role = 'train' GROUP BY fold)", "fold", "scale_pos_weight"))
def _weights(t):
    return folds.class_weight(scaling.train_rows(folded(t)), "target")


@query("prp_18", f"WITH {TICKS} SELECT symbol, seq, CASE WHEN CAST('0x' || left(md5('42:' || seq), 8) AS BIGINT) < 0.8e0 * 4294967296 THEN 'train' ELSE 'val' END AS role FROM ticks")
def _hashed(t):
    return folds.hashed_split(t.ticks().select("symbol", "seq"), ["seq"])


@query("prp_19", sql("final AS (SELECT vec_id, 3 + len(embedding) AS width, label * 1e0 AS first_value, embedding[64]::DOUBLE AS last_value FROM embeddings)", "vec_id, width", "first_value last_value"))
def _append(t):
    e = t.raw("embeddings")
    base = F.array(*[F.col(c).cast("double") for c in ("label", "vec_id", "label")])
    v = folds.append_vector(base, F.col("embedding").cast("array<double>"))
    names = folds.vector_names(["label", "vec", "again"], 64)
    return e.select("vec_id", F.size(v).alias("width"), F.get(v, F.lit(0)).alias("first_value"), F.get(v, F.lit(len(names) - 1)).alias("last_value"))


# -- scalers ---------------------------------------------------------------------------------------

ALL = f"{ROWS}, {RATIO}"
MED = "med AS (SELECT fold, coalesce(median(x), 0) AS mx FROM folded WHERE role = 'train' GROUP BY fold)"


@query("agg_15", sql(f"{ALL}, {MED}, final AS (SELECT seq, fold, role, coalesce(x, mx) AS x FROM folded JOIN med USING (fold))", "seq, fold, role", "x"))
def _impute(t):
    df = folded(t)
    return scaling.impute(df, scaling.fit_medians(scaling.train_rows(df), ["x"]), ["x"]).select("seq", "fold", "role", "x")


@query(
    "agg_14",
    sql(
        f"""{ALL}, q AS (SELECT fold, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM folded WHERE role = 'train' GROUP BY fold),
final AS (SELECT seq, fold, role, CASE WHEN x IS NOT NULL THEN greatest(least(x, b + 4 * (b - a)), a - 4 * (b - a)) END AS x FROM folded JOIN q USING (fold))""",
        "seq, fold, role",
        "x",
    ),
)
def _fences(t):
    df = folded(t)
    return scaling.clip_fences(df, scaling.fit_fences(scaling.train_rows(df), ["x"]), ["x"]).select("seq", "fold", "role", "x")


STD = "sp AS (SELECT fold, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM folded WHERE role = 'train' GROUP BY fold)"


@query("prp_09", sql(f"{ALL}, {STD}, final AS (SELECT seq, fold, role, (x - mx) / sx AS x, (y - my) / sy AS y FROM folded JOIN sp USING (fold))", "seq, fold, role", "x y"))
def _standard(t):
    df = folded(t)
    p = scaling.fit_standard(scaling.train_rows(df), ["x", "y"])
    return scaling.apply_scale(df, p, ["x", "y"]).select("seq", "fold", "role", "x", "y")


@query(
    "prp_10",
    sql(
        f"""{ROWS}, w AS (SELECT y, greatest(0, least(idx + 20, 20 + s - 1) - greatest(idx + 1, 20) + 1) AS w FROM (SELECT *, CAST(floor(0.8e0 * (total - 20)) AS BIGINT) AS s FROM rows0)),
rep AS (SELECT y FROM w, range(w.w)), final AS (SELECT 0 AS fold, avg(y) AS y_center, stddev_pop(y) AS y_scale, median(y) AS y_mid, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS y_range FROM rep)""",
        "fold",
        "y_center y_scale y_mid y_range",
    ),
)
def _overlapping(t):
    """Scaler of the train histories (20 rows each), from row weights instead of exploded histories."""
    df = folds.with_total(rows(t)).withColumn("fold", F.lit(0))
    samples = F.floor(F.lit(0.8) * (F.col("total") - 20))
    w = scaling.sequence_weight(F.col("idx"), 20, samples)
    std = scaling.fit_standard(df, ["y"], weight=w)
    rob = scaling.fit_robust(df, ["y"], weight=w).select("fold", F.col("y_center").alias("y_mid"), F.col("y_scale").alias("y_range"))
    return std.join(rob, "fold")


@query(
    "prp_11",
    sql(
        f"""{ALL}, q AS (SELECT fold, median(x) AS m, quantile_cont(x, 0.85) - quantile_cont(x, 0.15) AS r FROM folded WHERE role = 'train' GROUP BY fold),
final AS (SELECT seq, fold, role, (x - m) / r AS x FROM folded JOIN q USING (fold))""",
        "seq, fold, role",
        "x",
    ),
)
def _robust(t):
    df = folded(t)
    p = scaling.fit_robust(scaling.train_rows(df), ["x"], *scaling.sane_range(15, 85))
    return scaling.apply_scale(df, p, ["x"]).select("seq", "fold", "role", "x")


@query("prp_12")
def _power(t):
    df = folded(t)
    p = scaling.fit_power(scaling.train_rows(df), ["x", "y"])
    return scaling.apply_power(df, p, ["x", "y"]).select("seq", "fold", "role", "x", "y")


def family(t):
    df = returns(t).select(
        "symbol", "ts", "seq", "session_date", "log_ret", "volume", "close", ((F.col("volume") - 50) / 10).alias("delta"), F.col("low").alias("iv")
    )
    df = folds.indexed(df)
    return folds.assign(df, folds.anchored_ratio_table(folds.totals(df), folds=3))


@query("prp_13")
def _sequence_family(t):
    out = scaling.sequence_family(family(t), ["log_ret"], ["iv", "close"])
    return out.select("symbol", "seq", "fold", "role", "log_ret", "iv", "close")


@query("prp_14")
def _tree_family(t):
    out = scaling.tree_family(family(t), ["volume"], ["delta"], ["iv"])
    return out.select("symbol", "seq", "fold", "role", "volume", "delta", "iv")


@query("prp_15", sql(f"{ALL}, final AS (SELECT seq, fold, role, x, y FROM folded)", "seq, fold, role", "x y"))
def _invert(t):
    df = folded(t)
    p = scaling.fit_standard(scaling.train_rows(df), ["x", "y"])
    there = scaling.apply_scale(df, p, ["x", "y"])
    return scaling.apply_scale(there, p, ["x", "y"], inverse=True).select("seq", "fold", "role", "x", "y")


@query("prp_16", sql(f"{ALL}, {STD}, final AS (SELECT fold, mx AS x_center, sx AS x_scale, my AS y_center, sy AS y_scale, count(*) AS n, 0e0 AS max_gap FROM folded JOIN sp USING (fold) GROUP BY ALL)", "fold, n", "x_center x_scale y_center y_scale max_gap"))
def _persist(t):
    """Fitted scalers written, reloaded, and compared on all rows with the ones that were fitted."""
    import uuid

    df = durable(folded(t))
    path = f"{checkpoint_dir(t.spark)}/tables/scaler-{uuid.uuid4().hex}"
    fitted = durable(scaling.fit_standard(scaling.train_rows(df), ["x", "y"]))
    fitted.write.parquet(path)
    return scaling.reload_gap(df, fitted, t.spark.read.parquet(path), ["x", "y"])


# -- audits ----------------------------------------------------------------------------------------

CORR = "CASE WHEN count(*) < 3 OR stddev_pop(a) < 1e-12 OR stddev_pop(b) < 1e-12 THEN 0 ELSE corr(a, b) END"


@query("agg_16", sql(f"{ROWS}, p AS (SELECT symbol, x AS a, y AS b FROM rows0 WHERE x IS NOT NULL), final AS (SELECT symbol, {CORR} AS corr FROM p GROUP BY symbol)", "symbol", "corr"))
def _corr(t):
    return rows(t).groupBy("symbol").agg(quality.safe_corr("x", "y").alias("corr"))


POP_SKEW = "(avg(pow({0}, 3)) - 3 * avg({0}) * avg({0} * {0}) + 2 * pow(avg({0}), 3)) / pow(var_pop({0}), 1.5e0)"


@query(
    "agg_17",
    sql(
        f"{ROWS}, s AS (SELECT symbol, 'x' AS feature, {POP_SKEW.format('x')} AS skew FROM rows0 GROUP BY symbol UNION ALL SELECT symbol, 'y', {POP_SKEW.format('y')} FROM rows0 GROUP BY symbol), final AS (SELECT *, abs(skew) >= 0.5 AS too_high FROM s)",
        "symbol, feature, too_high",
        "skew",
    ),
)
def _skew(t):
    return quality.skew_report(rows(t), ["x", "y"], ["symbol"])


def score(c: str) -> str:
    return f"SELECT '{c}' AS feature, abs(coalesce(covar_pop({c}, target) / (stddev_pop({c}) * (stddev_pop(target) + 1e-12) + 1e-12), 0)) AS score FROM wide WHERE {c} IS NOT NULL"


WIDE = "wide AS (SELECT seq, symbol, x, y, x * y AS xy, x / 3 + seq % 5 AS z, CAST(7 AS DOUBLE) AS flat, target FROM rows0)"
SCORED = f"{ROWS}, {WIDE}, scored AS (" + " UNION ALL ".join(score(c) for c in ("x", "y", "xy", "z")) + ")"


def wide(t):
    x, y = F.col("x"), F.col("y")
    df = rows(t).select("seq", "symbol", "x", "y", (x * y).alias("xy"), (x / 3 + F.col("seq") % 5).alias("z"), F.lit(7.0).alias("flat"), "target")
    return df.withColumn("target", F.col("target").cast("double"))


@query("agg_18", sql(f"{SCORED}, final AS (FROM scored)", "feature", "score"))
def _scores(t):
    return quality.feature_scores(wide(t), ["x", "y", "xy", "z"], "target")


@query("top_04", sql(f"{SCORED}, final AS (SELECT feature, score, row_number() OVER (ORDER BY score DESC, feature) AS rank FROM scored QUALIFY rank <= 3)", "feature, rank", "score"))
def _select(t):
    return quality.top_features(quality.feature_scores(wide(t), ["x", "y", "xy", "z"], "target"), 3)


@query(
    "agg_19",
    sql(
        f"{ROWS}, {WIDE}, s AS (SELECT unnest(['x', 'y', 'flat']) AS feature, unnest([stddev_pop(x), stddev_pop(y), stddev_pop(flat)]) AS s FROM wide), final AS (SELECT count(*) AS feature_count, min(s) AS std_min, max(s) AS std_max, count(*) FILTER (s <= 1e-6) AS low_variance_count, string_agg(feature, ',') FILTER (s <= 1e-6) AS low_variance_features FROM s)",
        "feature_count, low_variance_count, low_variance_features",
        "std_min std_max",
    ),
)
def _variance(t):
    return quality.variance_audit(wide(t), ["x", "y", "flat"])


@query("agg_20", f"WITH {BARS} SELECT symbol, session_date, count(*) AS rows, count(*) >= 67 AS ok FROM bars GROUP BY ALL")
def _session_rows(t):
    return quality.session_counts(t.bars(), at_least=67, keys=["symbol"])


@query("agg_21", f"WITH {RETURNS} SELECT symbol, count(*) FILTER (rn <> 0 AND (log_ret IS NULL OR nullif(volume, 42) IS NULL)) AS null_rows, 0 AS inf_rows, count(*) FILTER (rn <> 0 AND (log_ret IS NULL OR nullif(volume, 42) IS NULL)) = 0 AS ok FROM ret GROUP BY symbol")
def _nulls(t):
    df = clean.session_index(returns(t)).withColumn("volume", F.when(F.col("volume") != 42, F.col("volume")))
    return quality.null_audit(df, ["log_ret", "volume", "close"], keys=["symbol"])


@query("agg_22", f"WITH {ROWS} SELECT symbol, count(*) AS targets, coalesce(bool_and(target + CASE WHEN seq % 1999 = 0 THEN 1 ELSE 0 END IN (0, 1)), true) AS ok FROM rows0 GROUP BY symbol")
def _targets(t):
    df = rows(t).withColumn("target", F.col("target") + F.when(F.col("seq") % 1999 == 0, 1).otherwise(0))
    return quality.target_audit(df, keys=["symbol"])


@query(
    "agg_23",
    """WITH h AS (SELECT event_type AS symbol, event_id AS seq, CASE WHEN event_id % 501 = 0 THEN ts - INTERVAL 2 DAY ELSE date_trunc('minute', ts) END AS ts FROM events),
b AS (SELECT symbol, count(*) FILTER (back) AS backward_steps FROM (SELECT symbol, ts < lag(ts) OVER (PARTITION BY symbol ORDER BY seq) AS back FROM h) GROUP BY symbol),
d AS (SELECT symbol, CAST(count(*) - count(DISTINCT ts) AS BIGINT) AS repeated FROM h GROUP BY symbol)
SELECT symbol, backward_steps, repeated, backward_steps = 0 AND repeated = 0 AS ok FROM b JOIN d USING (symbol)""",
)
def _stamps(t):
    ts = F.when(F.col("seq") % 501 == 0, F.col("ts") - F.expr("INTERVAL 2 DAYS")).otherwise(F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    return quality.timestamp_audit(t.ticks().select("symbol", "seq", ts.alias("ts")))


@query(
    "agg_24",
    sql(
        f"{ROWS}, z AS (SELECT unnest(['x', 'y']) AS feature, unnest([avg(x / 50), avg((y - 49.5e0) / 28)]) AS mean, unnest([stddev_samp(x / 50), stddev_samp((y - 49.5e0) / 28)]) AS std FROM rows0), final AS (SELECT *, abs(mean) <= 0.3 AND std BETWEEN 0.5 AND 1.5 AS ok FROM z)",
        "feature, ok",
        "mean std",
    ),
)
def _zaudit(t):
    df = rows(t).select((F.col("x") / 50).alias("x"), ((F.col("y") - 49.5) / 28).alias("y"))
    return quality.zscore_audit(df, ["x", "y"])


EDGE = """tail AS (SELECT * FROM folded WHERE role = 'train' QUALIFY row_number() OVER (PARTITION BY fold ORDER BY ts DESC, seq DESC) <= 100),
head AS (SELECT * FROM folded WHERE role = 'val' QUALIFY row_number() OVER (PARTITION BY fold ORDER BY ts, seq) <= 100),
edges AS (SELECT *, row_number() OVER (PARTITION BY fold, role ORDER BY ts, seq) - 1 AS edge_pos FROM (FROM tail UNION ALL FROM head))"""


@query("top_05", f"WITH {ALL}, {EDGE} SELECT fold, role, edge_pos, seq FROM edges")
def _edges(t):
    return quality.edge_rows(folded(t)).select("fold", "role", "edge_pos", "seq")


@query(
    "agg_25",
    sql(
        f"""{ALL}, {EDGE}, p AS (SELECT a.fold, a.x, a.y, b.target FROM edges a JOIN edges b ON a.fold = b.fold AND a.edge_pos = b.edge_pos AND a.role = 'train' AND b.role = 'val'),
l AS (SELECT fold, 'x' AS feature, x AS a, target AS b FROM p WHERE x IS NOT NULL UNION ALL SELECT fold, 'y', y, target FROM p),
c AS (SELECT fold, feature, {CORR} AS corr FROM l GROUP BY fold, feature), final AS (SELECT *, abs(corr) >= 0.05 AS leaks FROM c)""",
        "fold, feature, leaks",
        "corr",
    ),
)
def _leakage(t):
    return quality.leakage_audit(folded(t), ["x", "y"])


@query("agg_26", f"WITH {BARS} SELECT symbol, count(*) AS rows, count(*) FILTER (seq % 17 = 0) AS null_rows, count(*) FILTER (volume < 5) AS stale_rows FROM bars GROUP BY symbol")
def _ingest(t):
    df = t.bars().withColumns({"close": F.when(F.col("seq") % 17 > 0, F.col("close")), "is_stale": F.col("volume") < 5})
    return quality.ingest_summary(df)


@query(
    "agg_28",
    sql(
        f"""{TICKS}, l AS (UNPIVOT (SELECT symbol, price, high, low, volume FROM ticks) ON price, high, low, volume INTO NAME feature VALUE v),
final AS (SELECT symbol, feature, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, quantile_cont(v, 0.25) AS p25, median(v) AS p50, quantile_cont(v, 0.75) AS p75, max(v) AS max FROM l GROUP BY ALL)""",
        "symbol, feature, n",
        "mean std min p25 p50 p75 max",
    ),
)
def _describe(t):
    return quality.describe(t.ticks(), ["price", "high", "low", "volume"], ["symbol"])


@query(
    "agg_29",
    sql(
        f"""{TICKS}, s AS (SELECT seq AS row_id, price + (k * 37 + seq) % 11 / 1e1 AS v FROM ticks, range(8) r(k)),
final AS (SELECT row_id, avg(v) AS prediction, var_samp(v) AS variance, stddev_samp(v) AS uncertainty_std, 1 / (1 + stddev_samp(v)) AS confidence FROM s GROUP BY row_id)""",
        "row_id",
        "prediction variance uncertainty_std confidence",
    ),
)
def _spread(t):
    k = F.explode(F.sequence(F.lit(0), F.lit(7)))
    df = t.ticks().select(F.col("seq").alias("row_id"), "price", k.alias("k"))
    df = df.select("row_id", (F.col("price") + (F.col("k") * 37 + F.col("row_id")) % 11 / 10).alias("prediction"))
    return quality.sample_spread(df)


@query("udf_02", sql(f"{RETURNS}, final AS (SELECT symbol, seq, close - avg(close) OVER (PARTITION BY symbol, session_date) AS centred FROM bars)", "symbol, seq", "centred"))
def _per_session(t):
    from barloom.functions.custom import session_transform

    return session_transform(t.bars(), "close", "centred", {"mean": F.avg("close")}, lambda x, m: x - m).select("symbol", "seq", "centred")
