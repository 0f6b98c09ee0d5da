"""Option-slice and cross-section queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.alignment import WEIGHTS, weights
from barloom.catalog.base import CHAIN, PANEL_RETURNS, query, sql
from barloom.operators import options as op
from barloom.operators import xsection as xs

TIE = ("strike", "option_type", "id", "part")
TIES = ", ".join(TIE)

SUMMARY = f"""nn AS (SELECT * FROM chain WHERE spot IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ts ORDER BY abs(strike - spot), {TIES}) <= 2),
atm AS (SELECT ts, avg(iv) AS atm_iv FROM nn GROUP BY ts),
sums AS (SELECT ts, avg(iv) FILTER (option_type = 'C') AS civ, avg(iv) FILTER (option_type = 'p') AS piv,
  sum(CASE WHEN option_type = 'C' THEN delta ELSE -delta END) AS opt_delta_net, sum(gamma) AS opt_gamma_net, sum(vega) AS opt_vega_net,
  sum(gamma * coalesce(oi, 0)) * 50 AS gex, coalesce(sum(volume) FILTER (option_type = 'C'), 0) AS cv, coalesce(sum(volume) FILTER (option_type = 'p'), 0) AS pv,
  coalesce(sum(oi) FILTER (option_type = 'C'), 0) AS co, coalesce(sum(oi) FILTER (option_type = 'p'), 0) AS po FROM chain GROUP BY ts),
final AS (SELECT ts, atm_iv, CASE WHEN atm_iv IS NOT NULL THEN piv - civ END AS iv_skew, (piv + civ) / 2 - atm_iv AS iv_butterfly,
  opt_delta_net, opt_gamma_net, opt_vega_net, gex, pv / (cv + 1) AS pcr_vol, po / (co + 1) AS pcr_oi,
  (co - po) / (co + po + 1) AS oi_imbalance, (cv - pv) / (cv + pv + 1) AS oi_flow FROM sums LEFT JOIN atm USING (ts))"""


def summary(name, outs):
    @query(name, sql(f"{CHAIN}, {SUMMARY}", "ts", outs))
    def _run(t):
        return op.chain_summary(t.chain(), tie=TIE).select("ts", *outs.split())


summary("agg_02", "atm_iv")
summary("agg_03", "iv_skew iv_butterfly")
summary("agg_04", "opt_delta_net opt_gamma_net opt_vega_net gex")
summary("agg_05", "pcr_vol pcr_oi")
summary("agg_06", "oi_imbalance oi_flow")
summary("udf_03", "atm_iv iv_skew opt_delta_net pcr_oi")

OTM = "(option_type = 'C' AND strike > spot) OR (option_type = 'p' AND strike < spot)"


@query(
    "top_02",
    f"""WITH {CHAIN}, filled AS (SELECT * REPLACE (coalesce(spot, median(strike) OVER (PARTITION BY ts)) AS spot) FROM chain WHERE NOT (day(ts) = 9 AND strike BETWEEN 0 AND 10000 AND option_type = 'C')
  AND NOT (day(ts) = 9 AND strike < 200)),
picked AS (SELECT * FROM filled WHERE {OTM} QUALIFY row_number() OVER (PARTITION BY ts, option_type ORDER BY abs(strike - spot), {TIES}) <= 10),
rest AS (SELECT * FROM filled WHERE ts NOT IN (SELECT ts FROM filled WHERE {OTM}) QUALIFY row_number() OVER (PARTITION BY ts ORDER BY abs(strike - spot), {TIES}) <= 20)
SELECT ts, id, part, strike, option_type, round(spot, 6) AS spot FROM picked UNION ALL SELECT ts, id, part, strike, option_type, round(spot, 6) FROM rest""",
)
def _nearest(t):
    """On the 9th only puts above the spot are left, so those slices use the fallback."""
    ninth = F.dayofmonth("ts") == 9
    chain = t.chain().where(~(ninth & ((F.col("option_type") == "C") | (F.col("strike") < 200))))
    return op.nearest_otm(chain, tie=TIE).select("ts", "id", "part", "strike", "option_type", "spot")


CLEANED = """ok AS (SELECT ts, strike, avg(iv) AS iv, any_value(spot) AS spot FROM chain WHERE iv BETWEEN 0.01 AND 2 AND spot > 0 GROUP BY ts, strike),
mm AS (SELECT *, ln(strike / (spot * exp(5e-2 * (1e1 / 365)))) AS m FROM ok),
knots AS (SELECT ts, strike, iv, m FROM (SELECT *, abs(iv - lag(iv) OVER (PARTITION BY ts ORDER BY m)) AS jump FROM mm) WHERE coalesce(jump, 0) <= 15e-2)"""


def priced(t):
    return t.chain().withColumns({"rate": F.lit(0.05), "years": F.lit(10.0) / 365})


@query("mat_10", sql(f"{CHAIN}, {CLEANED}, final AS (FROM knots)", "ts, strike", "iv m"))
def _strikes(t):
    return op.clean_strikes(priced(t)).select("ts", "strike", "iv", "m")


W = "OVER (PARTITION BY ts ORDER BY m)"
PCHIP = f"""k AS (SELECT * FROM knots QUALIFY count(*) OVER (PARTITION BY ts) >= 6),
g0 AS (SELECT *, lead(m) {W} - m AS h, (lead(iv) {W} - iv) / (lead(m) {W} - m) AS s FROM k),
g AS (SELECT *, lag(h) {W} AS hb, lag(s) {W} AS sb, lead(h) {W} AS hn, lead(s) {W} AS sn, lag(h, 2) {W} AS hbb, lag(s, 2) {W} AS sbb FROM g0),
e AS (SELECT *, ((2 * h + hn) * s - h * sn) / (h + hn) AS fd, ((2 * hb + hbb) * sb - hb * sbb) / (hb + hbb) AS ld FROM g),
d AS (SELECT *, CASE
  WHEN hb IS NULL THEN CASE WHEN sign(fd) <> sign(s) THEN 0 WHEN sign(s) <> sign(sn) AND abs(fd) > 3 * abs(s) THEN 3 * s ELSE fd END
  WHEN h IS NULL THEN CASE WHEN sign(ld) <> sign(sb) THEN 0 WHEN sign(sb) <> sign(sbb) AND abs(ld) > 3 * abs(sb) THEN 3 * sb ELSE ld END
  WHEN sb * s <= 0 THEN 0 ELSE 3 * (h + hb) / ((2 * h + hb) / sb + (h + 2 * hb) / s) END AS d FROM e),
c AS (SELECT *, lead(d) {W} AS dn FROM d)"""


def at(x: str, source: str) -> str:
    return f"""SELECT ts, any_value(iv + (x - m) * (d + (x - m) * ((3 * s - 2 * d - dn) / h + (x - m) * (d + dn - 2 * s) / (h * h)))) AS y
  FROM (SELECT *, {x} AS x FROM {source}) WHERE h IS NOT NULL AND (x >= m OR hb IS NULL) AND (x < m + h OR hn IS NULL) GROUP BY ts"""


REACH = "0.6744897501960817e0 * greatest(atm, 0.01e0) * sqrt(1e1 / 365)"
MID = "5e-1 * greatest(atm, 0.01e0) * greatest(atm, 0.01e0) * (1e1 / 365)"


@query(
    "mat_09",
    sql(
        f"""{CHAIN}, {CLEANED}, {PCHIP}, a AS ({at('0e0', 'c')}), w AS (SELECT c.*, a.y AS atm FROM c JOIN a USING (ts)),
hi AS ({at(f'{MID} + {REACH}', 'w')}), lo AS ({at(f'{MID} - {REACH}', 'w')}),
final AS (SELECT s.ts, a.y AS synth_atm_iv, lo.y - hi.y AS iv_skew_25d, (lo.y + hi.y) / 2 - a.y AS iv_butterfly
  FROM (SELECT DISTINCT ts FROM chain) s LEFT JOIN a ON a.ts = s.ts LEFT JOIN hi ON hi.ts = s.ts LEFT JOIN lo ON lo.ts = s.ts)""",
        "ts",
        "synth_atm_iv iv_skew_25d iv_butterfly",
    ),
)
def _smile(t):
    return op.smile(priced(t))


# -- cross-section ---------------------------------------------------------------------------------

DIM = f"""{PANEL_RETURNS}, {WEIGHTS}, dim AS (SELECT symbol, sector, weight / sum(weight) OVER () AS w,
  row_number() OVER (ORDER BY weight DESC, symbol) <= 5 AS top FROM weights),
ix AS (SELECT ts, avg(log_ret) AS index_ret FROM panel_returns GROUP BY ts),
grid AS (SELECT ts, symbol, w, sector, top, coalesce(log_ret, 0) AS r, coalesce(is_stale, false) AS stale
  FROM (SELECT DISTINCT ts FROM panel_returns) CROSS JOIN dim LEFT JOIN panel_returns USING (ts, symbol)),
wr AS (SELECT *, sum(w * r) OVER (PARTITION BY ts) AS wrs FROM grid),
final AS (SELECT ts, any_value(wrs) - coalesce(any_value(index_ret), 0) AS wrs_residual, sqrt(sum(w * (r - wrs) * (r - wrs))) AS cssd,
  CASE WHEN any_value(wrs) <> 0 THEN greatest(least(sum(w * r) FILTER (top) / any_value(wrs), 5), -5) END AS concentration_ratio,
  {', '.join(f"coalesce(sum(w * r) FILTER (contains(sector, '{s}')), 0) AS sector_{s}_flow" for s in xs.SECTORS)},
  count(*) FILTER (r > 0) - count(*) FILTER (r < 0) AS const_adv_dec, count(*) FILTER (r > 0) / 25e0 AS adv_ratio,
  stddev_samp(r) FILTER (top) AS top5_dispersion, CAST(sum(CAST(stale AS INTEGER)) AS BIGINT) AS stale_feed_count
  FROM wr LEFT JOIN ix USING (ts) GROUP BY ts)"""


def section(name, outs, ids="ts"):
    @query(name, sql(DIM, ids, outs))
    def _run(t):
        returns = t.panel_returns()
        index = returns.groupBy("ts").agg(F.avg("log_ret").alias("index_ret"))
        out = xs.constituent_features(returns, weights(t), index)
        return out.select(*[c.strip() for c in ids.split(",")], *outs.split())


section("agg_07", "wrs_residual")
section("agg_08", "cssd")
section("agg_09", "concentration_ratio")
section("agg_10", "sector_bank_flow sector_it_flow sector_energy_flow sector_industrial_flow")
section("agg_11", "adv_ratio", "ts, const_adv_dec")
section("agg_12", "top5_dispersion")
section("agg_13", "", "ts, stale_feed_count")


@query("top_03", f"WITH {WEIGHTS} SELECT symbol, round(weight + 3.1415926e-08, 6) AS weight, row_number() OVER (ORDER BY weight DESC, symbol) AS rank FROM weights QUALIFY rank <= 5")
def _top(t):
    return xs.heaviest(weights(t)).select("symbol", "weight", "rank")
