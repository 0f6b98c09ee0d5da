"""Constants and schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the data model.
EXCHANGE_ZONE = "Asia/Kolkata"
SESSION_START, SESSION_END = "09:15", "15:29"
BARS_PER_SESSION = 375
FEATURE_BARS_PER_SESSION = 374
EPSILON = 1e-8
Z_CLIP = 3.5
Z_WINDOW = 60
ATR_WINDOW = 14
ANNUAL_BARS = 94_500.0
TRADING_DAYS = 252.0
CONTRACT_SIZE = 50
EMBARGO_MINUTES = 30
MIN_STRIKES = 6
MIN_YEARS_TO_EXPIRY = 5.0 / (375.0 * 365.0)
SCHEMA_VERSION = "3.0"

TICK_COLUMNS = ("timestamp", "price", "high", "low", "volume")
TICK_ALIASES = {"idx_close": "price", "idx_high": "high", "idx_low": "low", "idx_volume": "volume"}
PRICE_PRIORITY = ("price", "close", "idx_close", "last", "ltp")
DEFAULT_REGIME = ("2000-01-01", "2030-12-31", 3, 0)

REGIMES = T.StructType(
    [
        T.StructField("date_from", T.DateType()),
        T.StructField("date_to", T.DateType()),
        T.StructField("expiry_weekday", T.IntegerType()),
        T.StructField("regime_flag", T.IntegerType()),
    ]
)
OPTION_FIELDS = ("iv", "delta", "gamma", "theta", "vega", "last_price", "volume", "oi")

# Fixed value: pass-through columns of the feature stage.
PASS_THROUGH = (
    "session_date bar_index_in_session idx_log_ret idx_overnight_ret idx_vol_zscore days_to_expiry dte_normalized "
    "is_expiry_day regime_flag synth_atm_iv iv_skew_25d iv_butterfly opt_delta_net opt_gamma_net opt_vega_net gex "
    "total_pcr_vol total_pcr_oi oi_imbalance oi_flow"
).split()
