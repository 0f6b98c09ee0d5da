"""Nested payloads (JSON or CSV text in a column) to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.scalars import json_first, number, read_timestamp


def _list_text(c: Column, *paths: str) -> Column:
    """JSON text of a list: the payload itself, or the first given path; one object becomes a list of one."""
    body = F.when(F.ltrim(c).startswith("["), c).otherwise(json_first(c, *paths))
    return F.when(F.ltrim(body).startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)


def candles(df: DataFrame, payload: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``[[ts, open, high, low, close, volume, ...], ...]``, bare or under ``candles``/``data.candles``."""
    text = _list_text(F.col(payload), "$.candles", "$.data.candles")
    rows = df.select(*keep, F.explode(F.from_json(text, "array<array<string>>")).alias("_c")).where(F.size("_c") >= 6)
    cell = lambda i: F.get("_c", F.lit(i))
    out = rows.select(
        *keep,
        read_timestamp(cell(0)).alias("ts"),
        *[number(cell(i + 1)).alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"))],
    )
    return out.where("ts IS NOT NULL")


def _field(doc: Column, *keys: str, default: float | None = None) -> Column:
    """First key with a value: at the top for all keys, then key by key in the market data and the greeks."""
    paths = [f"$.{k}" for k in keys]
    for k in keys:
        paths += [f"$.market_data.{k}", f"$.option_greeks.{k}"]
    found = number(json_first(doc, *paths))
    return found if default is None else F.coalesce(found, F.lit(default))


def option_rows(df: DataFrame, payload: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Option-chain payload to one row per strike and side; records without a strike are dropped."""
    text = F.coalesce(_list_text(F.col(payload), "$.data"), F.concat(F.lit("["), F.col(payload), F.lit("]")))
    rec = df.select(*keep, F.explode(F.from_json(text, "array<string>")).alias("_r"))
    rec = rec.withColumn("strike", number(json_first(F.col("_r"), "$.strike_price", "$.strike", "$.strikePrice")))
    call, put = F.get_json_object("_r", "$.call_options"), F.get_json_object("_r", "$.put_options")
    paired = call.isNotNull() | put.isNotNull()
    flat = F.struct(F.coalesce(json_first(F.col("_r"), "$.option_type", "$.type"), F.lit("")).alias("side"), F.col("_r").alias("doc"))
    pair = F.filter(
        F.array(F.struct(F.lit("C").alias("side"), call.alias("doc")), F.struct(F.lit("P").alias("side"), put.alias("doc"))),
        lambda s: s["doc"].isNotNull() & (s["doc"] != "{}"),
    )
    sides = F.when(paired, pair).otherwise(F.array(flat))
    rows = rec.where("strike IS NOT NULL").select(*keep, "strike", F.explode(sides).alias("_s"))
    doc = F.col("_s.doc")
    return rows.select(
        *keep,
        "strike",
        F.col("_s.side").alias("option_type"),
        _field(doc, "iv", "implied_volatility").alias("iv"),
        *[_field(doc, g).alias(g) for g in ("delta", "gamma", "theta", "vega")],
        _field(doc, "last_price", "ltp").alias("last_price"),
        _field(doc, "volume", default=0.0).alias("volume"),
        _field(doc, "oi", "open_interest", default=0.0).alias("oi"),
    )


def records(df: DataFrame, payload: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Payload to records (a MAP per row): a list, ``data`` or ``instruments``, one object, or CSV text."""
    c = F.col(payload)
    is_json = F.ltrim(c).rlike(r"^[\[{]")
    from_list = F.from_json(_list_text(c, "$.data", "$.instruments"), "array<map<string,string>>")
    lines = F.filter(F.split(c, r"\r?\n"), lambda s: F.trim(s) != "")
    head = F.split(F.get(lines, F.lit(0)), ",")
    body = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), lambda s: F.map_from_arrays(head, F.split(s, ",")))
    from_csv = F.when(c.contains(","), body)
    return df.select(*keep, F.explode(F.when(is_json, from_list).otherwise(from_csv)).alias("record"))
