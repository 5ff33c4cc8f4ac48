"""The persisted tables: fixed column names and types, enumerations, and conform()."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns of each table, in order.
KLINES = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("market", T.StringType()),
    T.StructField("open_time", T.TimestampType()),
    T.StructField("close_time", T.TimestampType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
    T.StructField("quote_volume", T.DoubleType()),
    T.StructField("trades", T.LongType()),
    T.StructField("taker_buy_base", T.DoubleType()),
    T.StructField("taker_buy_quote", T.DoubleType()),
    T.StructField("ingested_at", T.TimestampType()),
    T.StructField("source", T.StringType()),
])

FUNDING = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("funding_time", T.TimestampType()),
    T.StructField("funding_rate", T.DoubleType()),
    T.StructField("mark_price", T.DoubleType()),
    T.StructField("ingested_at", T.TimestampType()),
    T.StructField("source", T.StringType()),
])

UNIVERSE_SNAPSHOT = T.StructType([
    T.StructField("as_of", T.TimestampType()),
    T.StructField("period_start", T.DateType()),
    T.StructField("period_end", T.DateType()),
    T.StructField("rank", T.ShortType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("api_symbol", T.StringType()),
    T.StructField("market", T.StringType()),
    T.StructField("base_asset", T.StringType()),
    T.StructField("quote_asset", T.StringType()),
    T.StructField("quote_volume_24h", T.DoubleType()),
    T.StructField("last_price", T.DoubleType()),
    T.StructField("trade_count_24h", T.LongType()),
    T.StructField("avg_trade_size", T.DoubleType()),
    T.StructField("listing_date", T.DateType()),
    T.StructField("spot_pairs", T.ArrayType(T.StringType())),
    T.StructField("primary_spot_quote_volume", T.DoubleType()),
    T.StructField("total_candidates", T.IntegerType()),
    T.StructField("min_listing_days_threshold", T.IntegerType()),
    T.StructField("method", T.StringType()),
    T.StructField("ingested_at", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("fapi_exchangeinfo_fetched_at", T.TimestampType()),
    T.StructField("fapi_ticker_fetched_at", T.TimestampType()),
    T.StructField("spot_exchangeinfo_fetched_at", T.TimestampType()),
    T.StructField("spot_ticker_fetched_at", T.TimestampType()),
])

REJECTED_CANDIDATES = T.StructType([
    T.StructField("as_of", T.TimestampType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("api_symbol", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("observed_value", T.DoubleType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("is_primary_reason", T.BooleanType()),
])

CORRECTIONS = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("market", T.StringType()),
    T.StructField("time", T.TimestampType()),
    T.StructField("field", T.StringType()),
    T.StructField("old_value", T.DoubleType()),
    T.StructField("new_value", T.DoubleType()),
    T.StructField("old_ingested_at", T.TimestampType()),
    T.StructField("new_ingested_at", T.TimestampType()),
])

QC_RUN = T.StructType([
    T.StructField("run_ts", T.TimestampType()),
    T.StructField("name", T.StringType()),
    T.StructField("passed", T.BooleanType()),
    T.StructField("severity", T.StringType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("market", T.StringType()),
    T.StructField("tier", T.StringType()),
    T.StructField("details_json", T.StringType()),
])

RUN_REGISTRY = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("strategy_id", T.StringType()),
    T.StructField("variant", T.StringType()),
    T.StructField("params_hash", T.StringType()),
    T.StructField("data_version", T.StringType()),
    T.StructField("archive_max_kline_time", T.TimestampType()),
    T.StructField("qc_audit_run_ts", T.TimestampType()),
    T.StructField("registered_at", T.TimestampType()),
    T.StructField("status", T.StringType()),
    T.StructField("verdict", T.StringType()),
    T.StructField("corrections_diff_status", T.StringType()),
    T.StructField("metrics_summary_json", T.StringType()),
])

BACKTEST_RESULT = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("strategy_id", T.StringType()),
    T.StructField("variant", T.StringType()),
    T.StructField("params_json", T.StringType()),
    T.StructField("params_hash", T.StringType()),
    T.StructField("universe_json", T.StringType()),
    T.StructField("start_time", T.TimestampType()),
    T.StructField("end_time", T.TimestampType()),
    T.StructField("n_bars", T.LongType()),
    T.StructField("data_version", T.StringType()),
    T.StructField("archive_max_kline_time", T.TimestampType()),
    T.StructField("qc_audit_run_ts", T.TimestampType()),
    T.StructField("engine_version", T.StringType()),
    T.StructField("computed_at", T.TimestampType()),
])

BACKTEST_LEG = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("time", T.TimestampType()),
    T.StructField("leg_id", T.ShortType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("market", T.StringType()),
    T.StructField("side", T.StringType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("notional", T.DoubleType()),
    T.StructField("leg_ret", T.DoubleType()),
    T.StructField("fees", T.DoubleType()),
    T.StructField("funding_paid", T.DoubleType()),
    T.StructField("slippage", T.DoubleType()),
])

PER_SYMBOL_CONTRIB = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("time", T.TimestampType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("contrib_pnl", T.DoubleType()),
    T.StructField("position_notional", T.DoubleType()),
    T.StructField("weight_net", T.DoubleType()),
])

EQUITY_CURVE = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("time", T.TimestampType()),
    T.StructField("equity", T.DoubleType()),
    T.StructField("period_ret_gross", T.DoubleType()),
    T.StructField("period_ret_net", T.DoubleType()),
    T.StructField("cumulative_pnl", T.DoubleType()),
])

OOS_RETURNS_PANEL = T.StructType([
    T.StructField("alpha_id", T.StringType()),
    T.StructField("time", T.TimestampType()),
    T.StructField("oos_ret", T.DoubleType()),
    T.StructField("alpha_active", T.BooleanType()),
])

REGIME_METRICS = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("regime_kind", T.StringType()),
    T.StructField("regime_label", T.StringType()),
    T.StructField("n_obs", T.LongType()),
    T.StructField("sharpe", T.DoubleType()),
    T.StructField("ann_return", T.DoubleType()),
    T.StructField("max_dd", T.DoubleType()),
    T.StructField("hit_rate", T.DoubleType()),
])

TRIAL_LOG = T.StructType([
    T.StructField("strategy_id", T.StringType()),
    T.StructField("trial_id", T.LongType()),
    T.StructField("params_hash", T.StringType()),
    T.StructField("params_json", T.StringType()),
    T.StructField("evaluated_at", T.TimestampType()),
    T.StructField("data_version", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("realized_sharpe", T.DoubleType()),
    T.StructField("n_obs", T.LongType()),
])

SPOT, PERP = "spot", "perp_usdt"
RUNNING, COMPLETE, VALIDATED, FAILED = "running", "complete", "validated", "failed"
ERROR, WARN, INFO = "ERROR", "WARN", "INFO"
SPLITS = ("train", "test", "oos", "full")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the columns of schema, in order, cast strictly (ANSI: overflow and bad text fail); a missing column fails here."""
    if missing := [c for c in schema.names if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
