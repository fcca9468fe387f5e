"""What rules are judged on: closed trades with their set-up, market condition, account limits and the equity at entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bars import as_of

#: An equity older than this at a trade's entry is unknown, and the account's opening balance stands for it.
EQUITY_SECONDS = 8 * 86400


def session_floor(trades: DataFrame, most: int, until: str | None = None) -> DataFrame:
    """One row, ``floor``: the earliest of the newest ``most`` sessions of closed trades; NULL without any.

    Sessions are counted, not trades, so every session that is kept is whole."""
    t = trades.filter("closed_at is not null and session_date is not null")
    t = t if until is None else t.filter(F.col("session_date") <= F.to_date(F.lit(until)))
    newest = t.select("session_date").distinct().orderBy(F.desc("session_date")).limit(most)
    return newest.agg(F.min("session_date").alias("floor"))


def newest_sessions(trades: DataFrame, most: int, until: str | None = None) -> DataFrame:
    """Closed trades of the newest ``most`` sessions."""
    t = trades.filter("closed_at is not null")
    t = t if until is None else t.filter(F.col("session_date") <= F.to_date(F.lit(until)))
    return t.join(F.broadcast(session_floor(trades, most, until)), F.col("session_date") >= F.col("floor")).drop("floor")  # one row


def scan(
    trades: DataFrame, instruments: DataFrame, accounts: DataFrame, setups: DataFrame, conditions: DataFrame, equity: DataFrame, max_sessions: int | None = None
) -> DataFrame:
    """Closed trades with root_symbol, zone, setup, market_condition, max_daily_loss, account_equity and risk_pct_of_equity.

    trades: with account, instrument, setup_id, condition_id, opened_at, risk; instruments: (instrument, root_symbol, zone); accounts:
    (account, max_daily_loss, starting_balance); setups and conditions: (id, name); equity: (account, as_of, equity).  A trade
    without an instrument or account is left out, one without set-up or condition is not.  The equity is the latest at or before the entry; zero is
    an equity (the account is blown), and only an unknown one falls back to the starting balance.
    """
    t = trades.filter("closed_at is not null") if max_sessions is None else newest_sessions(trades, max_sessions)
    t = t.join(instruments.select("instrument", "root_symbol", "zone"), "instrument").join(accounts.select("account", "max_daily_loss", "starting_balance"), "account")
    t = t.join(setups.select(F.col("id").alias("setup_id"), F.col("name").alias("setup")), "setup_id", "left")
    t = t.join(conditions.select(F.col("id").alias("condition_id"), F.col("name").alias("market_condition")), "condition_id", "left")
    t = as_of(t, equity, "account", "opened_at", "as_of", "equity", EQUITY_SECONDS)
    held = F.coalesce("equity", "starting_balance").cast("double")
    share = F.when(held > 0, F.col("risk").cast("double") / held)
    return t.withColumns({"account_equity": held, "risk_pct_of_equity": share}).drop("equity", "value_ts", "starting_balance")
