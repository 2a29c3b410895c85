"""Causal signal and backtest analytics over long-format bar tables, on Spark DataFrames."""
