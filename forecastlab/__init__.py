"""Spark-native preparation, backtesting and scoring of probabilistic power forecasts."""
