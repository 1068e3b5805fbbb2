"""Demand-forecast backtesting as Spark jobs."""

from demandloom.config import BacktestConfig, SeriesSpec

__all__ = ["BacktestConfig", "SeriesSpec"]
