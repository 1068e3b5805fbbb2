"""Settings shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class SeriesSpec:
    """Names of the key columns in a source table.

    Sources rename them to ``series_id``, ``time_index`` and ``value``; every operator
    downstream works on those three names.
    """

    series_id: str = "series_id"
    time_index: str = "time_index"
    value: str = "value"


@dataclass(frozen=True)
class BacktestConfig:
    """One backtest or tuning run.

    ``horizon`` is the number of months forecast per window and ``shift`` the planning lag
    between the base month and the first forecast month.  ``retrain`` is True (every window),
    False (first window only) or an int n (every n-th window).  ``drop_last_month`` says that the month
    of the latest line counts as unfinished: ``backtest_lines`` leaves it out of series and calendar.
    """

    horizon: int = 3
    shift: int = 1
    windows: int = 6
    tuning_windows: int = 1
    use_validation: bool = True
    retrain: bool | int = False
    start_date: date | None = None
    tuning_start_date: date | None = None
    drop_last_month: bool = True
    scale: bool = True
    use_static: bool = True
    use_past: bool = True
    use_future: bool = True
    decimals: int = 6
    random_state: int = 123

    def __post_init__(self) -> None:
        if self.horizon < 1 or self.windows < 1 or self.tuning_windows < 1 or self.shift < 0:
            raise ValueError("horizon and window counts must be positive and shift not negative")

    @property
    def train_lag(self) -> int:
        """Months between a window's base month and the end of its training data."""
        return self.horizon + 1 if self.use_validation else 1
