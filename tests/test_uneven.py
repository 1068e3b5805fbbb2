"""Global and joint queries on suppliers of which one has no line in the first months."""

import random
from datetime import datetime

import pytest
from conftest import long_frame, month

from demandloom import catalog
from demandloom.config import BacktestConfig
from demandloom.models.factor import FactorModel
from demandloom.operators.windows import pin_calendar, window_calendar

catalog.load_all()
LATE = 2


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, months = random.Random(3), 60
    rows = [
        (supplier, datetime(month(m).year, month(m).month, 1 + rng.randrange(28)), float(rng.randint(1, 50)))
        for supplier in range(12)
        for m in range(LATE if supplier == 7 else 0, months)
        for _ in range(3)
    ]
    folder = str(tmp_path_factory.mktemp("uneven"))
    lines = spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp_ntz, l_quantity double")
    lines.write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_months_before_a_series_are_filled(spark):
    rng = random.Random(4)
    histories = {s: [10 + k + 5 * rng.random() for _ in range(48)] for k, s in enumerate("abcd")}
    histories["d"][:LATE] = [0.0] * LATE
    late = long_frame(spark, histories | {"d": histories["d"][LATE:]}, {"d": LATE})
    cfg = BacktestConfig(windows=3, retrain=2)
    calendar = pin_calendar(window_calendar(late, cfg))

    def found(model, series):
        rows = model.forecast(series, calendar, cfg).collect()
        return {(r["window"], r["series_id"], r["time_index"]): r["forecast"] for r in rows}

    filled = found(FactorModel(factors=2, before=0.0), late)
    assert len(filled) == 36
    assert filled == pytest.approx(found(FactorModel(factors=2), long_frame(spark, histories)), rel=1e-9)
    # cut where asked for, filled or not
    cut = found(FactorModel(factors=2, common_span=True), late)
    assert cut == found(FactorModel(factors=2, common_span=True, before=0.0), late) != filled


def test_fc_factor_forecasts_every_supplier(spark, tables):
    rows = catalog.QUERIES["fc_factor"](spark, tables).collect()
    assert len(rows) == 12 * 6 * 3 and all(r["forecast"] is not None for r in rows)


def test_global_backtest_scores_every_window(spark, tables):
    rows = catalog.QUERIES["global_backtest"](spark, tables).collect()
    assert {(r["window"], r["model"]) for r in rows} == {
        (w, m) for w in range(6) for m in ("GlobalDirect", "GlobalRecursive", "FactorModel")
    }


def test_global_backtest_complete_scores_every_pair(spark, tables):
    rows = catalog.QUERIES["global_backtest_complete"](spark, tables).collect()
    assert len(rows) == 24 and {r["n_pairs"] for r in rows} == {12 * 3}
