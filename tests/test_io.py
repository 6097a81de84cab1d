"""Readers and writers on real files."""

import gzip
import os
import random

import pytest
from pyspark.sql import functions as F

from skytally import schemas
from skytally.operators.observations import with_local_date
from skytally.sources import readers as R
from skytally.sources import sinks as W


def test_archive_tree(spark, tmp_path):
    for s in ("KAAA", "KBBB"):
        os.makedirs(tmp_path / s)
        (tmp_path / s / f"{s}_2024_metar.csv").write_text(
            f"station,valid,metar\n\n# note\n{s[1:]},2024-1-5 3:7,{s} 050307Z A, with, commas\n{s[1:]},not a time,X\n")
    all_ = R.scan_raw_observations(spark, str(tmp_path)).collect()
    assert len(all_) == 2 and all_[0].metar.endswith("A, with, commas") and all_[0].valid_utc.minute == 7
    assert [r.station for r in R.scan_raw_observations(spark, str(tmp_path), ["KBBB"]).collect()] == ["BBB"]
    (tmp_path / "one.csv").write_text("station,valid,metar\nAAA,2024-01-05 03:07,M\nAAA,2024-01-05 03:08,KAAA X M\nAAA,2024-01-05 03:09,\n")
    assert [(r.station, r.metar) for r in R.scan_archive_csv(spark, str(tmp_path / "one.csv"), "KAAA").collect()] == [("KAAA", "KAAA X M")]


def test_labelled_files_skip_features(spark, tmp_path):
    (tmp_path / "a.csv").write_text("daily_high_f,station,valid,metar\n90.5,KAAA,2024-01-05 03:07,x\n")
    (tmp_path / "a_features.csv").write_text("daily_high_f,station,valid,metar\n1.0,KAAA,2024-01-05 03:07,x\n")
    assert [r.daily_high_f for r in R.scan_labelled(spark, str(tmp_path)).collect()] == [90.5]


def test_wide_snapshots(spark, tmp_path):
    (tmp_path / "s.csv").write_text('city,kind,observed_at_utc,forecast_p01,forecast_p02,forecast_p1,observed_h01,extra\nX,Highest,2024-01-05T03:00:00Z,70,bad,1,NaN,9\nX,Highest,never,71,72,1,,9\n')
    rows = R.scan_wide_snapshots(spark, str(tmp_path / "s.csv"))
    assert rows.columns == ["city", "kind", "observed_at_utc", "forecast_p01", "forecast_p02", "observed_h01"]
    assert [(r.forecast_p01, r.forecast_p02, r.observed_h01, r.observed_at_utc is None) for r in rows.collect()] == [(70.0, None, None, False), (71.0, 72.0, None, True)]


def test_ledger_round_trip(spark, tmp_path):
    path = str(tmp_path / "none.csv")
    assert R.scan_ledger(spark, path).count() == 0
    (tmp_path / "l.csv").write_text("﻿trade_id,status,position_side,shares,yes_price\nt1,OPEN,,,\nt2,SOLD,NO,5,0.4\n")
    df = R.scan_ledger(spark, str(tmp_path / "l.csv"))
    a, b = df.orderBy("trade_id").collect()
    assert (a.position_side, a.shares, a.yes_price, a.pnl_usdc) == ("YES", 0.0, None, 0.0) and (b.position_side, b.shares, b.yes_price) == ("NO", 5.0, 0.4)
    W.write_ledger(df, str(tmp_path / "out"), [f.name for f in schemas.LEDGER.fields])
    again = R.scan_ledger(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, df.collect()))


def test_calibration_and_predictions_checks(spark, tmp_path):
    (tmp_path / "c.csv").write_text("station,month,local_hour,rows,error_mean_f,error_std_f,error_robust_sigma_f\nkaus,7,15,100,0.1,1.5,0\n")
    r = R.scan_calibration(spark, str(tmp_path / "c.csv")).first()
    assert (r.station, r.error_sigma_f, r.error_median_f) == ("KAUS", 1.5, 0.1)
    with pytest.raises(ValueError):
        R.scan_calibration(spark, str(tmp_path / "c.csv"), "absent")
    (tmp_path / "p.csv").write_text("station,local_hour,actual_high_f,predicted_high_f,error_f,abs_error_f\nK,9,90,91,1,1\n")
    assert R.scan_predictions(spark, str(tmp_path / "p.csv"), [9]).count() == 1
    with pytest.raises(ValueError):
        R.scan_predictions(spark, str(tmp_path / "p.csv"), [3])


def test_capture_and_logs(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"event_type":"websocket_raw","received_ms":5,"raw":"[]"}\n{"event_type":"recv_error","error":"x"}\n')
    assert sorted(r.event_type for r in R.scan_capture(spark, str(tmp_path / "c.jsonl")).collect()) == ["recv_error", "websocket_raw"]
    with gzip.open(tmp_path / "a.log.gz", "wb") as f:
        f.write(b"2024-01-05 03:00:00 x \xff\n")
    assert R.scan_logs(spark, str(tmp_path / "a.log.gz")).first().value.endswith("�")


def test_sinks(spark, views, tmp_path):
    obs = with_local_date(views.obs).select("station", "local_date", "seq", F.lit(0.1).alias("x"), F.lit("train").alias("split"), F.hour("local_ts").alias("local_hour"))
    W.write_by_station(obs, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == obs.count()
    with pytest.raises(Exception):
        W.write_by_station(obs, str(tmp_path / "t"))
    W.write_by_station(obs, str(tmp_path / "t"), overwrite=True)
    W.write_hour_extracts(obs.drop("local_date"), str(tmp_path / "h"))
    files = [f for _, _, fs in os.walk(tmp_path / "h") for f in fs if f.endswith(".csv.gz")]
    assert files and spark.read.csv(str(tmp_path / "h"), header=True).count() == obs.count()
    W.write_feature_text(obs.select("station", "x"), str(tmp_path / "f"), ["x"])
    assert spark.read.csv(str(tmp_path / "f"), header=True).first().x == "0.1"
    W.write_report(obs.groupBy("station").count(), str(tmp_path / "r"), "json")
    assert len([f for f in os.listdir(tmp_path / "r") if f.startswith("part-")]) == 1


def test_six_digits(spark):
    vals = [0.1, 100000.0, 1234567.0, 0.00001234, -2.5, 0.0, 1000.625, 99.99995, 123456.5, 123457.5, 1e-4, 9.9999999e-05, 999999.7, 2.675, 0.1234565, -99.99995, None]
    rnd = random.Random(5)
    vals += [rnd.randrange(10**7) / 10 ** rnd.randrange(8) for _ in range(3000)] + [rnd.randrange(10**6) * 10 ** -rnd.randrange(3, 7) + 5 * 10.0 ** -7 for _ in range(500)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "x double").select(W.six_digits(F.col("x"))).collect()]
    assert got == ["" if v is None else f"{v:.6g}" for v in vals]
