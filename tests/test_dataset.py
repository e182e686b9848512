import json

import numpy as np
import pytest

from tessera.sources import catalogs, dataset

DAYS = ["2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05"]


@pytest.fixture()
def root(tmp_path):
    def put(name, text):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)

    put("calendars/day.txt", "\n".join(DAYS))
    put("calendars/day_future.txt", "\n".join([*DAYS, "2024-01-08"]))
    put("instruments/all.txt", "SH600000 2024-01-02 2024-01-05\n000001.SZ 2024-01-03 2024-01-04\n")
    put("instruments/st.txt", "600000.SH 2024-01-03 2024-01-03\n")
    put("industry/I01.txt", "600000.SH 2024-01-02 2024-01-05\n")
    put("industry/I02.txt", "000001.SZ 2024-01-02 2024-01-05\n")
    put("industry_names.json", "﻿" + json.dumps({"schema_version": 1, "names": {"i01": " Banks "}}))
    put("stock_basic.csv", "ts_code,name,list_date\n600000.SH,A,20240101\n000001.SZ,B,2024-01-03\n")
    for code, field, v in [("600000.sh", "close", [0, 10, 11, np.nan, 13]), ("600000.sh", "factor", [0, 1, 1, 2, 2]), ("000001.sz", "close", [1, 5, 6])]:
        f = tmp_path / "features" / code / f"{field}.day.bin"
        f.parent.mkdir(parents=True, exist_ok=True)
        np.array(v, "<f4").tofile(f)
    return tmp_path


def rows(df):
    return sorted((r.instrument, str(r.datetime), *r[2:]) for r in df.collect())


def test_metadata(spark, root):
    d = dataset.init(spark, str(root))
    assert dataset.current() is d
    assert d.calendar(future=True).count() == 5 and d.calendar("2024-01-03", "2024-01-04").count() == 2
    assert d.markets() == ["all", "st"] and d.industries() == ["I01", "I02"]
    assert d.industry_names() == {"I01": "Banks", "I02": "I02"}
    assert d.fields() == ["close", "factor"] and d.fields(instrument="sz000001") == ["close"]
    assert d.fields("stock_basic") == ["ts_code", "name", "list_date"]
    assert [str(r.list_date) for r in d.stock_basic(["000001.SZ"]).collect()] == ["2024-01-03"]
    with pytest.raises(ValueError):
        d.fields("weekly")
    with pytest.raises(KeyError):
        d.universe("none")
    (root / "industry_names.json").unlink()
    (root / "industry" / "names.csv").write_text("index_code,industry_name\nI02,Ships\n")
    assert d.industry_names() == {"I01": "I01", "I02": "Ships"}
    assert d.universe("all").count() == 6
    (root / "instruments" / "new.txt").write_text("600000.SH 2024-01-02 2024-01-02\n")
    assert d.universe("new").count() == 0
    d.clear_cache()
    assert d.universe("new").count() == 1


def test_features(spark, root):
    d = dataset.Dataset(spark, str(root))
    got = rows(d.features("all", {"c": "$close", "st": "$is_st", "age": "$list_days"}, "2024-01-03", "2024-01-05"))
    a, b = "600000.SH", "000001.SZ"
    with pytest.raises(KeyError):
        d.features("all", {"c": "$volume"})
    want = [(a, "2024-01-03", 11.0, 1.0, 2.0), (a, "2024-01-04", None, 0.0, 3.0), (a, "2024-01-05", 26.0, 0.0, 4.0), (b, "2024-01-03", None, 0.0, 0.0), (b, "2024-01-04", None, 0.0, 1.0)]
    assert got == sorted(want)
    raw = rows(d.features(d.instruments("all", [{"filter_type": "STFilter"}]), {"c": "$close"}, adjust="none"))
    assert [r for r in raw if r[0] == b] == [(b, "2024-01-03", 5.0), (b, "2024-01-04", 6.0)]
    assert (a, "2024-01-03", 11.0) not in raw
    with pytest.raises(FileNotFoundError):
        dataset.Dataset(spark, str(root), missing="raise").panel("close")
    with pytest.raises(ValueError):
        dataset.Dataset(spark, str(root), missing="zero")


def test_strict_catalogs():
    for bad in ['{"a": 1, "a": 2}', '{"a": NaN}']:
        with pytest.raises(ValueError):
            catalogs.parse_json(bad)
    for bad in ["", "a,a\n1,2", "a,b\n1", 'a,b\n"1,2']:
        with pytest.raises(ValueError):
            catalogs.parse_csv(bad)
    for bad in ['{"schema_version": true, "names": {}}', '{"schema_version": 1}', '{"schema_version": 1, "names": {"a": 3}}', '{"schema_version": 1, "names": {"a": " "}}', '{"schema_version": 1, "names": {"a": "x", "A": "y"}}']:
        with pytest.raises(ValueError):
            catalogs.labels_of_json(bad)
    with pytest.raises(ValueError):
        catalogs.labels_of_csv("code,industry_name\nx,y")


def test_folder_names():
    got = catalogs.folder_names(["alpha", "Alpha", "a/b", "..", "CON", "alpha", ""])
    assert got["alpha"] == "alpha" and len(got) == 6
    assert len({v.lower() for v in got.values()}) == 6
    assert not any(c in v for v in got.values() for c in '<>:"/\\|?*')


def test_raw_tables(spark, tmp_path):
    from tessera.sources.raw import RawTables, Rule

    def put(name, text):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)

    put("daily/20240102.csv", "ts_code,close\n000001.SZ,1.5\n")
    put("trade_cal.csv", "exchange,cal_date,is_open\nSSE,20240101,0\nSSE,20240102,1\nSZSE,20240102,1\nSSE,20240103,1\n")
    put("industry.csv", "l1_code,l1_name,ts_code,is_new\nI1,Banks,000001.SZ,Y\nI1,Banks,000002.SZ,N\nI2,Ships,000003.SZ,Y\n")
    put("index_weight/X.SH/202401.csv", "con_code,trade_date\n000001.SZ,20240102\n000002.SZ,20240131\n")
    put("financial/fina_indicator/202403.csv", "ts_code,end_date,eps\n000001.SZ,20240331,1\n000001.SZ,20240330,2\n")
    put("own.csv", "a,b\n01,2\n")
    r = RawTables(spark, str(tmp_path), {"open_days": Rule("trade_cal.csv", {"open": "is_open"})})
    of = lambda *a, **k: sorted(tuple(x) for x in r.fetch(*a, **k).collect())
    assert of("daily", trade_date="20240102") == [("000001.SZ", "1.5")]
    assert of("trade_cal", "cal_date,none", exchange="SSE", start_date="20240102", end_date="20240103") == [("20240102",), ("20240103",)]
    assert of("index_classify") == [("I1", "Banks"), ("I2", "Ships")]
    assert of("index_member_all", "ts_code", l1_code="I1", is_new="Y") == [("000001.SZ",)]
    assert of("index_weight", "con_code", index_code="X.SH", start_date="20240101", end_date="20240115") == [("000001.SZ",)]
    assert of("fina_indicator_vip", "eps", period="20240331") == [("1",)]
    assert of("own") == [("01", "2")] and len(of("open_days", open="1")) == 3
    with pytest.raises(KeyError):
        r.fetch("daily")
    with pytest.raises(ValueError):
        r.fetch("daily", trade_date="../x")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        r.fetch("daily", trade_date="20240103")
