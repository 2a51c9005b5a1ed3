"""Folders of CSV files whose headers differ."""
import pytest

from telemetra import config as C
from telemetra.sources.readers import read_readings_csv

HEAD = "timestamp,device_id,temperature_celsius,humidity_percent,pressure_hpa,battery_level_percent"
SWAP = "timestamp,device_id,humidity_percent,temperature_celsius,pressure_hpa,battery_level_percent"


def write(folder, **files):
    for name, text in files.items():
        with open(f"{folder}/{name}.csv", "w") as f:
            f.write(text + "\n")


def test_another_order_of_columns_is_an_error_or_read_by_name(spark, tmp_out):
    write(tmp_out, a=f"{HEAD}\n2024-01-01 00:00:00,a,20.0,50.0,1000,90", b=f"{SWAP}\n2024-01-01 00:00:00,b,50.0,20.0,1000,90")
    with pytest.raises(Exception, match="(?i)header"):
        read_readings_csv(spark, tmp_out).collect()
    got = read_readings_csv(spark, tmp_out, mixed_headers=True).collect()
    assert {(r.device_id, r[C.TEMPERATURE], r[C.HUMIDITY]) for r in got} == {("a", 20.0, 50.0), ("b", 20.0, 50.0)}
    assert len({r[C.READING_ID] for r in got}) == 2


def test_missing_and_extra_columns(spark, tmp_out):
    write(tmp_out, a=f"{HEAD}\n2024-01-01 00:00:00,a,20.0,50.0,1000,90", b="device_id,timestamp,temperature_celsius,humidity_percent,site\nb,2024-01-02 00:00:00,1,2,north", c=f"{HEAD}\n2024-01-03 00:00:00,c,3,4,5,6")
    with pytest.raises(Exception):
        read_readings_csv(spark, tmp_out).collect()
    got = {r.device_id: r for r in read_readings_csv(spark, tmp_out, mixed_headers=True).collect()}
    assert (got["b"][C.TEMPERATURE], got["b"][C.HUMIDITY], got["b"][C.PRESSURE], got["b"].site) == (1.0, 2.0, None, "north")
    assert got["a"].site is None and got["c"][C.BATTERY] == 6.0


def test_one_header_over_many_files_and_pruned_columns(spark, tmp_out):
    write(tmp_out, **{f"f{k}": f"{HEAD}\n2024-01-01 00:00:00,d{k},{k},50.0,1000,90" for k in range(4)})
    df = read_readings_csv(spark, tmp_out)
    assert sorted(r[0] for r in df.select(C.TEMPERATURE).collect()) == [0.0, 1.0, 2.0, 3.0] and df.count() == 4
