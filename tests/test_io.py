import pytest

from lexiforge.session import scratch_path
from lexiforge.sources import io


def test_config_normalises_none_strings(spark):
    cfg = io.RunConfig.from_dict({"csv_path": "None", "tasks": [], "seq_len": 16, "label": None})
    assert cfg.csv_path is None and cfg.tasks == () and cfg.extra == {"label": None}
    t = io.config_table(spark, cfg)
    assert len(t.columns) == 5
    with pytest.raises(ValueError):
        io.RunConfig.from_dict({"splits": [0.5, 0.5, 0.5]})


def test_missing_dataset_path(spark):
    with pytest.raises(ValueError):
        io.read_corpus(spark, "/nonexistent/lexiforge/corpus")


def test_emissions_schema_round_trip(spark):
    assert len(io.EMISSIONS_SCHEMA.fields) == 31
    df = spark.createDataFrame([("p", "r", 1.5, 0.1)], "project_name string, run_id string, duration double, emissions double")
    path = scratch_path(spark, "emis-test")
    io.append_csv(io.to_emissions_schema(df), path)
    back = io.read_emissions(spark, path).first()
    assert back["duration"] == 1.5 and back["longitude"] is None
