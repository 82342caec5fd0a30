"""Steps whose plans must stay linear in the rows."""

from tessera.operators import beats, intake


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_records_are_parsed_once(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": "x", "b": [1, "y", "z"]}'), (3, "{"), (4, None)], "id int, record string")
    report = intake.problem_report(intake.parted(rows, {"a": "int", "b": ["int"]})[1])
    assert plan(report).lower().count("parse_json(") + plan(report).count("parseJson") <= 1
    assert sorted(tuple(r) for r in report.collect() if r.field == "b[]") == [("b[]", "WRONG_TYPE", "STRING", 2, 1)]


def test_onset_arrays_are_not_sorted_with_the_beats(spark):
    b = spark.createDataFrame([(1, i, i * 0.5, 0.5) for i in range(6)], "track_id bigint, beat_index int, beat_time double, onset_unit double")
    onset = spark.createDataFrame([(1, [0.5] * 6)], "track_id bigint, values array<double>")
    lines = plan(beats.evaluate_grids(beats.octave_grids(b), onset, 1.7)).splitlines()
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    assert all(i > join for i, line in enumerate(lines) if "lead(" in line and "Window" in line)
