from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelreg.sources.roles import RoleSchema, cast_roles, geography_columns, related_columns, select_features
from panelreg.sources.sinks import write_rows, write_small
from panelreg.sources.years import find_year, load_year, load_years, read_stata, require_years, split_years, stack_years


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "2010_clean.csv").write_text('ma_ho,Edu,Age\n1,"No ""formal"" school",41\n2,NA,#N/A\n3, Primary,\n')
    (tmp_path / "2010.csv").write_text("ma_ho\n9\n")
    (tmp_path / "2014.csv").write_text("ma_ho,Age,Tea\n1,40,1\n")
    pd.DataFrame(
        {"ma_ho": [1, 2], "Age": [30.5, None], "tinh": pd.Categorical(["Ha Tay", "Lao Cai"], categories=["Lao Cai", "Ha Tay"])}
    ).to_stata(tmp_path / "2016.dta", write_index=False)
    return str(tmp_path)


def test_the_cleaned_file_wins(spark, folder):
    assert find_year(spark, folder, 2010).endswith("2010_clean.csv")
    assert find_year(spark, folder, 2014).endswith("2014.csv")
    assert find_year(spark, folder, 2016).endswith("2016.dta")


def test_a_year_without_a_file_is_an_error(spark, folder):
    with pytest.raises(FileNotFoundError, match="2012"):
        load_year(spark, folder, 2012)


def test_csv_cells(spark, folder):
    rows = load_year(spark, folder, 2010).orderBy("ma_ho").collect()
    assert [r["Edu"] for r in rows] == ['No "formal" school', None, " Primary"]
    assert [r["Age"] for r in rows] == ["41", None, None] and rows[0]["survey_year"] == 2010


def test_stata_value_labels_become_levels(spark, folder):
    rows = load_year(spark, folder, 2016).orderBy("ma_ho").collect()
    assert [r["tinh"] for r in rows] == ["Ha Tay", "Lao Cai"] and [r["Age"] for r in rows] == ["30.5", None]


def test_a_folder_of_stata_parts_is_one_table(spark, tmp_path):
    parts = tmp_path / "2018.dta"
    parts.mkdir()
    for i in range(3):
        pd.DataFrame({"ma_ho": [i], f"only_{i}": [1.0]}).to_stata(parts / f"part{i}.dta", write_index=False)
    table = read_stata(spark, str(parts))
    assert table.count() == 3 and set(table.columns) == {"ma_ho", "only_0", "only_1", "only_2"}


def test_years_stack_with_missing_columns(spark, folder):
    panel = load_years(spark, folder, (2010, 2014))
    tea = {r["survey_year"]: r["Tea"] for r in panel.filter("ma_ho = '1'").collect()}
    assert tea == {2010: None, 2014: "1"}
    train, test = split_years(panel, (2010,), 2014)
    assert train.count() == 3 and test.count() == 1
    with pytest.raises(ValueError, match="2016"):
        require_years(panel, (2014, 2016))


def test_role_files_default_to_empty_roles(tmp_path):
    path = tmp_path / "roles.yaml"
    path.write_text("numeric:\n  - Age\n")
    assert RoleSchema.from_yaml(str(path)) == RoleSchema(numeric=("Age",))
    assert RoleSchema.from_mapping(None) == RoleSchema()


def test_feature_selection():
    roles = RoleSchema(("Age", "Wage", "Rain"), ("Kinh",), ("Edu", "xa"))
    columns = ["ma_ho", "AgrInc", "Age", "Wage", "Kinh", "Edu", "tinh", "quan", "xa"]
    plain = select_features(columns, roles, "AgrInc")
    assert plain.all == ("Age", "Wage", "Kinh", "Edu", "xa") and plain.missing == ("Rain",)
    strict = select_features(columns, roles, "AgrInc", exclude_related=True, geography="province")
    assert strict.all == ("Age", "Kinh", "Edu", "tinh") and strict.excluded == ("Wage",)
    assert select_features(columns, roles, "AgrInc", geography="none").categorical == ("Kinh", "Edu")
    assert select_features(columns, roles, "AgrInc", geography="commune").categorical == ("Kinh", "Edu", "xa", "tinh", "quan")
    assert select_features(columns, roles, "AgrInc", year_feature=True).categorical[-1] == "year"
    assert geography_columns("district") == ("tinh", "quan")
    with pytest.raises(ValueError, match="geography"):
        geography_columns("village")


@pytest.mark.parametrize(
    ("target", "flag", "banned"),
    [
        ("AgrInc", False, ("ma_ho",)),
        ("AgrInc", True, ("ma_ho", "TotalInc", "Wage", "CropInc", "CropValue")),
        ("CropInc", True, ("ma_ho", "TotalInc", "Wage", "AgrInc", "CropValue")),
        ("Other", True, ("ma_ho", "TotalInc", "Wage")),
    ],
)
def test_leakage_lists(target, flag, banned):
    assert related_columns(target, flag) == banned


def test_columns_outside_the_schema_pass_through(spark):
    frame = spark.createDataFrame([("x", "2", "1")], "free string, Age string, Kinh string")
    row = cast_roles(frame, RoleSchema(("Age", "gone"), ("Kinh",))).first()
    assert tuple(row) == ("x", 2.0, "1.0")


def test_sinks_overwrite(spark, tmp_path):
    table = spark.createDataFrame([("a", 1.5)], "feature string, coef double")
    for _ in range(2):
        write_small(table, str(tmp_path / "small"))
        write_rows(table, str(tmp_path / "rows"), "parquet", ("feature",))
    assert spark.read.csv(str(tmp_path / "small"), header=True).collect() == [("a", "1.5")]
    back = stack_years([spark.read.parquet(str(tmp_path / "rows"))])
    assert back.select("feature", "coef").collect() == [("a", 1.5)]


def test_sinks_keep_the_old_table_if_a_write_fails(spark, tmp_path):
    table = spark.createDataFrame([("a", 1.5)], "feature string, coef double")
    broken = table.select("feature", F.raise_error(F.lit("no")).cast("double").alias("coef"))
    for write in (write_small, write_rows):
        path = tmp_path / write.__name__
        write(table, str(path), "parquet")
        with pytest.raises(Exception, match="no"):
            write(broken, str(path), "parquet")
        assert [tuple(r) for r in spark.read.parquet(str(path)).collect()] == [("a", 1.5)]
        assert [p.name for p in tmp_path.iterdir() if p.name.startswith(path.name)] == [path.name]


def test_partitions_without_new_rows_stay(spark, tmp_path):
    path = str(tmp_path / "years")
    write_rows(spark.createDataFrame([(1, 2010), (2, 2012), (3, 2012)], "v int, year int"), path, "parquet", ("year",))
    write_rows(spark.createDataFrame([(4, 2012)], "v int, year int"), path, "parquet", ("year",))
    assert sorted(map(tuple, spark.read.parquet(path).select("v", "year").collect())) == [(1, 2010), (4, 2012)]
