import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.functions import names, parse
from tidewater.operators import clean, diagnostics, infer, profile


def col(spark, values):
    return spark.createDataFrame([(v,) for v in values], "col string")


@pytest.mark.parametrize(
    ("values", "kind"),
    [
        (["On", "oFF", None, "N", "f"], "boolean"),
        ([" No", "", "T ", "    "], "boolean"),
        (["0", "1", None], "boolean"),
        (["7", "-31", "0"], "bigint"),
        (["$12", "8%", "1,0,0"], "bigint"),
        (["5.", "17.000"], "bigint"),
        (["9223372036854775807", "-9223372036854775808"], "bigint"),
        (["9223372036854775808"], "double"),
        (["0.125", "-3.5"], "double"),
        (["$7.25", "12.5%"], "double"),
        (["2024-02-29", "1999-12-31"], "timestamp"),
        (["29/02/2024", "02/03/2021"], "timestamp"),
        (["2021-06-15T10:00:00Z", "2021-06-15T10:00:00.5Z", "May 05, 2021"], "timestamp"),
        (["on", "maybe"], "string"),
        (["4.5", "nan"], "string"),
        (["1e5"], "string"),
        (["3", None, "0"], "bigint"),
        (["6", "0.5"], "double"),
        (["\t", " \n"], "string"),
        (["", "   ", None], "string"),
    ],
)
def test_inferred_types(spark, values, kind):
    assert clean.clean_all_types(col(spark, values)).dtypes == [("col", kind)]


ACCEPTED = {
    "2021-06-15T10:00:00Z": "2021-06-15 10:00:00",
    "2021-06-15T10:00:00.5Z": "2021-06-15 10:00:00.500000",
    "2021-06-15T10:00:00.123+05:30": "2021-06-15 04:30:00.123000",
    "2021-06-15T23:00:00-02:00": "2021-06-16 01:00:00",
    "2021-06-15T10:00:00": "2021-06-15 10:00:00",
    "2021-06-15T10:00:00.25": "2021-06-15 10:00:00.250000",
    "2021-06-15 10:00:00": "2021-06-15 10:00:00",
    "2021-06-15 10:00:00.125": "2021-06-15 10:00:00.125000",
    "2021-06-15": "2021-06-15 00:00:00",
    "13/01/2021": "2021-01-13 00:00:00",
    "02/03/2021": "2021-02-03 00:00:00",
    "13-01-2021": "2021-01-13 00:00:00",
    "06/15/2021 10:30:00": "2021-06-15 10:30:00",
    "2021/06/15": "2021-06-15 00:00:00",
    "20210615": "2021-06-15 00:00:00",
    "jan 05, 2021": "2021-01-05 00:00:00",
    "DEC 31, 2021": "2021-12-31 00:00:00",
    "05 May 2021": "2021-05-05 00:00:00",
    "March 15, 2023": "2023-03-15 00:00:00",
    "sePTember 01, 2023": "2023-09-01 00:00:00",
    " 2024-02-29 ": "2024-02-29 00:00:00",
}
REJECTED = [
    "2021-6-5", "1/2/2021", "Jan 5, 2021", "15 March 2023", "2021-06-15T10:00:00+0530", "2021-06-15T10:00:00.123456", "2021-06-15 10:00", "2021", "12345678", "20211315", "99999999", "02/30/2021",
    "0000-00-00", "2021-06-15t10:00:00", "2021-06-15T10:00:00z", "2021-06-15T10:00:00A", "2021-06-15T24:00:00", "2021-06-15 10:60:00", "2023-02-29", "13/13/2021", "13/01/2021 10:30:00", "Foo 05, 2021", "Marchy 05, 2021",
    "ebm 05, 2021", "2021-06-15 10:00:00Z", "", "today",
]


def test_dates_as_a_set(spark):
    """The accepted and the rejected texts of the format chain."""
    rows = col(spark, [*ACCEPTED, *REJECTED])
    got = {r[0]: r[1] for r in rows.select("col", parse.parse_date(F.col("col")).cast("timestamp_ntz")).collect()}
    assert {t: got[t] and str(got[t]) for t in ACCEPTED} == ACCEPTED
    assert [t for t in REJECTED if got[t] is not None] == []
    first = col(spark, ["02/03/2021", "13/01/2021", "01/13/2021", "02/30/2021"]).select(parse.parse_date(F.col("col"), dayfirst=True).cast("date").cast("string")).collect()
    assert [r[0] for r in first] == ["2021-03-02", "2021-01-13", "2021-01-13", None]


def test_free_dates(spark):
    got = [r[0] for r in col(spark, ["5th of March 2020", "2020", " ", None, "no date"]).select(parse.parse_free_date(F.col("col")).cast("timestamp_ntz")).collect()]
    assert got == [dt.datetime(2020, 3, 5), dt.datetime(2020, 1, 1), None, None, None]


def test_profiles(spark):
    rows = spark.createDataFrame([("\t12", "1.5", "x"), (" 300\n", "2", "\t"), ("\n", "", "y")], "a string, b string, c string")
    assert dict(clean.clean_all_types(rows).dtypes) == {"a": "string", "b": "double", "c": "string"}
    assert dict(clean.clean_all_types(rows, profile="pandas").dtypes) == {"a": "bigint", "b": "double", "c": "string"}
    assert [r["a"] for r in clean.clean_all_types(rows, profile="pandas").collect()] == [12, 300, None]
    holes = rows.union(spark.createDataFrame([(None, None, None)], rows.schema)).selectExpr("*", "cast(7 as bigint) as d", "cast(null as string) as e")
    assert dict(clean.clean_df(holes, profile="polars").dtypes) == {"a": "smallint", "b": "double", "c": "string", "d": "tinyint"}
    assert clean.clean_df(holes, profile="polars").count() == 4


def test_most_matches():
    rules = parse.type_rules(profile="polars")
    n = lambda b, i, f, d, every: {"non_null": every, "non_blank": every, "boolean": b, "integer": i, "float": f, "datetime": d}
    assert infer.most_matches(n(3, 3, 3, 0, 3), rules) == "boolean"
    assert infer.most_matches(n(1, 2, 3, 0, 3), rules) == "float" and infer.most_matches(n(0, 3, 3, 3, 3), rules) == "integer"
    assert infer.most_matches(n(1, 2, 2, 0, 3), rules) == "string" and infer.most_matches(n(0, 0, 0, 3, 3), rules) == "datetime"
    assert infer.most_matches(n(0, 0, 0, 0, 0), rules) == "string"


def test_rules_without_dates(spark):
    rules = [r for r in parse.type_rules() if r.name != "datetime"]
    assert infer.infer_types(col(spark, ["2021-06-15"]), rules) == {"col": "string"}
    assert infer.type_counts(col(spark, []))["col"]["non_null"] == 0 and infer.type_counts(spark.createDataFrame([(1,)], "n int")) == {}
    assert parse.parser_for("float", rules) is not None and parse.parser_for("datetime", rules) is None
    odd = spark.createDataFrame([("1",)], "`a.b``c` string")
    assert infer.conversion_failures(odd, {"a.b`c": "boolean"}) == {"a.b`c": 0}


def test_values_and_zones(spark):
    rows = col(spark, ["9007199254740993", "1.5", "x"])
    assert [r[0] for r in rows.select(parse.parse_integer(F.col("col"))).collect()] == [9007199254740993, None, None]
    zoned = col(spark, ["2023-12-31T23:59:59-05:00", "2023-12-31 23:59:59"])
    got = [r[0] for r in zoned.select(parse.parse_date(F.col("col"), "Asia/Tokyo").cast("timestamp_ntz")).collect()]
    assert got == [dt.datetime(2024, 1, 1, 4, 59, 59), dt.datetime(2023, 12, 31, 14, 59, 59)]
    with pytest.raises(Exception, match="not a integer"):
        rows.select(parse.parse_integer(F.col("col"), errors="raise")).collect()


def test_names():
    assert names.snake_name("with$Special#Chars") == "with_dollars_special_num_chars"
    assert names.pascal_name("with$Special#Chars") == "WithDollarsSpecialNumChars"
    assert [names.snake_name(n) for n in ("UserID", "Is Active?", "User&ID", "MixedCase", "Total$Amount")] == ["user_id", "is_active", "user_and_id", "mixed_case", "total_dollars_amount"]


def test_sampling_broadens(spark, caplog):
    rows = spark.createDataFrame([(str(i),) for i in range(99)] + [("99.5",)], "col string")
    out = clean.clean_all_types(rows, sampling=infer.Sampling(True, 0.5, 10, 100, 3))
    assert out.dtypes == [("col", "double")] and out.where("col IS NULL").count() == 0
    assert infer.broadened(rows, {"col": "integer"}) == {"col": "float"}


def test_clean_df_drops_empty(spark):
    rows = spark.createDataFrame([(31, "oak", None), (None, None, None), (17, "elm", None)], "tree int, kind string, void string")
    out = clean.clean_df(rows)
    assert out.columns == ["tree", "kind"] and out.count() == 2 and dict(out.dtypes)["tree"] == "bigint"
    nothing = clean.clean_df(spark.createDataFrame([(None,)], "a string"))
    assert nothing.columns == []


def test_hash_coalesce_narrow(spark):
    rows = spark.createDataFrame([("a", "b", 3), (None, "c", 300)], "x string, y string, n long")
    got = clean.hash_column(rows, ["x", "y"], "h").collect()
    assert got[0]["h"] == "da23614e02469a0d7c7bd1bdab5c9c474b1904dc" and got[1]["h"] is None
    with pytest.raises(ValueError):
        clean.hash_column(rows, [], "h")
    assert [r["x"] for r in clean.coalesce_columns(rows, ["x", "y"], "x", drop=True).collect()] == ["a", "c"]
    assert dict(clean.optimize_dtypes(rows).dtypes)["n"] == "smallint"


def test_profile(spark):
    rows = spark.createDataFrame([(k // 4, k % 4, k % 2, k) for k in range(12)], "shelf int, slot int, side int, box int")
    assert profile.unique_columns(rows) == ["box"]
    assert profile.unique_column_pairs(rows) == [("shelf", "slot")]
    table = spark.createDataFrame([("ash" if k % 5 else "fir", k % 3, k) for k in range(30)], "wood string, grade int, plank int")
    assert profile.categorical_columns(table, 0.2) == ["wood", "grade"] and profile.categorical_columns(table) == ["wood", "grade", "plank"]
    with pytest.raises(ValueError):
        profile.categorical_columns(table, 1.5)


def test_diagnostics(spark):
    rows = col(spark, ["61", "", "62", "none", None])
    d = diagnostics.conversion_diagnostics(rows, rows.select(parse.parse_integer(F.col("col")).alias("col")))["col"]
    assert (d.total_count, d.null_count, d.converted_count, d.failed_count, d.success_rate, d.failed_samples) == (5, 1, 2, 1, 66.67, ["none"])
