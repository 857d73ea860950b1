"""Queries over the star-schema tables, each with its SQL.

The tables are clean, so dirty text is derived from them, by integer arithmetic that both
engines print alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, parse
from ..operators import clean, diagnostics, infer, overlap, profile, sync, validate
from ..sources import catalog, jdbc
from ..streaming import clean_stream
from . import ddl

#: Columns that mean the same in Spark SQL and in the SQL of the checks.
_DIRTY = {
    "Order ID": "cast(l_orderkey as string)",
    "Quantity?": "concat(cast(cast(l_quantity as bigint) as string), case when l_linenumber % 3 = 0 then '.00' else '' end)",
    "Unit$Price": "concat('$', cast(cast(floor(cast(round(l_extendedprice * 100) as bigint) / 100.0) as bigint) as string), '.', lpad(cast(cast(round(l_extendedprice * 100) as bigint) % 100 as string), 2, '0'))",
    "Discount": "case when l_linenumber = 7 then '  ' else concat(cast(cast(round(l_discount * 100) as bigint) as string), '%') end",
    "IsReturned": "case l_returnflag when 'R' then 'Yes' when 'A' then 'no' else ' F ' end",
    "shipMode": "case when l_orderkey % 10 = 0 then 'N/A' else concat(cast(l_linenumber as string), ',000') end",
}
_SHIP = {"Ship Date": ("date_format(l_shipdate, 'MM/dd/yyyy')", "strftime(l_shipdate, '%m/%d/%Y')")}
_CTE = "d AS (SELECT " + ", ".join([f'{e} AS "{c}"' for c, e in _DIRTY.items()] + [f'{e[1]} AS "{c}"' for c, e in _SHIP.items()] + ["NULL::VARCHAR AS \"Empty\""]) + " FROM lineitem)"
_NUM = "regexp_replace({c}, '[$%,]', '', 'g')"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem")
    cols = [F.expr(e).alias(c) for c, e in _DIRTY.items()] + [F.expr(e[0]).alias(c) for c, e in _SHIP.items()]
    return rows.select(*cols, F.lit(None).cast("string").alias("Empty"))


def _ntz(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(f"`{c}`") for c, t in df.dtypes])


def _one(spark: SparkSession, names_: list[str], column: str = "column_name") -> DataFrame:
    return spark.createDataFrame([(n,) for n in names_], f"{column} string")


def q_rename_snake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.snake_columns(_dirty(spark, sf_dir))


def q_rename_pascal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.pascal_columns(_dirty(spark, sf_dir))


def _parsed(column: str, fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _ntz(_dirty(spark, sf_dir).select(F.col("`Order ID`").alias("id"), fn(F.col(f"`{column}`")).alias("value")))

    return run


def q_parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    text = F.expr("case o_orderkey % 6 when 0 then date_format(o_orderdate, 'yyyy-MM-dd') when 1 then date_format(o_orderdate, 'MM/dd/yyyy') when 2 then date_format(o_orderdate, 'yyyyMMdd') when 3 then concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T10:30:00') when 4 then date_format(o_orderdate, 'yyyy/MM/dd') else 'soon' end")
    return _ntz(o.select("o_orderkey", parse.parse_date(text).alias("value")))


def q_parse_date_tz(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders")
    text = F.expr("case when o_orderkey % 2 = 0 then concat(date_format(o_orderdate, 'yyyy-MM-dd'), 'T23:59:59-05:00') else concat(date_format(o_orderdate, 'yyyy-MM-dd'), ' 12:00:00') end")
    return _ntz(o.select("o_orderkey", parse.parse_date(text, "Asia/Tokyo").alias("value")))


def q_infer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = infer.type_counts(_dirty(spark, sf_dir))
    rows = [(c, n["non_null"], n["non_blank"], n["boolean"], n["integer"], n["float"]) for c, n in got.items()]
    return spark.createDataFrame(rows, "column_name string, non_null long, non_blank long, n_boolean long, n_integer long, n_float long")


def q_infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(infer.infer_types(_dirty(spark, sf_dir)).items()), "column_name string, data_type string")


def q_fallback_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = {"Order ID": "boolean", "Unit$Price": "integer", "shipMode": "integer", "Ship Date": "datetime", "IsReturned": "boolean"}
    return spark.createDataFrame(list(infer.broadened(_dirty(spark, sf_dir), guess).items()), "column_name string, data_type string")


def q_conversion_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = {"shipMode": "integer", "IsReturned": "boolean", "Discount": "float", "Unit$Price": "integer"}
    return spark.createDataFrame(list(infer.conversion_failures(_dirty(spark, sf_dir), types).items()), "column_name string, failures long")


def q_clean_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_numbers(_dirty(spark, sf_dir).select(F.col("`Order ID`").alias("id"), F.col("`Quantity?`").alias("quantity"), F.col("`Unit$Price`").alias("price"), "Discount"))


def q_clean_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(clean.clean_dates(_dirty(spark, sf_dir).select(F.col("`Order ID`").alias("id"), F.col("`Ship Date`").alias("ship")), ["ship"]))


def q_clean_bools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_bools(_dirty(spark, sf_dir).select(F.col("`Order ID`").alias("id"), "IsReturned"), ["IsReturned"])


def q_clean_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_series(_dirty(spark, sf_dir).select(F.col("`Order ID`").alias("id"), "shipMode"), "shipMode", parse.parse_integer)


def q_clean_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(names.snake_columns(clean.clean_df(_dirty(spark, sf_dir))))


def q_clean_all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(names.snake_columns(clean.clean_all_types(_dirty(spark, sf_dir).drop("Empty"))))


def q_sampled_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(names.snake_columns(clean.clean_df(_dirty(spark, sf_dir), sampling=infer.Sampling(True, 0.2, 100, 100_000, 7))))


def q_stream_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dirty(spark, sf_dir).drop("Empty")
    return _ntz(names.snake_columns(clean_stream.apply_types(rows, clean_stream.learn_types(rows))))


def q_drop_empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    hole = F.col("c_custkey") % 3 == 0
    return clean.drop_empty_rows(c.select(*[F.when(~hole, F.col(x)).alias(x) for x in ("c_custkey", "c_name")]))


def q_drop_empty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_empty_columns(_read(spark, sf_dir, "customer").select("c_custkey", F.lit(None).cast("string").alias("gone"), "c_name"))


def q_optimize_dtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.optimize_dtypes(_read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("l_linenumber")))


def q_hash_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("c_name"))
    return clean.hash_column(c, ["c_custkey", "c_name"], "digest")


def q_coalesce_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("a"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("b"))
    return clean.coalesce_columns(c, ["a", "b"], "label", drop=True)


def q_unique_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, profile.unique_columns(_read(spark, sf_dir, "supplier")))


def q_unique_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = profile.unique_column_pairs(_read(spark, sf_dir, "conversations"))
    return spark.createDataFrame(pairs, "first_column string, second_column string")


def q_empty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, profile.empty_columns(_dirty(spark, sf_dir)))


def q_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, profile.categorical_columns(_read(spark, sf_dir, "customer"), 0.1))


def q_column_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.metadata_frame(_read(spark, sf_dir, "part"), primary_key="p_partkey").select("column_name", "data_type", "is_id", "is_empty", "max_str_size", "float_precision", "biggest_num", "smallest_num")


def q_conversion_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dirty(spark, sf_dir).select("shipMode", "Discount")
    done = rows.select(parse.parse_integer(F.col("shipMode")).alias("shipMode"), parse.parse_float(F.col("Discount")).alias("Discount"))
    got = diagnostics.conversion_diagnostics(rows, done).values()
    return spark.createDataFrame([(d.column_name, d.total_count, d.null_count, d.converted_count, d.failed_count, d.success_rate) for d in got], "column_name string, total_count long, null_count long, converted_count long, failed_count long, success_rate double")


def q_failed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.failed_frame(_dirty(spark, sf_dir), "shipMode", "bigint")


def _stage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    target = c.where("c_custkey % 5 <> 0")
    changed = F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit("!"))).when(F.col("c_custkey") % 9 == 0, F.lit(None)).otherwise(F.col("c_name"))
    return target, c.where("c_custkey % 3 <> 0").withColumn("c_name", changed)


def _merge(delete: bool):
    return lambda spark, sf_dir: sync.merge(*_stage(spark, sf_dir), "c_custkey", delete_unmatched=delete)


def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.upsert(*_stage(spark, sf_dir), "c_custkey")


def q_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.append(*_stage(spark, sf_dir))


def q_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _stage(spark, sf_dir)
    return a.intersect(b)


def q_load_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jdbc.union_rows(_read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: _read(spark, sf_dir, t).select(*c) for t, c in {"customer": ("c_custkey", "c_nationkey", "c_mktsegment"), "orders": ("o_custkey", "o_orderstatus"), "nation": ("n_nationkey", "n_regionkey"), "region": ("r_regionkey", "r_name")}.items()}


def q_schema_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.similarities(_tables(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


def q_column_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    return overlap.table_similarities(("customer", t["customer"]), ("orders", t["orders"]))[0].withColumn("similarity", F.round("similarity", 6))


def q_same_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e, l = (_read(spark, sf_dir, t) for t in ("documents", "embeddings", "labels"))
    return overlap.same_names({"documents": d, "embeddings": e, "labels": l})


def q_unshared(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    return overlap.unshared(t, overlap.similarities(t))


def q_ddl_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ddl.ddl_types(_read(spark, sf_dir, "customer"), ddl.MSSQL)


def q_catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.column_types(_read(spark, sf_dir, "supplier"))


def q_catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists a schema with two tables and a view, made for this query and dropped again."""
    spark.sql("CREATE DATABASE IF NOT EXISTS tidewater_listing")
    try:
        for table in ("nation", "region"):
            spark.sql(f"CREATE TABLE IF NOT EXISTS tidewater_listing.{table} ({', '.join(f'{c} {t}' for c, t in _read(spark, sf_dir, table).dtypes)}) USING parquet")
        spark.sql("CREATE OR REPLACE VIEW tidewater_listing.both AS SELECT * FROM tidewater_listing.nation")
        return _one(spark, catalog.list_tables(spark, "tidewater_listing"), "table_name")
    finally:
        spark.sql("DROP DATABASE tidewater_listing CASCADE")


def q_distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.distinct_values(_read(spark, sf_dir, "customer"), "c_mktsegment")


def _info(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("c_custkey", "int", None, 10), ("c_name", "varchar", 5, None), ("c_acctbal", "int", None, 10), ("c_nationkey", "int", None, 1)], validate.INFO)


def q_validate_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.violations(_read(spark, sf_dir, "customer"), _info(spark))


def q_validate_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, validate.extra_columns(_read(spark, sf_dir, "customer"), _info(spark)))


def q_validate_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = spark.createDataFrame([("c_custkey", "int", None, 10), ("c_name", "varchar", 25, None), ("c_nationkey", "int", None, 10), ("c_acctbal", "decimal", None, 12), ("c_mktsegment", "varchar", 10, None)], validate.INFO)
    customer = _read(spark, sf_dir, "customer")
    validate.validate(customer, info)  # raises nothing
    return validate.fits(customer, info)


def q_null_or_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dirty(spark, sf_dir).select(F.col("`Order ID`").alias("id"), parse.is_blank(F.col("Discount")).alias("blank"))


_BOOL = "CASE WHEN lower(trim({c})) IN ('y','yes','t','true','on','1') THEN true WHEN lower(trim({c})) IN ('n','no','f','false','off','0') THEN false END"
_INT = "CASE WHEN regexp_matches(" + _NUM.format(c="trim({c})") + ", '^-?[0-9]+(\\.0*)?$') THEN try_cast(regexp_extract(" + _NUM.format(c="trim({c})") + ", '^-?[0-9]+') AS BIGINT) END"
_FLT = "try_cast(" + _NUM.format(c="trim({c})") + " AS DOUBLE)"
_DATE = "try_strptime({c}, '%m/%d/%Y')"


def _sel(expr: str, column: str) -> str:
    return f'WITH {_CTE} SELECT "Order ID" AS id, {expr.format(c=chr(34) + column + chr(34))} AS value FROM d'


_SNAKE = ", ".join(f'"{c}" AS {names.snake_name(c)}' for c in [*_DIRTY, *_SHIP, "Empty"])
_PASCAL = ", ".join(f'"{c}" AS "{names.pascal_name(c)}"' for c in [*_DIRTY, *_SHIP, "Empty"])
_TYPED = ", ".join([_INT.format(c='"Order ID"') + " AS order_id", _INT.format(c='"Quantity?"') + " AS quantity", _FLT.format(c='"Unit$Price"') + " AS unit_dollars_price", _INT.format(c='"Discount"') + " AS discount", _BOOL.format(c='"IsReturned"') + " AS is_returned", '"shipMode" AS ship_mode', _DATE.format(c='"Ship Date"') + " AS ship_date"])
_STAGE = "t AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 5 <> 0), s AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name || '!' WHEN c_custkey % 9 = 0 THEN NULL ELSE c_name END AS c_name, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0)"
_CELLS = {"customer": ("c_custkey:bigint", "c_nationkey:int", "c_mktsegment:string"), "orders": ("o_custkey:bigint", "o_orderstatus:string"), "nation": ("n_nationkey:int", "n_regionkey:int"), "region": ("r_regionkey:int", "r_name:string")}


def _overlap_sql(tables: list[str]) -> str:
    cells = " UNION ".join(f"SELECT '{t}' AS t, {k} AS o, '{c.split(':')[0]}' AS c, '{c.split(':')[1]}' AS d, CAST({c.split(':')[0]} AS VARCHAR) AS v FROM {t} WHERE {c.split(':')[0]} IS NOT NULL" for k, t in enumerate(tables) for c in _CELLS[t])
    return f"WITH x AS ({cells}), n AS (SELECT t, c, count(*) AS n FROM x GROUP BY ALL), p AS (SELECT a.t AS st, a.c AS sc, b.t AS tt, b.c AS tc, a.d AS d, count(*) AS k FROM x a JOIN x b ON a.d = b.d AND a.v = b.v AND a.o < b.o GROUP BY ALL), r AS (SELECT st AS source_table, sc AS source_column, tt AS target_table, tc AS target_column, p.d AS data_type, round(k / least(m.n, q.n), 6) AS similarity FROM p JOIN n m ON m.t = st AND m.c = sc JOIN n q ON q.t = tt AND q.c = tc WHERE k / least(m.n, q.n) >= 0.8)"


def _merged_sql(delete: bool) -> str:
    rest = ("c_name", "c_mktsegment")
    differs = " OR ".join(f"coalesce(t.{c} <> s.{c}, false) OR (t.{c} IS NULL AND s.{c} IS NOT NULL)" for c in rest)
    cols = ", ".join(f"CASE WHEN t.c_custkey IS NULL OR (s.c_custkey IS NOT NULL AND ({differs})) THEN s.{c} ELSE t.{c} END AS {c}" for c in ("c_custkey", *rest))
    return f"WITH {_STAGE} SELECT {cols} FROM t FULL OUTER JOIN s ON t.c_custkey = s.c_custkey" + " WHERE s.c_custkey IS NOT NULL" * delete


def _counts_sql() -> str:
    parts = []
    for c in [*_DIRTY, *_SHIP, "Empty"]:
        q = f'"{c}"'
        fit = lambda e: f"count(*) FILTER ({q} IS NOT NULL AND (trim({q}) = '' OR {e}))"
        num = _NUM.format(c=f"trim({q})")
        parts.append(f"SELECT '{c}' AS column_name, count({q}) AS non_null, count(*) FILTER (trim({q}) <> '') AS non_blank, {fit('(' + _BOOL.format(c=q) + ') IS NOT NULL')} AS n_boolean, {fit('(' + _INT.format(c=q) + ') IS NOT NULL')} AS n_integer, {fit(f'regexp_matches({num}, ' + chr(39) + '^-?[0-9]+\\.?[0-9]*$' + chr(39) + ')')} AS n_float FROM d")
    return f"WITH {_CTE} " + " UNION ALL ".join(parts)


def _types_sql(tries: dict[str, tuple[str, ...]]) -> str:
    """The first of the types that every value of a column fits, counted over all rows."""
    parts = []
    for c, types in tries.items():
        q = f'"{c}"'
        fit = {"boolean": f"({_BOOL.format(c=q)}) IS NOT NULL", "integer": f"({_INT.format(c=q)}) IS NOT NULL", "float": f"regexp_matches({_NUM.format(c=f'trim({q})')}, '^-?[0-9]+\\.?[0-9]*$')", "datetime": f"{_DATE.format(c=q)} IS NOT NULL"}
        cases = " ".join(f"WHEN count(*) FILTER (trim({q}) <> '') > 0 AND count(*) FILTER ({q} IS NOT NULL AND trim({q}) <> '' AND NOT coalesce({fit[t]}, false)) = 0 THEN '{t}'" for t in types)
        parts.append(f"SELECT '{c}' AS column_name, CASE {cases} ELSE 'string' END AS data_type FROM d")
    return f"WITH {_CTE} " + " UNION ALL ".join(parts)


def _pairs_sql(table: str, columns: tuple[str, ...]) -> str:
    """Pairs of columns with as many distinct values as rows, of columns that don't have as many alone."""
    alone = ", ".join(f"count(DISTINCT struct_pack(v := {c})) = count(*) AS u_{c}" for c in columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    each = ", ".join(f"count(DISTINCT struct_pack(v := {a}, w := {b})) = count(*) AS p_{a}_{b}" for a, b in pairs)
    rows = " UNION ALL ".join(f"SELECT '{a}' AS first_column, '{b}' AS second_column FROM s WHERE p_{a}_{b} AND NOT u_{a} AND NOT u_{b}" for a, b in pairs)
    return f"WITH s AS (SELECT {alone}, {each} FROM {table}) {rows}"


QUERIES = {
    "rename_snake": q_rename_snake,
    "rename_pascal": q_rename_pascal,
    "parse_boolean": _parsed("IsReturned", parse.parse_boolean),
    "parse_integer": _parsed("shipMode", parse.parse_integer),
    "parse_float": _parsed("Unit$Price", parse.parse_float),
    "strip_numeric": _parsed("Unit$Price", parse.strip_numeric),
    "parse_date": q_parse_date,
    "parse_date_tz": q_parse_date_tz,
    "null_or_blank": q_null_or_blank,
    "infer_counts": q_infer_counts,
    "infer_types": q_infer_types,
    "fallback_types": q_fallback_types,
    "conversion_failures": q_conversion_failures,
    "clean_numbers": q_clean_numbers,
    "clean_dates": q_clean_dates,
    "clean_bools": q_clean_bools,
    "clean_series": q_clean_series,
    "clean_all_types": q_clean_all_types,
    "clean_df": q_clean_df,
    "sampled_inference": q_sampled_inference,
    "stream_types": q_stream_types,
    "drop_empty_rows": q_drop_empty_rows,
    "drop_empty_columns": q_drop_empty_columns,
    "optimize_dtypes": q_optimize_dtypes,
    "hash_column": q_hash_column,
    "coalesce_columns": q_coalesce_columns,
    "unique_columns": q_unique_columns,
    "unique_column_pairs": q_unique_pairs,
    "empty_columns": q_empty_columns,
    "categorical_columns": q_categorical,
    "column_metadata": q_column_metadata,
    "conversion_diagnostics": q_conversion_diagnostics,
    "failed_samples": q_failed_samples,
    "merge_full": _merge(True),
    "merge_no_delete": _merge(False),
    "upsert": q_upsert,
    "append_except": q_append,
    "intersect_rows": q_intersect,
    "load_union_dedup": q_load_union,
    "column_overlap": q_column_overlap,
    "schema_overlap": q_schema_overlap,
    "same_name_columns": q_same_names,
    "unique_to_table": q_unshared,
    "ddl_types": q_ddl_types,
    "catalog_columns": q_catalog_columns,
    "catalog_tables": q_catalog_tables,
    "distinct_values": q_distinct_values,
    "validate_ok": q_validate_ok,
    "validate_types": q_validate_types,
    "validate_extra_columns": q_validate_extra,
}

SQL = {
    "rename_snake": f"WITH {_CTE} SELECT {_SNAKE} FROM d",
    "rename_pascal": f"WITH {_CTE} SELECT {_PASCAL} FROM d",
    "parse_boolean": _sel(_BOOL, "IsReturned"),
    "parse_integer": _sel(_INT, "shipMode"),
    "parse_float": _sel(_FLT, "Unit$Price"),
    "strip_numeric": _sel(_NUM, "Unit$Price"),
    "parse_date": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 3 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 630 MINUTE WHEN 5 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS value FROM orders",
    "parse_date_tz": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 104399 SECOND ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 3 HOUR END AS value FROM orders",
    "null_or_blank": f'WITH {_CTE} SELECT "Order ID" AS id, "Discount" IS NULL OR trim("Discount") = \'\' AS blank FROM d',
    "infer_counts": _counts_sql(),
    "infer_types": _types_sql({c: ("boolean", "integer", "float", "datetime") for c in [*_DIRTY, *_SHIP, "Empty"]}),
    "fallback_types": _types_sql({"Order ID": ("boolean", "integer", "float"), "Unit$Price": ("integer", "float"), "shipMode": ("integer", "float"), "Ship Date": ("datetime",), "IsReturned": ("boolean", "integer", "float")}),
    "conversion_failures": f"WITH {_CTE} SELECT 'shipMode' AS column_name, count(*) FILTER (\"shipMode\" = 'N/A') AS failures FROM d UNION ALL SELECT 'IsReturned', 0 UNION ALL SELECT 'Discount', 0 UNION ALL SELECT 'Unit$Price', count(*) FILTER (\"Unit$Price\" NOT LIKE '%.00') FROM d",
    "clean_numbers": f'WITH {_CTE} SELECT {_INT.format(c=chr(34) + "Order ID" + chr(34))} AS id, {_INT.format(c=chr(34) + "Quantity?" + chr(34))} AS quantity, {_FLT.format(c=chr(34) + "Unit$Price" + chr(34))} AS price, {_INT.format(c=chr(34) + "Discount" + chr(34))} AS "Discount" FROM d',
    "clean_dates": f'WITH {_CTE} SELECT "Order ID" AS id, {_DATE.format(c=chr(34) + "Ship Date" + chr(34))} AS ship FROM d',
    "clean_bools": f'WITH {_CTE} SELECT "Order ID" AS id, {_BOOL.format(c=chr(34) + "IsReturned" + chr(34))} AS "IsReturned" FROM d',
    "clean_series": f'WITH {_CTE} SELECT "Order ID" AS id, {_INT.format(c=chr(34) + "shipMode" + chr(34))} AS "shipMode" FROM d',
    **{k: f"WITH {_CTE} SELECT {_TYPED} FROM d" for k in ("clean_all_types", "clean_df", "sampled_inference", "stream_types")},
    "drop_empty_rows": "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0",
    "drop_empty_columns": "SELECT c_custkey, c_name FROM customer",
    "optimize_dtypes": "SELECT l_orderkey::INT AS l_orderkey, l_suppkey::SMALLINT AS l_suppkey, l_linenumber::TINYINT AS l_linenumber FROM lineitem",
    "hash_column": "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 7 <> 0 THEN sha1(CAST(c_custkey AS VARCHAR) || c_name) END AS digest FROM customer",
    "coalesce_columns": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS label FROM customer",
    "unique_columns": "SELECT column_name FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS d, count(*) AS n FROM supplier" for c in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")) + ") WHERE d = n",
    "unique_column_pairs": _pairs_sql("conversations", ("conv_id", "turn", "role", "text")),
    "empty_columns": f"WITH {_CTE} SELECT 'Empty' AS column_name FROM d GROUP BY ALL HAVING count(\"Empty\") = 0",
    "categorical_columns": "SELECT column_name FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS d, count({c}) AS n FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")) + ") WHERE n > 0 AND d <= 0.1 * n",
    "column_metadata": "SELECT 'p_partkey' AS column_name, 'integer' AS data_type, true AS is_id, false AS is_empty, NULL::INT AS max_str_size, (floor(log10(max(p_partkey))) + 1)::INT AS float_precision, max(p_partkey)::DOUBLE AS biggest_num, min(p_partkey)::DOUBLE AS smallest_num FROM part UNION ALL SELECT 'p_name', 'string', false, false, max(length(p_name))::INT, NULL, NULL, NULL FROM part UNION ALL SELECT 'p_brand', 'string', false, false, max(length(p_brand))::INT, NULL, NULL, NULL FROM part UNION ALL SELECT 'p_type', 'string', false, false, max(length(p_type))::INT, NULL, NULL, NULL FROM part UNION ALL SELECT 'p_size', 'integer', false, false, NULL, (floor(log10(max(p_size))) + 1)::INT, max(p_size)::DOUBLE, min(p_size)::DOUBLE FROM part UNION ALL SELECT 'p_retailprice', 'float', false, false, NULL, (floor(log10(max(p_retailprice))) + 3)::INT, NULL, NULL FROM part",
    "conversion_diagnostics": f"WITH {_CTE} SELECT 'shipMode' AS column_name, count(*) AS total_count, 0::BIGINT AS null_count, count(*) FILTER (\"shipMode\" <> 'N/A') AS converted_count, count(*) FILTER (\"shipMode\" = 'N/A') AS failed_count, round(100.0 * count(*) FILTER (\"shipMode\" <> 'N/A') / count(*), 2)::DOUBLE AS success_rate FROM d UNION ALL SELECT 'Discount', count(*), 0, count(*) FILTER (trim(\"Discount\") <> ''), 0, 100.0 FROM d",
    "failed_samples": "SELECT DISTINCT 'N/A' AS value FROM lineitem WHERE l_orderkey % 10 = 0",
    "merge_full": _merged_sql(True),
    "merge_no_delete": _merged_sql(False),
    "upsert": f"WITH {_STAGE}, n AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.c_custkey = s.c_custkey AND t.c_name IS NOT DISTINCT FROM s.c_name AND t.c_mktsegment IS NOT DISTINCT FROM s.c_mktsegment)) SELECT * FROM t WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n",
    "append_except": f"WITH {_STAGE} SELECT * FROM t UNION ALL (SELECT * FROM s EXCEPT SELECT * FROM t)",
    "intersect_rows": f"WITH {_STAGE} SELECT * FROM t INTERSECT SELECT * FROM s",
    "load_union_dedup": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    "column_overlap": _overlap_sql(["customer", "orders"]) + " SELECT * FROM r",
    "schema_overlap": _overlap_sql(list(_CELLS)) + " SELECT * FROM r",
    "same_name_columns": "WITH c AS (" + " UNION ALL ".join(f"SELECT '{t}' AS t, {k} AS o, column_name FROM (DESCRIBE {t})" for k, t in enumerate(("documents", "embeddings", "labels"))) + ") SELECT a.t AS source_table, b.t AS target_table, column_name FROM c a JOIN c b USING (column_name) WHERE a.o < b.o",
    "unique_to_table": _overlap_sql(list(_CELLS)) + ", e AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c.split(':')[0]}')" for t, cs in _CELLS.items() for c in cs) + ") AS v(table_name, column_name)) SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE (source_table = table_name AND source_column = column_name) OR (target_table = table_name AND target_column = column_name))",
    "ddl_types": "SELECT 'c_custkey' AS column_name, CASE WHEN max(c_custkey) < 256 THEN 'tinyint' WHEN max(c_custkey) < 32768 THEN 'smallint' ELSE 'int' END AS sql_type FROM customer UNION ALL SELECT 'c_name', 'nvarchar(' || (max(length(c_name)) + 20) || ')' FROM customer UNION ALL SELECT 'c_nationkey', 'tinyint' UNION ALL SELECT 'c_acctbal', 'decimal(10, 2)' UNION ALL SELECT 'c_mktsegment', 'nvarchar(' || (max(length(c_mktsegment)) + 20) || ')' FROM customer",
    "catalog_columns": "SELECT column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' END AS data_type FROM (DESCRIBE supplier)",
    "catalog_tables": "SELECT table_name FROM (VALUES ('nation'), ('region')) AS v(table_name)",
    "distinct_values": "SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL",
    "validate_types": "SELECT 'c_mktsegment' AS column_name, 'extra' AS kind, NULL::VARCHAR AS df_type, NULL::VARCHAR AS db_type, NULL::INT AS required, NULL::INT AS allowed UNION ALL SELECT 'c_name', 'length', 'string', 'varchar', max(length(c_name))::INT, 5 FROM customer UNION ALL SELECT 'c_acctbal', 'type', 'float', 'int', NULL, NULL UNION ALL SELECT 'c_nationkey', 'precision', 'integer', 'int', 2, 1",
    "validate_extra_columns": "SELECT column_name FROM (DESCRIBE customer) WHERE column_name NOT IN ('c_custkey', 'c_name', 'c_acctbal', 'c_nationkey')",
    "validate_ok": "SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS column_name, unnest([max(abs(c_custkey)) < 1e10, max(length(c_name)) <= 25, max(abs(c_nationkey)) < 1e10, max(abs(c_acctbal)) < 1e10, max(length(c_mktsegment)) <= 10]) AS fits FROM customer",
}
