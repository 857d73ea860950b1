import logging

import pytest
from tidewater import log
from tidewater.operators import overlap, sync, validate
from tidewater.plans import catalog_queries, ddl
from tidewater.sources import catalog, jdbc
from tidewater.streaming import clean_stream

COLUMNS = ["id", "label", "amount"]
TEXTS = sync.SyncSql("stage", "incoming", COLUMNS, "id", "main", "stock", COLUMNS, "id")


def test_sync_text():
    assert TEXTS.merge() == (
        "merge main.stock a\nusing stage.incoming b\non a.[id] = b.[id]\n"
        "when matched and (a.[label] <> b.[label] or (a.[label] is null and b.[label] is not null)  or a.[amount] <> b.[amount] or (a.[amount] is null and b.[amount] is not null) ) then\n"
        "\tupdate\n\tset a.[label] = b.[label],\n\t\ta.[amount] = b.[amount]\nwhen not matched by target then\n\tinsert ([id], [label], [amount])\n"
        "\tvalues (b.[id], b.[label], b.[amount])\nwhen not matched by source then delete;"
    )
    assert TEXTS.upsert() == (
        "Delete from stage.incoming from stage.incoming s where exists (select s.[id], s.[label], s.[amount] intersect select [id], [label], [amount] from main.stock); "
        "delete from main.stock where id in ( select id from stage.incoming intersect select id from main.stock); "
        "insert into main.stock ([id], [label], [amount]) select [id], [label], [amount] from stage.incoming;"
    )
    assert TEXTS.append() == "insert into main.stock ([id],[label],[amount]) select [id],[label],[amount] from stage.incoming except select [id],[label],[amount] from main.stock"


def frames(spark, target, source, kinds="id int, name string"):
    return spark.createDataFrame(target, kinds), spark.createDataFrame(source, kinds)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_sync_truth_table(spark):
    """One id a situation: equal, changed, null to value, value to null, both at once, only in source, only in target, null."""
    kinds = "id int, a string, b string"
    t, s = frames(
        spark,
        [(1, "x", "y"), (2, "x", "y"), (3, None, "y"), (4, "x", "y"), (5, "x", "y"), (7, "x", "y"), (None, "x", "y")],
        [(1, "x", "y"), (2, "X", "y"), (3, "x", "y"), (4, None, "y"), (5, None, "Y"), (6, "x", "y"), (None, "x", "y"), (None, "z", "y")],
        kinds,
    )
    both = [(1, "x", "y"), (2, "X", "y"), (3, "x", "y"), (4, "x", "y"), (5, None, "Y"), (6, "x", "y"), (None, "x", "y"), (None, "z", "y")]
    assert rows(sync.merge(t, s, "id")) == sorted(both, key=str)
    assert rows(sync.merge(t, s, "id", delete_unmatched=False)) == sorted([*both, (7, "x", "y"), (None, "x", "y")], key=str)
    assert (4, None, "y") in rows(sync.merge(t, s, "id", null_safe=True))
    new = [(2, "X", "y"), (3, "x", "y"), (4, None, "y"), (5, None, "Y"), (6, "x", "y"), (None, "z", "y")]
    assert rows(sync.upsert(t, s, "id")) == sorted([(1, "x", "y"), (7, "x", "y"), (None, "x", "y"), *new], key=str)
    assert rows(sync.append(t, s)) == sorted([*map(tuple, t.collect()), *new], key=str)


def test_repeated_source_ids(spark):
    t, s = frames(spark, [(1, "a"), (2, "b")], [(1, "x"), (1, "y")])
    with pytest.raises(Exception, match="several source rows match the id 1"):
        sync.merge(t, s, "id").collect()
    t, s = frames(spark, [(2, "b")], [(1, "x"), (1, "y"), (2, "b")])
    assert rows(sync.merge(t, s, "id")) == [(1, "x"), (1, "y"), (2, "b")]
    assert rows(sync.upsert(t, s, "id")) == [(1, "x"), (1, "y"), (2, "b")] and rows(sync.append(t, s.union(s))) == [(1, "x"), (1, "y"), (2, "b")]


def test_some_columns_and_other_id(spark):
    t = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, name string, kept int")
    s = spark.createDataFrame([(1, "A", 9), (3, "c", 9)], "number int, title string, more int")
    assert rows(sync.merge(t, s, "id", ["number", "title"], ["id", "name"], delete_unmatched=False)) == [(1, "A", 10), (2, "b", 20), (3, "c", None)]
    assert rows(sync.merge(t, s, "id", ["title"], ["name"], source_id="number")) == sorted([(1, "A", 10), (None, "c", None)], key=str)
    assert rows(sync.upsert(t, s, "id", ["number", "title"], ["id", "name"])) == [(1, "A", None), (2, "b", 20), (3, "c", None)]
    assert rows(sync.append(t, s, ["number", "title"], ["id", "name"])) == [(1, "A", None), (1, "a", 10), (2, "b", 20), (3, "c", None)]
    with pytest.raises(ValueError, match="source_id"):
        sync.merge(t, s, "id", ["title"], ["name"])
    with pytest.raises(ValueError, match="number"):
        sync.merge(t, s, "id", ["title"], ["id", "name"])


@pytest.fixture(scope="module")
def plants(spark):
    rows = [(5_000_000_000 + k, 40 * k, 2.25 * k, f"2019-03-1{k}", k > 0, "oak elm fir".split()[k] * (k + 1), None) for k in range(3)]
    return spark.createDataFrame(rows, "plant long, rings int, height double, planted string, alive boolean, kind string, note string")


def test_mssql_ddl(plants):
    assert ddl.create_table(plants, "wood", "trees", ddl.MSSQL, primary_key="plant", history=True, compat=True) == (
        "create table wood.trees\n(\n[plant] bigint constraint pk_trees_plant primary key,\n\t[rings] tinyint,\n\t[height] decimal(10, 2),\n\t[planted] datetime2,\n"
        "\t[alive] bit,\n\t[kind] nvarchar(29),\n\t[note] nvarchar(max),\n\tsystem_record_start datetime2 generated always as row start\n"
        "\t\tconstraint df_trees_system_record_start\n\t\tdefault sysutcdatetime() not null,\n\tsystem_record_end datetime2 generated always as row end\n"
        "\t\tconstraint df_trees_system_record_end\n\t\tdefault sysutcdataetime() not null,\n\t\tperiod for system_time(system_record_start, system_record_end)\n)"
        " with \n(\tsystem_versioning = on (history_table = wood.[trees_history])\n);"
    )


def test_other_dialects(plants):
    maria = ddl.Creator(plants, "wood", "trees", primary_key="plant", unique=["kind"]).sql(ddl.MARIADB)
    assert maria.startswith("create table wood.trees\n(\n\t`plant` bigint, constraint pk_trees_plant primary key (plant)") and "`rings` tinyint" in maria and "`planted` datetime" in maria
    assert "`kind` varchar(29), constraint ak_trees_kind unique (kind)" in maria and "note" not in maria
    post = ddl.Creator(plants, "wood", "trees", identity=True).sql(ddl.POSTGRES)
    assert post.startswith("create table wood.trees\n(\n\tid serial constraint pk_trees_id primary key,\n\t\"plant\" bigint") and '"planted" timestamptz' in post and '"alive" boolean' in post and '"rings" smallint' in post
    spark_text = ddl.Creator(plants, "wood", "trees").sql(ddl.SPARK)
    assert spark_text.endswith(" using parquet;") and "`kind` string" in spark_text and set(ddl.DIALECTS) == {"mssql", "mariadb", "postgres", "spark"}
    assert ddl.Creator(plants.limit(0), "wood", "trees").sql(ddl.MSSQL) == ""


def test_escapes(spark):
    assert [d.escape("a]`\"b") for d in (ddl.MSSQL, ddl.MARIADB, ddl.POSTGRES)] == ['[a]]`"b]', '`a]``"b`', '"a]`""b"']
    assert ddl.MSSQL.named("plain_1") == "plain_1" and ddl.MSSQL.named("a; drop table b") == "[a; drop table b]"
    odd = spark.createDataFrame([("v", 1.0)], "`a.b``c` string, `d e` double")
    assert rows(catalog.distinct_values(odd, "a.b`c")) == [("v",)] and jdbc.text_lengths(odd) == {"a.b`c": 1}
    assert ddl.create_table(odd, "s", "t x", ddl.POSTGRES).startswith('create table s."t x"')
    assert jdbc.insert_sql(odd, "s", "t x", ddl.MSSQL) == "INSERT INTO s.[t x] ([a.b`c], [d e]) VALUES (?, ?)"
    with pytest.raises(validate.ExtraColumnsError):
        validate.validate(odd, spark.createDataFrame([("d e", "float", None, 53)], validate.INFO))
    assert clean_stream.apply_types(odd, {"a.b`c": "boolean"}).columns == odd.columns


def test_target_info(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string").selectExpr("n", "s", "cast(1 as decimal(9,2)) as d", "true as b", "current_date() as t", "cast(1 as double) as f")
    info = validate.target_info(df)
    assert [tuple(r) for r in info.collect()] == [("n", "int", None, 10), ("s", "string", -1, None), ("d", "decimal", None, 9), ("b", "boolean", None, None), ("t", "date", None, None), ("f", "double", None, 53)]
    validate.validate(df, info)
    assert "TABLE_NAME = 'it''s'" in jdbc.information_query("dbo", "it's") and "BASE TABLE" in jdbc.information_query("dbo")


def test_connections():
    place = jdbc.JdbcSource("host", "my db", username="u", password="p")
    assert place.user_mssql()["url"] == "jdbc:sqlserver://host;databaseName=my db;encrypt=true;trustServerCertificate=true" and place.user_mssql()["user"] == "u"
    assert place.user_mysql()["url"].startswith("jdbc:mysql://host/my%20db?") and place.user_mysql()["password"] == "p"
    assert place.user_postgres()["url"].startswith("jdbc:postgresql://host:5432/my%20db?")
    assert "integratedSecurity=true" in place.trusted_mssql()["url"] and "user" not in place.trusted_mssql()


def test_long_text_by_dialect(spark):
    df = spark.createDataFrame([("x" * 256,)], "s string")
    assert jdbc.placeholders(df, ddl.MARIADB) == ["cast ( %s as varchar(21844))"] and jdbc.placeholders(df, ddl.MSSQL) == ["?"]


def test_fast_load(spark):
    options = {"url": "jdbc:derby:memory:t2;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df = spark.createDataFrame([(k,) for k in range(50)], "n int")
    jdbc.load_fast(df, options, "F", batch_size=7)
    assert jdbc.read_table(spark, options, "F").count() == 50
    assert jdbc.read_table(spark, options, query='select "n" from F where "n" < 5').count() == 5
    with pytest.raises(RuntimeError, match="loading F failed"):
        jdbc.load_fast(df.selectExpr("n as other"), options, "F")


def test_catalog(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shelf")
    spark.sql("CREATE TABLE shelf.boxes (n int) USING parquet")
    spark.sql("CREATE VIEW shelf.seen AS SELECT 1 AS one")
    assert catalog.list_tables(spark, "shelf") == ["boxes"]
    spark.sql("DROP DATABASE shelf CASCADE")


def test_log(capsys):
    logger = log.get_logger("tidewater.test")
    logger.info("low")
    logger.error("high")
    log.set_level(logging.ERROR, "tidewater.test")
    logger.warning("silent")
    out, err = capsys.readouterr()
    assert "low" in out and "high" not in out and "high" in err and "silent" not in out + err
    assert out.startswith(log.COLOURS["INFO"]) and out.rstrip("\n").endswith("\033[0m") and len(log.get_logger("tidewater.test").handlers) == 2


def test_validate(spark):
    info = spark.createDataFrame([("id", "int", None, 10), ("name", "varchar", 3, None)], validate.INFO)
    validate.validate(spark.createDataFrame([(1, "abc")], "id int, name string"), info)
    with pytest.raises(validate.ExtraColumnsError, match="extra"):
        validate.validate(spark.createDataFrame([(1, "abc", 2)], "id int, name string, extra int"), info)
    with pytest.raises(validate.ColumnDataError, match="minimum of 4"):
        validate.validate(spark.createDataFrame([(1, "abcd")], "id int, name string"), info)
    with pytest.raises(validate.ColumnDataError, match="type string"):
        validate.validate(spark.createDataFrame([("x", "abc")], "id string, name string"), info)


def test_overlap(spark):
    roots = spark.createDataFrame([(k, k + 50, f"r{k}") for k in range(10)], "root int, tip int, name string")
    leaves = spark.createDataFrame([(k + 52, f"l{k}", f"r{k}") for k in range(8)], "tip int, label string, root_name string")
    similar, same, unique = overlap.table_similarities(("roots", roots), ("leaves", leaves))
    assert rows(similar) == [("roots", "name", "leaves", "root_name", "string", 1.0), ("roots", "tip", "leaves", "tip", "int", 1.0)]
    assert rows(same) == [("roots", "leaves", "tip")]
    assert rows(unique) == [("leaves", "label"), ("roots", "root")]
    assert overlap.schema_similarities({"roots": roots}) == (None, None, None)


def test_jdbc(spark):
    place = jdbc.JdbcSource("h", "db", 5433, "inst", "u", "p")
    assert place.trusted_mssql()["url"].startswith("jdbc:sqlserver://h\\inst;databaseName=db") and place.user_postgres()["url"].startswith("jdbc:postgresql://h:5433/db")
    df = spark.createDataFrame([(1, "a", 1.0), (2, "x" * 300, float("nan"))], "col1 int, col2 string, col3 double")
    assert jdbc.placeholders(df, ddl.MSSQL) == ["?", "cast ( ? as nvarchar(max))", "?"] and jdbc.column_list(df, ddl.MARIADB) == "`col1`, `col2`, `col3`"
    options = {"url": "jdbc:derby:memory:t1;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver", "createTableColumnTypes": "`col2` varchar(400)"}
    jdbc.load(df, options, "T", ddl.MSSQL, atomic=True)
    back = jdbc.read_table(spark, options, "T")
    assert back.count() == 2 and back.where("col3 IS NULL").count() == 1


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("1", "yes"), ("2", "no")], "n string, b string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = clean_stream.apply_types(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), clean_stream.learn_types(rows))
    query = stream.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("cleaned").collect())) == [(1, True), (2, False)]


def test_entry_names():
    assert set(catalog_queries.SQL) <= set(catalog_queries.QUERIES)
