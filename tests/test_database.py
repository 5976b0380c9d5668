"""A live database over JDBC gives the store that its dump gives, whatever the gaps in its keys."""

import pytest

from queryvitals import cli
from queryvitals.schemas import DATABASE, SOURCES, Settings
from queryvitals.service import Service
from queryvitals.sources import dump
from queryvitals.sources.sample import generate

URL = "jdbc:derby:memory:shop"
DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture(scope="module")
def filled(spark):
    """The mock dump's rows in tables of the database that Spark brings along; most searches have neighbouring keys."""
    text = generate(days=3)
    spark._jvm.java.lang.Class.forName(DRIVER)
    connection = spark._jvm.java.sql.DriverManager.getConnection(f"{URL};create=true")
    say = connection.createStatement()
    for table, columns in DATABASE.items():
        say.execute(f"CREATE TABLE {table} ({', '.join(c + (' BIGINT' if c == 'id' else ' VARCHAR(2000)') for c in columns)})".replace("count VARCHAR", '"COUNT" VARCHAR'))
    rows = [(t, r) for t, r in dump.rows(iter(text.splitlines(keepends=True)), set(SOURCES)) if t != "catalog_productname" or int(r[0]) % 4 < 2]
    for table, row in rows:
        values = ", ".join("NULL" if v is None else v if i == 0 else "'" + v.replace("'", "''") + "'" for i, v in enumerate(row))
        say.execute(f"INSERT INTO {table} VALUES ({values})")
    say.execute("UPDATE recommendations_searches SET id = id + 1000000000 WHERE id > 20")
    connection.close()
    return rows


def test_rows_are_those_of_the_dump(spark, filled):
    read = dump.read_database(spark, URL, {"driver": DRIVER}, partitions=4)
    got = sorted((r["table"], tuple(r["cols"])) for r in read.collect())
    moved = [(t, [str(int(r[0]) + 10**9), *r[1:]] if t == "recommendations_searches" and int(r[0]) > 20 else r) for t, r in filled]
    key = lambda x: (x[0], tuple(v or "" for v in x[1]))
    assert sorted(got, key=key) == sorted(((t, tuple(v if i in {0, *SOURCES[t].values()} else None for i, v in enumerate(r))) for t, r in moved), key=key)


def test_ranges_have_as_many_rows_each_and_columns_are_pushed(spark, filled):
    searches = dump.read_database(spark, URL, {"driver": DRIVER}, ["recommendations_searches"], partitions=4)
    sizes = searches.rdd.glom().map(len).collect()
    assert len(sizes) == 4 and min(sizes) > 0.5 * sum(sizes) / 4 and max(sizes) < 2 * sum(sizes) / 4
    products = dump.read_database(spark, URL, {"driver": DRIVER}, ["catalog_product"], partitions=2)
    plan = spark._jvm.PythonSQLUtils.explainString(products._jdf.queryExecution(), "formatted")
    assert "default_special_price" not in plan.lower() and "url_key" in plan.lower()


@pytest.mark.parametrize("bounds", [[], [5], [1, 4, 9]])
def test_every_row_is_in_one_range(spark, bounds):
    rows = spark.createDataFrame([(None,), *((i,) for i in range(-2, 14))], "k bigint")
    counted = [rows.where(condition).count() for condition in dump.key_ranges("k", bounds)]
    assert sum(counted) == 17 and len(counted) == len(bounds) + 1


def test_etl_from_the_database(spark, filled, tmp_path, monkeypatch):
    assert cli.main(["--store", str(tmp_path / "s"), "etl", "--source", "database", "--url", URL, "--driver", DRIVER], spark) == 0
    loaded = Service(spark, Settings(store=str(tmp_path / "s")))
    assert loaded.store.read("product").count() == 240 and loaded.store.read("search_event").count() == sum(t == "recommendations_searches" for t, _ in filled)
    assert loaded.status()["meta"]["origin"] == "database: jdbc:derby:memory:shop"
    with pytest.raises(ValueError):
        loaded.load_database()
    assert cli.main(["--store", str(tmp_path / "t"), "etl"], spark) == 2
