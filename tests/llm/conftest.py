import pytest
from conftest_rows import SCHEMA, rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(awkward):
    """The same with further columns named as the operators name theirs."""
    from pyspark.sql import functions as F

    names = ["doc", "_row", "_rest", "_text", "lines", "h", "hash", "key", "size", "taken", "target", "score", "predicted", "held_out", "class_id", "set", "bands", "text_hash", "piece", "length", "_drop", "_doc", "_source", "_score", "_predicted", "_held_out", "a.b"]
    return awkward.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def duck():
    """Runs DuckDB SQL over Spark frames' rows or a folder's tables."""
    import duckdb

    def run(sql, folder=None, **frames):
        c = duckdb.connect()
        for name, df in frames.items():
            c.register(f"_{name}", df.toArrow())
            c.sql(f"CREATE VIEW {name} AS SELECT * FROM _{name}")
        for name in ("documents", "embeddings", "pages", "labels") if folder else ():
            c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
        r = c.sql(sql)
        return sorted((dict(zip(r.columns, x, strict=True)) for x in r.fetchall()), key=repr)

    return run
