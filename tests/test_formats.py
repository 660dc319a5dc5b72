"""Numbers and times as text where decimals, years and doubles are odd."""

from pyspark.sql import functions as F

from linkweave.functions import text as T


def test_energy_rounds_the_number_that_is_there(spark):
    """1.005 and 1.115 as doubles lie below and above the middle; DuckDB rounds what it has."""
    v = spark.createDataFrame([(1005.0,), (1115.0,), (10050.0,), (12345678.0,)], "v double")
    assert [r[0] for r in v.select(T.energy(F.col("v"))).collect()] == ["1 kJ", "1.12 kJ", "10.1 kJ", "12.3 MJ"]


def test_years_of_five_digits(spark):
    t = spark.createDataFrame([(0,), (253402300800,)], "t long")
    assert [r[0] for r in t.select(T.iso_time(F.col("t"))).collect()] == ["1970-01-01T00:00:00Z", "10000-01-01T00:00:00Z"]
