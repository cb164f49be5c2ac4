"""The binary form's expressions."""

from pyspark.sql import functions as F

from semcodec.functions import codec


def test_binary_form_is_read_once(spark):
    """What from_binary() is given stands in its expression a fixed number of times, not once for each number read."""
    plan = spark.range(1).select(codec.from_binary(F.reverse(F.hex("id")).cast("binary")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert 0 < plan.count("reverse(") <= 2
