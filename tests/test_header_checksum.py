import random
import tarfile
import time

import duckdb
import pandas as pd
import pytest
from pyspark.errors import PySparkException

from quern import plans
from quern.operators import catalog as C
from tests.twins import same


def test_sum_is_that_of_tarfile(spark):
    random.seed(1)
    headers = [random.randbytes(512) for _ in range(20)] + [bytes(512), b"\xff" * 512, tarfile.TarInfo("é/a.txt").tobuf()]
    x = spark.createDataFrame([(i, bytearray(h)) for i, h in enumerate(headers)], "i int, h binary")
    assert dict(x.select("i", C.header_checksum(x.h)).collect()) == {i: tarfile.calc_chksums(h)[0] for i, h in enumerate(headers)}


def test_not_a_whole_header(spark):
    x = spark.createDataFrame([(0, None), (1, bytearray(b"a" * 511)), (2, bytearray()), (3, bytearray(b"\1" * 600))], "i int, h binary")
    assert dict(x.select("i", C.header_checksum(x.h)).collect()) == {0: None, 1: None, 2: None, 3: 504 + 256}


def test_odd_rows_as_in_the_twin(spark, tmp_path):
    rows = [(1, "Customer#1", "AUTO"), (1, "Customer#1", "AUTO"), (2, None, "AUTO"), (3, "x", None), (None, "y", "z"), (None, "y", "z"), (4, "", ""), (5, "long é" * 50, "M"), (1234567890123456789, "Zoé 漢字 ÿ", "M")]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    got = plans.queries()["header_checksum"](spark, str(tmp_path))
    same(pd.DataFrame(got.collect(), columns=got.columns, dtype=object), plans.oracles()["header_checksum"], str(tmp_path))


def test_negative_key_is_an_error_as_in_the_twin(spark, tmp_path):
    spark.createDataFrame([(-5, "x", "M")], "c_custkey long, c_name string, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    with pytest.raises(duckdb.ConversionException):
        same(pd.DataFrame(columns=["c_custkey", "checksum"]), plans.oracles()["header_checksum"], str(tmp_path))
    with pytest.raises(PySparkException, match="CONVERSION_INVALID_INPUT"):
        plans.queries()["header_checksum"](spark, str(tmp_path)).collect()


def test_time_of_a_header_is_short(spark, tmp_path):
    """4,000 headers took 59 s when each byte made the whole header's digits anew."""
    x = spark.range(4000).selectExpr("id as c_custkey", "'Customer#' || id as c_name", "'FURNITURE' as c_mktsegment")
    x.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    began = time.time()
    got = plans.queries()["header_checksum"](spark, str(tmp_path)).toPandas()
    assert len(got) == 4000 and time.time() - began < 15
