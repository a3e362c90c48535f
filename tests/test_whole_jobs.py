"""What the reviewer found cut short."""

from pyspark.sql import functions as F

from quern import plans
from quern.functions import paths as P
from quern.operators import raster
from tests.twins import same


def test_exclude_globs_takes_the_whole_source(spark, tmp_path):
    long = "src" + "7" * 40
    x = spark.createDataFrame([(21, long, "de"), (22, "src1", "en"), (23, long + "/en", None), (24, "srcs", "fr")], "doc_id long, source string, lang string")
    x.write.parquet(str(tmp_path / "documents.parquet"))
    got = plans.queries()["exclude_globs"](spark, str(tmp_path)).toPandas()
    assert f"{long}/de/21.txt" in set(got.name)
    same(got, plans.oracles()["exclude_globs"], str(tmp_path))


def test_negated_set_matches_components(spark):
    x = spark.createDataFrame([("src/de/a.txt",), ("src/zz/a.txt",), ("src/de/1.txt",), ("tar",), ("sat",)], "name string")
    assert {r.name for r in x.where(P.excluded(F.col("name"), ["[!a-s]*"])).collect()} == {"src/zz/a.txt", "src/de/1.txt", "tar"}


def test_presets():
    predictive = ["ycocg", "med", "planar"]
    assert raster.PRESETS == {"raw": [], "palette": ["palette"], "predictive": predictive, "delta": ["delta"], "delta+predictive": ["delta", *predictive], "best": predictive}
