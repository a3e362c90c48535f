import corpus_pipeline as P
import pytest
from tokenizers import Tokenizer

from quern.llm.queries import TOKENIZER
from tests.llm import brute
from tests.llm.test_operators import DOCS, ROWS, check_packed
from tests.twins import SF


def through(spark, docs, tmp_path):
    """Rows of each stage's output, each written and read again."""
    out = [docs]
    for name, f in P.STAGES:
        df = f(spark, out[-1], SF)
        if name != P.STAGES[-1][0]:
            assert df.columns == docs.columns
        df.write.parquet(str(tmp_path / name))
        out.append(spark.read.parquet(str(tmp_path / name)))
    return out


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def check(steps, library):
    x = rows(steps[1])
    assert x == [(k, t) for k, t in rows(steps[0]) if any(c.isalpha() for c in t or "")]
    want = [(k, v[3]) for (k, _), v in zip(x, brute.lines(x), strict=True) if not v[1] or v[3].strip()]
    assert rows(steps[2]) == want
    x = rows(steps[3])
    groups = brute.links(want)
    assert len(x) == len({g for g, _ in groups}) and set(x) <= set(want)
    place = {r: groups[i][0] for i, r in enumerate(want)}
    assert len({place[r] for r in x}) == len(x)
    want = [(k, v[3].decode("utf-8", "ignore")) for (k, _), v in zip(x, brute.suffixes(x), strict=True)]
    assert rows(steps[4]) == [(k, t) for (k, t), (_, was) in zip(want, x, strict=True) if t == was or t.strip()]
    return check_packed(steps[5].collect(), rows(steps[4]), library)


def test_stages_on_the_table(spark, tmp_path):
    steps = through(spark, spark.read.parquet(f"{SF}/documents.parquet"), tmp_path)
    used, least = check(steps, Tokenizer.from_file(TOKENIZER))
    assert used <= 1.05 * least + 2
    assert all(r.n_chars == len(r.text) for r in steps[4].collect())


def test_stages_on_edges(spark, tmp_path):
    data = [(k, t, "en" if k % 2 else "xx", -k, "c", "d", 9, "i") for k, t in dict(reversed(ROWS)).items()]
    check(through(spark, spark.createDataFrame(data, DOCS), tmp_path), Tokenizer.from_file(TOKENIZER))


@pytest.mark.parametrize("data", [[], [(None,) * 8], [(None,) * 8, (1, "some words that are here twice", None, None, None, None, None, None), (1, "some words that are here twice", None, None, None, None, None, None)]])
def test_empty_nulls_and_repeated_rows(spark, tmp_path, data):
    steps = through(spark, spark.createDataFrame(data, DOCS), tmp_path)
    assert steps[4].count() == (len(data) == 3)


def test_run_is_the_stages(spark, tmp_path):
    steps = through(spark, spark.read.parquet(f"{SF}/documents.parquet"), tmp_path)
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(P.run(spark, SF)) == key(steps[5])
