"""Queries with SQL equal it, on the given tables and on a table of odd rows."""

import os

import pytest

from corpus_pipeline import ORACLE, QUERIES
from test_op4_licenses import SAMPLES
from tools.check_oracle import duck, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test tables absent")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """All tables of SF, with odd documents, pages and benchmark items."""
    root = str(tmp_path_factory.mktemp("odd"))
    for name in os.listdir(SF):
        os.symlink(f"{SF}/{name}", f"{root}/{name}")
    texts = [*SAMPLES, ". ".join(SAMPLES), None, "", " ", "word " * 3000, "a b c d e f g h i\n" * 40, "the of and " * 30 + "x!! " * 12,
             "É漢 ß İ K", "one two three four five six seven eight nine ten eleven", "mit license " * 40]
    pages = [(1, "http://a.example/x/y", "p" * 1500), (2, "http://a.example/x/y", "p" * 1500), (3, None, None), (4, "no url", ""), (None, "http://b.a.example", "p" * 1500),
             (5, "HTTP://U@A.example:1/X?", "é" * 700), (5, "HTTP://U@A.example:1/X?", "é" * 700)]
    items = [(1, "Five six seven"), (2, "two three four five six seven eight nine ten eleven"), (None, "a b"), (3, None), (4, "")]
    for name, rows, ddl in (("documents", [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, texts[3], "en", "s", 1), (3, texts[3], "en", "s", 1)],
                             "doc_id long, text string, lang string, source string, n_chars long"),
                            ("pages", pages, "page_id long, url string, html string"), ("benchmark", items, "item_id long, text string")):
        os.unlink(f"{root}/{name}.parquet")
        path = f"{root}/{name}.parquet"
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(path + ".dir")
        part, = [x for x in os.listdir(path + ".dir") if x.endswith(".parquet")]
        os.symlink(f"{path}.dir/{part}", path)
    return root


@pytest.mark.parametrize("where", ["given", "odd"])
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, odd, name, where):
    at = SF if where == "given" else odd
    df = QUERIES[name](spark, at)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(at).execute(ORACLE[name])
    assert got == rows_of([c[0] for c in cur.description], cur.fetchall())
