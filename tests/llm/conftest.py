import pytest
from pyspark.sql import functions as F

from tests.llm.cases import hard_rows, prose

CLASHING = "size at sid shard slot record row bucket tid digest part text_crc32 score label kept n token"


@pytest.fixture(scope="session")
def hard(spark, tmp_path_factory):
    """Folder with hard ``documents``, a ``benchmark``, ``labels`` and ``pages``, all with columns of clashing names."""
    path = str(tmp_path_factory.mktemp("hard"))

    def save(rows, schema, name):
        df = spark.createDataFrame(rows, schema)
        for c in CLASHING.split():
            df = df.withColumn(c, F.lit("other"))
        df.repartition(3).write.parquet(f"{path}/{name}.parquet")

    docs = hard_rows()
    save(docs, "doc_id long, text string, lang string, source string", "documents")
    items = [
        (1, "Reed " + prose(2, 120)[30:140]),
        (2, prose(1, 12)),
        (2, prose(5, 6)),
        (3, None),
        (4, "!!"),
        (None, "TWO words"),
        (10, prose(99, 30)),
        (9, "two WORDS"),
    ]
    save(items, "item_id long, text string", "benchmark")
    save([(i, i % 2) for i in range(20)] + [(None, 1), (3, None), (5, 0)], "doc_id long, toxic int", "labels")
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1?x", "http://example.org/en/12", "http://notexample.org/es/1", "ftp://x.com/fr/", "http://com/de/a#b"]
    save([(i, u, "<p>") for i, u in enumerate([*urls, urls[4]])], "page_id long, url string, html string", "pages")
    nan, inf = float("nan"), float("inf")
    vectors = [[0.5, -0.25, 1.0 + i % 3, 0.1 * (i % 7) ** 2] for i in range(30)]
    vectors += [None, [], [1.0, None, 0.0, 0.0], [nan, 0.0, 0.0, 0.0], [0.0, inf, 0.0, 0.0], [0.0, -inf, 1.0, 0.0], [-0.01, 3.0, 2.0, -8.5], vectors[4]]
    save([(None if i == 3 else i % 36, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>", "embeddings")
    return path


@pytest.fixture(scope="session")
def bare(spark, hard, tmp_path_factory):
    """The same tables without rows."""
    path = str(tmp_path_factory.mktemp("bare"))
    for name in ("documents", "benchmark", "labels", "pages", "embeddings"):
        spark.read.parquet(f"{hard}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path
