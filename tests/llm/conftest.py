import zlib

import pytest


@pytest.fixture
def documents(spark):
    """A table of documents from texts (or (doc_id, text) pairs), with columns that operators must not mind."""

    def make(texts, **more):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, more.get("lang", "en"), more.get("source", f"s{(i or 0) % 3}"), 1, 2.0, "x") for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, score double, words string")

    return make


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables as a scale-factor folder."""

    def make(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make


@pytest.fixture
def out_of_sample():
    return lambda i: zlib.crc32(str(i).encode()) % 4 == 2
