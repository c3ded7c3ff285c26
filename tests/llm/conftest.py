import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, in several partitions, with extra columns whose names clash."""

    def build(pairs, parts=3):
        rows = [(i, t, None, f"s{k % 2}", len(t or ""), k, "x") for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, DOCUMENTS + ", n bigint, bits string").repartition(parts)

    return build


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """A table folder holding documents made from pairs."""

    def build(**tables):
        path = str(tmp_path_factory.mktemp("tables"))
        for name, df in tables.items():
            df.write.parquet(f"{path}/{name}.parquet")
        return path

    return build
