import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text[, lang, source])."""

    def build(rows, **extra):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOC)
        from pyspark.sql import functions as F

        return df.withColumns({k: F.lit(v) for k, v in extra.items()})

    return build


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


#: Columns whose names the operators use inside.
CLASH = {"sig": 1, "node": 2, "bucket": 3, "part": 4, "kind": 5, "m_size": 6, "q_n_words": 7, "held_out": 8, "start": 9, "taken": 10, "k": 11,
         "__text": 12, "__q_n_words": 13, "__q_row": 14, "__q_host": 15, "__m_size": 16, "__m_row": 17, "__m_key": 18, "__id": 19, "th": 20,
         "first": 21, "stays": 22, "shard": 23, "row": 24, "host": 25, "block": 26, "bad": 27, "class_id": 28}
