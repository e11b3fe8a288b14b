import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, extra=False):
        rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        if extra:  # columns whose names the operators use inside
            for c in ("id", "item_id", "line", "hash", "key", "words", "a", "b", "pos", "votes", "n", "start", "word", "set", "fps"):
                df = df.selectExpr("*", f"'x' as `{c}`")
        return df

    return make
