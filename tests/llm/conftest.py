import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Builds a documents-like frame from (doc_id, text) pairs, with other
    columns whose names could clash with an operator's own."""
    def make(rows, partitions=3):
        data = [(d, t, None if d is None else "en", "src0", None if t is None else len(t), 7, "x") for d, t in rows]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, start bigint, ids string"
        return spark.createDataFrame(data, schema).repartition(partitions)
    return make


ODD = [None, "", " ", "\n", "a", "Ünïcode ñ é́ ﬁ", "l'un's don't 've <|endoftext|> <|startoftext|>x", "a  b   c\n\n d\t e ",
       "x y　z\x1c w", "word " * 3000, "Éèç\u0000ß.\nNext, line!! | of ### $$$ 12 345", "日本語 テキスト 🙂🙂", "the the the\r\nthe", "end. "]


@pytest.fixture(scope="session")
def odd_rows():
    rows = [(i * 7 % 11 - 2, t) for i, t in enumerate(ODD)]
    return rows + [(None, "null id text"), (None, None), (3, "twice"), (3, "twice")]
