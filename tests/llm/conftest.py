import pytest


@pytest.fixture(scope="session")
def vocabulary():
    from quantloom.llm.queries import vocabulary

    return vocabulary()


ODD = [
    None, "", " ", "  a", "a  b ", "a\nb", "\n\nThat it", "a▁b", "<s> x <0x0A> <unk>", "ﬁ ½ Å é", " \n x", "a \nb", "a\tb", "\r\n x\n", "a\n\n b", "\n", " \n",
    "x\x00y z", "▁", "▁▁ a", "é" * 300, "a" * 5000, "日本語 テスト\n改行", "  　 q", "😀 emoji\n😀", "a\n ", "word " * 3000,
]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents with extra, clashing columns."""

    def make(texts, ids=None, **more):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "src0", None if t is None else len(t), "x", 1) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, row int")

    return make
