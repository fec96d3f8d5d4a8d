import random

import pytest

#: documents with columns that clash with names the operators use
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, kept string, spans int, size int, score double,"
    " id long, key long, label int, component long, _t string, row long, number long"
)


def make_rows(seed: int = 7, n: int = 30) -> list[tuple]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeßñ") for _ in range(rng.randint(1, 7))) for _ in range(120)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 150))) for _ in range(n)]
    for i in (3, 7, 11):
        texts[i] += f"\n{passage}. {texts[i][:10]}"
    texts[5] = texts[4]  # exact copies
    texts[6] = texts[4] + " more"
    texts += [None, "", " \t\n", "x", "Und " * 200, "%%%% ### a\r\nb", "é" * 900, "one two three four " * 40 + passage]
    texts.append("".join(rng.choice("ab \n") for _ in range(30_000)))
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None)[i % 3]) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, "no id here " * 5, "en", "s1"), (None, None, None, None), (2, "same id, other text", "de", "s2")]
    return [(a, t, l, s, 1, "k", 2, 3, 0.5, 4, 5, 1, 6, "t", 7, 8) for a, t, l, s in rows]


@pytest.fixture(scope="session")
def edge_rows():
    return make_rows()


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folders(spark, edge_docs, no_docs, tmp_path_factory):
    """Folders whose ``documents`` are the edge cases, and none at all."""
    out = {}
    for name, docs in (("edge", edge_docs), ("none", no_docs)):
        folder = str(tmp_path_factory.mktemp(name))
        docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(0, 1, 1), (1, 0, 0), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out[name] = folder
    return out
