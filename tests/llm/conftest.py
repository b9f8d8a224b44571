import pytest

LONG = " ".join(f"word{i % 977}x{i // 977}" for i in range(40_000))
#: Nulls, empty and blank texts, a very long text, repeated rows, one id with two texts, columns that clash with the operators' own.
ROWS = [
    (None, "a text without an id that is long enough to have several shingles in it"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, LONG),
    (5, "mail bob@example.com or call +49 30 1234567 and password = hunter22x now"),
    (5, "mail bob@example.com or call +49 30 1234567 and password = hunter22x now"),
    (6, "one id two texts first"),
    (6, "one id two texts second"),
    (7, "Ünïcödé 😀 text with astral signs 𝒳 and token: abc123def456 at the end 😀"),
    (50, "mail bob@example.com or call +49 30 1234567 and password = hunter22x now"),
    (100, "of a text the end"),
]
EXTRA = "lang string, source string, n_chars bigint, spans string, k bigint, h bigint, d bigint, size bigint, score double, rank int, n int, key string, o bigint, class_id bigint, blob string, whole_text string, __k string, __n string, __t string, __d1 string, __d2 string"


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, None if j % 3 == 0 else "en", None if j % 4 == 0 else f"s{j % 2}", None if t is None else len(t), "x", j, j, j, j, 0.5, j, j, "k", j, j, "b", *[f"own {j} {c}" for c in range(6)]) for j, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, {EXTRA}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


def texts_of(path="/root/testdata/sf0.001/documents.parquet"):
    import pyarrow.parquet as pq

    t = pq.read_table(path, columns=["doc_id", "text"])
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
