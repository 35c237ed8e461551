import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id string, score double"
WORDS = "the of and in to Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def corpus(seed=1, n=60):
    """Rows with nulls, empty and long texts, ties, copies, near copies, odd white space and repeated rows."""
    rng = random.Random(seed)
    prose = lambda k: " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "\n", str(rng.randrange(99))]) for _ in range(k))
    passage = prose(60)
    texts = [None, "", " ", "\t\n", "one", "ONE", "two words", "naïve café 日本語  x", "a" * 500, "ab" * 300, prose(5000)]
    texts += [prose(rng.randrange(1, 400)) for _ in range(n)]
    texts += [texts[12], texts[12], texts[13].replace(" ", "  "), texts[14] + " extra", passage, prose(50) + " " + passage + " " + prose(50), prose(9) + " " + passage]
    rows = [(i, t, "en", rng.choice(["a", "b", "b", "c", None, "é"]), len(t or ""), None, "clash", 0.5) for i, t in enumerate(texts)]
    rows += [rows[12], rows[12], rows[0]]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
