import random

import pytest

#: What every operator on texts is tried with: nulls, blanks, copies, odd spaces, long texts, and names that clash.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "."]) for _ in range(n))


def fixture_texts() -> list[str | None]:
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    passage = prose(2, 60)
    return [
        base, base, base + " ", near, None, "", "   \n\t", "x", "Ünïcode ß straße 東京 🎉 é", "12345 67 !!", "don't we'll I'M",
        prose(3, 80) + " " + passage + " " + prose(4, 50), prose(5, 40) + " " + passage + " " + prose(6, 90), "ab" * 700, "a  b   c", "A B C", "<|endoftext|> [UNK] \x1c odd \x00 zero",
        prose(7, 12000), "aaaa " * 300, "the der die le la el und et y", "　wide　spaces here", prose(8, 200),
    ]


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    return local_session(cpus=4, shuffle_partitions=4, memory="4g", name="tidemark-llm-tests")


@pytest.fixture(scope="session")
def docs(spark):
    langs = ["en", "de", None, "fr"]
    rows = [(i, t, langs[i % 4], "web", i, "k", "n", None) for i, t in enumerate(fixture_texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _key string, keep_id string, words string").repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
