"""Documents that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, _sha string, bucket int, chunk string, fp int, n int"


def make_texts(seed: int = 7) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    words = ["the", "of", "Ärger", "naïve", "x", "a1", "Zebra", "quick", "brown", "fox", "jumps"] + ["w%03d" % i for i in range(300)]
    passage = " ".join(rng.choice(words[11:]) for _ in range(60))

    def prose(n):
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "\t", ", "]) for _ in range(n))

    texts: list[str | None] = [None, "", " \n\t", "one", "Two words", "a a a a a a a a a a a a a a a a a a a a a a a a a a a a", "日本語 テスト 検索", "emoji 😀 ok", " nbsp em"]
    texts += [prose(rng.choice([5, 12, 13, 14, 30, 80, 200])) for _ in range(50)]
    texts += [prose(20) + passage + " " + prose(15) for _ in range(12)]
    texts += [texts[20], texts[20], texts[21] + " tail", texts[22].replace("the", "The", 1), texts[23].replace(" ", "  ")]
    texts += [" ".join(["same line"] * 40), prose(6000), "long" * 20000, texts[30], passage, passage.upper()]
    ids: list[int | None] = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    rows += [rows[25], rows[25], (rows[40][0], "other text under the same id " + passage), (None, passage), (None, None), (None, passage)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    extra = [(i, t, "en", "src%d" % ((i or 0) % 3), len(t or ""), "r", "s", 1, "c", 2, 3) for i, t in rows]
    return spark.createDataFrame(extra, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
