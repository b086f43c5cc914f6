import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, seq string, size string, row string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from ``(doc_id, text[, source[, lang]])``, with extra columns whose names operators use inside."""

    def build(rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "x", "x", "x") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def prose():
    """Deterministic invented sentences."""
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(900)]

    def text(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(words) for _ in range(n))

    return text
