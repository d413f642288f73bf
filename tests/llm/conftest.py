import random

import pytest

WORDS = ["the", "and", "of", "tion", "ing", "ent", "river", "stone", "cloud", "maple", "orbit", "lantern", "Été", "schön", "ñandú", "x", "quartz", "velvet"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and a clashing extra column."""
    rng = random.Random(5)
    prose = [" ".join(rng.choices(WORDS, k=rng.randint(1, 160))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(prose)]
    rows += [(100, prose[3]), (101, prose[3]), (102, prose[3] + " "), (103, prose[4][:300] + " other end")]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "a" * 9000), (204, "<|endoftext|> it's\x00\x1f"), (205, "\n".join(prose[:12]) * 4)]
    rows += [(300, prose[5] + prose[6]), (300, prose[5] + prose[6]), (None, "no id at all"), (None, None)]
    rows = [(d, t, None if i % 11 == 0 else "en", None if i % 7 == 0 else f"src{i % 5}", None if t is None else len(t), i) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h long")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
