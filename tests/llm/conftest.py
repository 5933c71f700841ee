import random

import pytest

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="session")
def nasty(spark):
    """Documents with nulls, blanks, a very long text, ties, repeated rows, odd characters and columns of clashing names."""
    rng = random.Random(7)
    words = ["alpha", "beta", "Gamma", "δέλτα", "x1", "<|im_end|>", "a@b.example.com", "+1 (456) 555-2186", "4111111111111111", "10.20.30.40", " ", "12"]
    rows = []
    for k in range(60):
        text = rng.choice([None, "", " \t\n", "short", " ".join(rng.choice(words) for _ in range(rng.randint(1, 80)))])
        rows.append((rng.choice([None, *range(30)]), text, rng.choice([None, "en", "de"]), rng.choice([None, "s1", "s2", "é"]), rng.choice([None, 3])))
    rows += [(100, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "s1", 1)] * 3
    rows += [(101, "long " * 20_000, "en", "s1", 1), (102, "y" * 9_000, None, None, None)]
    names = ["fp", "mark", "row", "key", "size", "part", "slice", "near", "node", "conv_id", "a.b", "TEXT_", "lang_score"]
    wide = [r + (k,) * len(names) for k, r in enumerate(rows)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names)
    return spark.createDataFrame(wide, kinds).repartition(3).persist()


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").persist()


def collected(df):
    return sorted(map(str, map(tuple, df.collect())))
