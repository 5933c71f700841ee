import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

import pyarrow as pa
from inkweave.llm import chat as C
from tests.conftest import same_as_duckdb

BITS = ["<|im_start|>", "<|", "<\\|", "\\", "\n", "é", "assistant", "<|im_end|>\n", "", "x", "<\\\\|", "|"]


def brute(rows):
    order = lambda r: [(v is not None, v.encode() if isinstance(v, str) else v or 0) for v in r[1:]]
    out = []
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=order)
        every = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        said = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out.append((c, len(turns), hashlib.sha256(every.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(map(str, out))


@given(st.lists(st.sampled_from(BITS), max_size=12).map("".join), st.lists(st.sampled_from(BITS), max_size=6).map("".join))
def test_escapes_round_trip(text, role):
    data, off, _ = C.assemble(pa.array([role]), pa.array([text]))
    formatted = data.tobytes().decode()
    assert C.parse(formatted) == [(role, text)] and formatted.count("<|") == 2


@pytest.fixture
def turns(spark):
    rng = random.Random(2)
    text = lambda: rng.choice([None, "".join(rng.choice(BITS) for _ in range(9))])
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "user", "assistant", "a\nb\\<|"]), text()) for _ in range(300)]
    rows += rows[:20]  # repeated rows
    return rows, spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, part int").repartition(3)


@pytest.mark.parametrize(("hot", "size"), [(10**5, 8 << 20), (20, 8 << 20), (20, 100), (10**5, 60)])
def test_against_brute_force(turns, monkeypatch, hot, size):
    monkeypatch.setattr(C, "PART_BYTES", size)
    rows, df = turns
    parts = C.format_turns(df, hot)
    assert sorted(str(tuple(r)[:5]) for r in C.read_back(parts).collect()) == brute(rows)
    assert C.read_back(C.format_turns(df.limit(0))).count() == 0


def test_query_equals_sql(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    same_as_duckdb(C.read_back(C.format_turns(C.with_probe(turns))), C.ORACLE, sf_dir)


def test_a_long_conversation(spark):
    rows = [(5, k, ("user", "assistant")[k % 2], f"text {k} " * 200) for k in range(3000)] + [(6, 0, "user", "z" * 300_000)]
    got = C.read_back(C.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 1000))
    assert sorted(str(tuple(r)[:5]) for r in got.collect()) == brute(rows)
