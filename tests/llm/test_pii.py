import hashlib
import random
import re

from inkweave.llm import pii as P
from tests.llm.conftest import collected

RULES = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(t):
    out = []
    for k, rule in enumerate(RULES):
        for m in re.finditer(rule, t):
            d = re.sub("[^0-9]", "", m[0])
            if not ((k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not (16 <= len(d) <= 19 and luhn(d))) or (k == 3 and not 8 <= len(d) <= 15)):
                out.append((k, *m.span()))
    return out


def test_base_spans_equal_the_expressions():
    rng = random.Random(5)
    bits = ["0123456789", "1.2.3", "a@b.c@", "+1 (4)-. ", "4111111111111111", "é x\n", "25.255.0.1", "_@-.%"]
    for _ in range(15_000):
        t = "".join(rng.choice(rng.choice(bits)) for _ in range(rng.randint(0, 50))) + rng.choice(["", "", "4111 1111 1111 1111", "+1 (456) 555-2186", "x.y@mail.example.com", "001.002.003.004"])
        assert P.base_spans(t) == brute(t), t
    assert P.base_spans("a" * 400_000 + "1" * 400_000 + "@" * 1000) == []  # linear


def test_query_against_brute_force(documents):
    got = {r.doc_id: r for r in P.digest(P.find(documents)).collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        spans = brute(t)
        text = ",".join(f"{P.KINDS[a]}:{b}:{c}" for a, b, c in spans)
        assert [got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone] == [sum(a == x for a, *_ in spans) for x in range(4)]
        assert got[k].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(got[k].spans.split(","))
        more = [x for x in got[k].spans.split(",") if x.startswith("secret")]
        assert more == [f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer(r'token = "([0-9a-f]{40})"', t)] and got[k].n_spans == len(spans) + got[k].n_more


def scores(rows, rounds=P.ROUNDS):
    """Scoring by plain loops: rows of pattern, instance, seed."""
    edges = {}
    for p, i, s in rows:
        edges[p, i] = edges.get((p, i), False) or s
    seed = {i: any(v for (_, j), v in edges.items() if j == i) for _, i in edges}
    conf, found, last = {i: float(s) for i, s in seed.items()}, {}, {}
    for _ in range(rounds):
        found = {}
        for p in {p for p, _ in edges}:
            mine = [i for q, i in edges if q == p]
            if sum(edges[p, i] for i in mine) >= P.MIN_SEEDS:
                found[p] = sum(conf[i] for i in mine) / (len(mine) + 1)
        if last and max(abs(found[p] - last[p]) for p in found) <= P.SETTLED:
            break
        last = found
        for i in conf:
            doubt = 1.0
            for q, j in edges:
                if j == i and q in found:
                    doubt *= 1 - min(found[q], 0.999)
            conf[i] = max(float(seed[i]), 1 - doubt)
    return found


def test_scores_against_loops(spark):
    rng = random.Random(3)
    seeds = set(range(8))
    rows = [(p, i, i in seeds) for p in range(12) for i in rng.sample(range(20), rng.randint(1, 9))]
    got = {r.pattern: r.score for r in P.score(spark.createDataFrame(rows, "pattern long, instance long, seed boolean")).collect()}
    want = scores(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_contexts_have_no_limits():
    long = "w" * 5000
    t = f"{long} {long}x 12345 {long} end"
    a = t.index("12345")
    assert P._before(t, a) == (long, long + "x", "") and P._after(t, a + 5) == (long, "end")
    assert P._before("12345", 0) == ("", "", "") and P._after("12345", 5) == ("", "")
    assert P._before("a b id=77", 7) == ("b", "id=", "id=") and P._shape("x.92@Mail2.é_") == "a.9@Aa9.a_"


def test_secrets_seed_their_context(spark):
    rng = random.Random(8)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(6)]
    rows = [(k, f'some words {k} token = "{h}" more words') for k, h in enumerate(hexes)]
    rows += [(50, 'other text token = "hunter2-not-hex" here'), (51, "commit deadbeef 1234567 stays")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in P.digest(P.find(df)).collect()}
    assert all(got[k].spans.startswith("secret:") and got[k].n_more == 1 for k in range(6))
    assert got[50].spans == "id:20:35" and got[51].spans == ""
    assert {r.text for r in P.redact(df).where("doc_id < 6").collect()} == {f'some words {k} token = "[SECRET]" more words' for k in range(6)}


def test_recovers_hidden_seeds(spark):
    """A quarter of the entities is hidden; where contexts repeat, the patterns of the others find them again."""
    words = "alpha beta gamma delta epsilon".split()
    rows = [(k, f"{words[k % 5]} write to mail {k}.x@h{k % 7}.example.com or 10.{k}.2.{k % 9} at the {words[k % 3]}") for k in range(120)]
    r = P.recovered(spark.createDataFrame(rows, "doc_id long, text string")).first()
    assert r.hidden > 40 and r.found == r.hidden and r.others == 0
    noise = [(k, f"w{chr(97 + k % 26)}{chr(97 + k % 23)} 10.{k}.2.3 v{chr(97 + k % 19)}") for k in range(60)]
    r = P.recovered(spark.createDataFrame(noise, "doc_id long, text string")).first()
    assert r.hidden > 5 and r.others == 0


def test_contexts_discover_identifiers(spark):
    rows = [(k, f"hello call me at +1 (456) 555-{1000 + k} please") for k in range(9)] + [(k, f"ref={k}@mail.example.com;") for k in range(20, 26)]
    rows += [(100, "now call me at K-99123-Z please"), (101, "the number 7712345 is fine"), (102, "ref=ZX-88")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in P.digest(P.find(df)).where("doc_id >= 100").collect()}
    assert got == {100: "id:15:24", 101: "", 102: "id:4:9"}
    clean = {r.doc_id: r.text for r in P.redact(df).collect()}
    assert clean[100] == "now call me at [ID] please" and clean[101] == "the number 7712345 is fine" and clean[1] == "hello call me at [PHONE] please" and clean[20] == "ref=[EMAIL];"


def test_nasty_rows(nasty):
    got = P.digest(P.find(nasty))
    assert got.count() == nasty.count()
    rows = {(r.doc_id, r.text): r for r in nasty.collect()}
    assert {(r.doc_id, r.base_sha256) for r in got.collect()} == {(d, hashlib.sha256(",".join(f"{P.KINDS[a]}:{b}:{c}" for a, b, c in brute(t or "")).encode()).hexdigest()) for d, t in rows}
    clean = P.redact(nasty)
    assert clean.columns == nasty.columns and clean.count() == nasty.count()
    for t in {r.text for r in clean.select("text").collect()}:
        assert not brute(t or "") or "[" in t
    assert collected(clean.where("text is null").select("doc_id", "source")) == collected(nasty.where("text is null").select("doc_id", "source"))
    assert P.digest(P.find(nasty.limit(0))).count() == 0 and P.redact(nasty.limit(0)).count() == 0
