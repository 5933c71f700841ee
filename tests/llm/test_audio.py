import hashlib
import os
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow.parquet as pq
import pytest

from inkweave.llm import audio as A


def adpcm(block):
    now, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [now]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = A._STEPS[index]
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            now = max(-32768, min(32767, now - change if code & 8 else now + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(now)
    return out


def mulaw(code):
    code = ~code & 255
    size = ((code & 15) << 3) + 132 << (code >> 4 & 7)
    return -(size - 132) if code & 128 else size - 132


def alaw(code):
    code ^= 0x55
    power, low = code >> 4 & 7, (code & 15) << 4
    size = low + 8 if not power else low + 264 << power - 1
    return size if code & 128 else -size


def test_tables_and_blocks():
    assert A.MULAW.tolist() == [mulaw(c) for c in range(256)] and A.ALAW.tolist() == [alaw(c) for c in range(256)]
    data = np.random.default_rng(1).integers(0, 256, 64 * 40, dtype=np.uint8)
    assert A.decode_blocks(data).tolist() == [adpcm(bytes(data[k : k + 64])) for k in range(0, len(data), 64)]
    assert A.decode_blocks(data[:1280], 256).shape == (5, 505)


def test_resampling():
    x = np.random.default_rng(2).integers(-32768, 32768, 500).astype(np.int16)
    off = np.array([0, 1, 3, 100, 500])
    wide, to = A.resample(x, off, 2)
    assert (A.double(x, off) == wide).all() and to.tolist() == (2 * off).tolist() and (wide[::2] == x).all()
    for a, b in zip(off, off[1:]):  # files don't touch each other
        assert (A.resample(x[a:b], np.array([0, b - a]), 2)[0] == wide[2 * a : 2 * b]).all()
    assert len(A.resample(x, np.array([0, 500]), 3, 2)[0]) == 750


@pytest.mark.parametrize("codec", list(A.TAGS))
def test_wav_round_trip(codec):
    payload = bytes(range(64)) * 3
    got = A.read_wav(A.wav(payload, codec, 170))
    assert (got[0], got[1], got[3], bytes(got[4])) == (codec, 8000, 170, payload)


def test_broken_files():
    whole = A.wav(bytes(64), "mulaw", 64)
    for bad in (b"", b"RIFF", whole[:40], whole[:-1], whole.replace(b"data", b"dada"), whole[:20] + b"\x01" + whole[21:]):
        with pytest.raises(ValueError):
            A.read_wav(bad)


def check(rows, got):
    want = []
    for doc, text in rows:
        data = (text or "").encode()
        full = data + bytes(-len(data) % 64 if data else 64)
        media = A.wav(full, "mulaw", len(data))
        want.append((doc, len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]), len(media), hashlib.sha256(media).hexdigest()))
    assert sorted(map(str, (tuple(r)[:7] for r in got))) == sorted(map(str, want))


def test_documents(documents):
    got = A.round_trip(documents).collect()
    check([(r.doc_id, r.text) for r in documents.collect()], got)
    r = min(got, key=lambda r: r.n_bytes)
    text = next(d.text for d in documents.collect() if d.doc_id == r.doc_id).encode()
    x = [mulaw(c) for c in text + bytes(r.payload_bytes - len(text))]
    turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
    assert r.feature.startswith(f"mulaw:{sum(v * v for v in x)},{turns},{max(map(abs, x))};alaw:")


def twice(x):
    """Twice the rate: between two samples -1 9 9 -1 over 16, ends repeated."""
    at = lambda k: x[max(0, min(len(x) - 1, k))]
    out = []
    for k, v in enumerate(x):
        out += [v, max(-32768, min(32767, (9 * (v + at(k + 1)) - at(k - 1) - at(k + 2) + 8) >> 4))]
    return out


def told(x):
    return f"{sum(v * v for v in x)},{sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))},{max(map(abs, x))}"


def test_all_features_by_plain_loops(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect() if len(r.text) < 1500] + [(-1, None), (-2, "é" * 31)]
    got = {r.doc_id: r.feature for r in A.round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(rows) > 50
    for k, t in rows:
        data = (t or "").encode()
        data += bytes(-len(data) % 64 if data else 64)
        mu = [mulaw(c) for c in data]
        wide = np.array(twice(mu), "<i2").tobytes()
        blocks = [v for b in range(0, len(data), 64) for v in adpcm(data[b : b + 64])]
        assert got[k] == f"mulaw:{told(mu)};alaw:{told([alaw(c) for c in data])};adpcm:{told(blocks)};pcm16k:{zlib.crc32(wide):08x}"


def test_stored_pcm(spark):
    df = spark.createDataFrame([(1, "some bytes of a text"), (2, None)], "doc_id long, text string")
    plain = {"mulaw": lambda d: [mulaw(c) for c in d], "alaw": lambda d: [alaw(c) for c in d], "adpcm": adpcm}
    for codec, expand in plain.items():
        kept = A.store_pcm(A.store(df, codec))
        assert "MapInArrow" not in kept._jdf.queryExecution().toString()
        for r in kept.collect():
            data = (b"some bytes of a text" if r.doc_id == 1 else b"").ljust(64, b"\0")
            assert r.pcm == np.array(twice(expand(data)), "<i2").tobytes() and (r.rate, r.codec, r.error) == (16000, codec, None)


def test_query_stores_pcm(spark):
    """The query's PCM of all three readings is in the table that its features are worked out from."""
    rows = [(1, "some bytes of a text"), (2, None), (3, "é" * 700), (None, "x")]
    got = A.round_trip(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = {r.doc_id: r for r in spark.read.parquet(*got.inputFiles()).collect()}
    assert got.count() == len(kept) == 4
    for k, t in rows:
        data = (t or "").encode()
        data += bytes(-len(data) % 64 if data else 64)
        blocks = [v for b in range(0, len(data), 64) for v in adpcm(data[b : b + 64])]
        for name, x in (("pcm_mulaw", map(mulaw, data)), ("pcm_alaw", map(alaw, data)), ("pcm_adpcm", blocks)):
            assert kept[k][name] == np.array(twice(list(x)), "<i2").tobytes()


def groups(got):
    """Files of the query's PCM table, and (rows, raw bytes) of their row groups."""
    files = [urlparse(f).path for f in got.inputFiles()]
    metas = [pq.ParquetFile(f).metadata for f in files]
    return files, [(m.row_group(k).num_rows, m.row_group(k).total_byte_size) for m in metas for k in range(m.num_row_groups)]


def test_stored_pcm_is_dense(documents):
    """15 bytes of PCM to a byte of payload take less than 3 on disk."""
    got = A.round_trip(documents.coalesce(1))
    payload = sum(r.payload_bytes for r in got.collect())
    files, parts = groups(got)
    assert sum(n for _, n in parts) > 15 * payload
    assert sum(map(os.path.getsize, files)) < 3 * payload


def test_row_groups_stay_small(spark):
    """Long texts after short ones: a row group ends within eight rows of its limit."""
    rows = [(k, "short text " * 9) for k in range(300)] + [(k, f"{k} long " * 40_000) for k in range(300, 330)]
    got = A.round_trip(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).sortWithinPartitions("doc_id"))
    parts = groups(got)[1]
    assert got.count() == sum(n for n, _ in parts) == 330
    assert max(n for n, _ in parts) <= 512 and max(size for _, size in parts) < (32 << 20) + 8 * 16 * 400_000


def test_decode(spark):
    df = spark.createDataFrame([(1, None), (2, "ab" * 40), (None, "é")], "doc_id long, text string")
    for codec in A.TAGS:
        got = A.decode(A.store(df, codec)).collect()
        assert {r.codec for r in got} == {codec} and all(r.rate == 16000 and len(r.pcm) == 2 * r.n_samples and r.error is None for r in got)
    media = spark.createDataFrame([(1, None), (2, b"junk")], "doc_id long, media binary")
    assert [(r.doc_id, r.pcm, r.error) for r in A.decode(media).orderBy("doc_id").collect()] == [(1, None, "null"), (2, None, "no RIFF WAVE header")]


def test_nasty_rows(nasty):
    got = A.round_trip(nasty).collect()
    check([(r.doc_id, r.text) for r in nasty.collect()], got)
    same = {}
    for r in got:
        assert same.setdefault(r.payload_sha256 + str(r.n_bytes), tuple(r)[1:]) == tuple(r)[1:]
    assert A.round_trip(nasty.limit(0)).count() == 0
