import hashlib
import io
import wave
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import media as m


@settings(deadline=None, max_examples=50)
@given(st.binary(max_size=3000))
def test_wav_holds_the_bytes(payload):
    stored = m.to_wav(payload)
    assert m.from_wav(stored) == payload
    with wave.open(io.BytesIO(stored)) as w:
        assert (w.getsampwidth(), w.getnchannels(), w.getnframes()) == (1, 1, len(payload))


def test_a_tone_has_its_peak_and_pairs():
    k = 30  # cycles in a frame
    tone = (128 + 100 * np.sin(2 * np.pi * k / m.FRAME * np.arange(4096))).astype(np.uint8).tobytes()
    p = m.peaks(tone)
    assert (p[:-1, 2] == k).all()
    codes = m.fingerprint(tone)
    first = codes[codes >> 32 == 0]
    assert {(c >> 18 & 0x3FFF, c >> 10 & 0xFF, c >> 2 & 0xFF, c & 3) for c in first.tolist()} >= {(2, k, k, gap) for gap in (1, 2, 3)}
    assert (np.diff(codes) >= 0).all()


def test_long_recordings_in_blocks(monkeypatch):
    x = np.random.default_rng(1).integers(0, 256, 20_000).astype(np.uint8).tobytes()
    whole = m.fingerprint(x)
    monkeypatch.setattr(m, "FRAMES_AT_A_TIME", 7)
    assert (m.fingerprint(x) == whole).all() and len(whole)


def test_rows(spark):
    texts = {1: None, 2: "", 3: "a" * 64, 4: "a" * 65, 5: "é😀", 6: "a" * 64, None: "x", 7: "long text " * 40_000}
    df = spark.createDataFrame([(i, t, b"m") for i, t in texts.items()], "doc_id long, text string, media binary")
    rows = {r["id"]: r for r in m.media_features(m.media_column(df)).collect()}
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert m.from_wav(bytes(r["media"])) == payload and r["fingerprint"] == m.fingerprint(payload).tolist()
    assert rows[3]["feature"] == rows[6]["feature"] and rows[1]["feature"] == rows[2]["feature"]
    assert m.media_features(m.media_column(df.limit(0))).count() == 0
