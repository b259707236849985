import random
import wave
from io import BytesIO

import numpy as np

from mediashoal.llm import media, queries
from tests.llm.docs import clashing, documents, rows


def brute_peaks(payload):
    frames = 1
    while (frames - 1) * 128 + 256 < len(payload):
        frames += 1
    x = [b - 128.0 for b in payload] + [0.0] * ((frames - 1) * 128 + 256 - len(payload))
    m = np.array([np.abs(np.fft.rfft(np.array(x[k * 128 : k * 128 + 256], np.float32) * media.HANN)) for k in range(frames)], np.float32)
    m[:, 0] = 0
    out = []
    for t in range(frames):
        for f in range(1, 128):
            v = m[t, f]
            times = [*([m[t - 1, f]] if t else []), *([m[t + 1, f]] if t + 1 < frames else [])]
            if v >= media.OVER_MEAN * m[t].mean() and v > m[t, f - 1] and v > m[t, f + 1] and all(v >= a for a in times):
                out.append((t, f))
    return out


def brute_pairs(found):
    return [(t, f << 14 | g << 6 | u - t) for i, (t, f) in enumerate(found) for u, g in found[i + 1 : i + 1 + media.FAN] if u - t <= media.MAX_GAP]


def test_wav_round_trip():
    for data in (b"", b"x", bytes(range(256)) * 5, b"y" * 64):
        stored = media.to_wav(media.pad(data))
        back = media.from_wav(stored)
        assert len(back) % 64 == 0 and back and back[: len(data)] == data and not any(back[len(data) :])
        with wave.open(BytesIO(stored)) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getnframes()) == (1, 1, len(back))
    assert media.from_wav(None) is media.from_wav(b"no") is None


def test_fingerprint_equals_brute_force(monkeypatch):
    rng = random.Random(1)
    payloads = [media.pad((r[1] or "").encode()) for r in rows() if len(r[1] or "") < 6000] + [bytes(rng.randrange(256) for _ in range(64 * k)) for k in (1, 3, 5, 60)]
    for block in (3, media.BLOCK):
        monkeypatch.setattr(media, "BLOCK", block)
        for p in payloads:
            times, pairs = media.fingerprint(p)
            assert list(zip(times.tolist(), pairs.tolist(), strict=True)) == brute_pairs(brute_peaks(p))


def test_tone_is_found():
    tone = bytes((128 + 100 * np.sin(2 * np.pi * 20 * np.arange(256 * 8) / 256)).astype(np.uint8))
    assert set(media.peaks(tone)[1].tolist()) >= {20}


def test_rows(spark):
    got = media.decode(media.encode(clashing(documents(spark), "media", "payload"))).collect()
    want = sorted(str((r[0], media.pad((r[1] or "").encode()), len((r[1] or "").encode()))) for r in rows())
    assert sorted(str((r["doc_id"], bytes(r["payload"]), r["n_bytes"])) for r in got) == want
    digests = queries.media_digests(documents(spark)).collect()
    assert len({tuple(r)[1:] for r in digests if r["n_bytes"] == 0}) == 1
    assert media.decode(media.encode(documents(spark, []))).count() == 0
