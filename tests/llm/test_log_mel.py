"""Operator 2's features against plain loops: resampling by its sum, a direct Fourier sum, filters band by band, segments frame by frame."""

import cmath
import math

import numpy as np

from strandwise.llm import media


def resampled(x):
    """24 to 16 kHz: output n lies at input 1.5 n; 32 taps of a windowed sinc at two thirds of the band, their sum being one."""
    out = []
    for n in range(math.ceil(len(x) * 2 / 3)):
        at = n * 1.5
        whole = math.floor(at)
        taps, values = [], []
        for j in range(whole - 15, whole + 17):
            t = j - at
            u = t * 2 / 3
            sinc = 1.0 if u == 0 else math.sin(math.pi * u) / (math.pi * u)
            taps.append(sinc * math.cos(math.pi * t / 34) ** 2)
            values.append((x[j] - 128) / 128 if 0 <= j < len(x) else 0.0)
        out.append(sum(a * b for a, b in zip(taps, values)) / sum(taps))
    return out


def frames_of(y):
    n = max(0, math.ceil((len(y) - 400) / 160)) + 1
    for f in range(n):
        yield [(y[f * 160 + i] if f * 160 + i < len(y) else 0.0) * (0.5 - 0.5 * math.cos(2 * math.pi * i / 399)) for i in range(400)]


def mel_bands(power):
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    hertz = lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [hertz(mel(20) + (mel(8000) - mel(20)) * i / 41) for i in range(42)]
    out = []
    for b in range(40):
        lo, mid, hi = edges[b : b + 3]
        total = 0.0
        for k, p in enumerate(power):
            f = k * 16000 / 512
            if lo < f < hi:
                total += p * ((f - lo) / (mid - lo) if f <= mid else (hi - f) / (hi - mid))
        out.append(math.log(total + 1e-8))
    return out


def test_log_mel_and_the_feature_string(make_docs):
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("abc zé"), 700)) + " " * 500 + "zzz" * 100
    data = text.encode()
    payload = data + b" " * (-len(data) % 192)
    y = resampled(payload)
    mels, energy = [], []
    for frame in frames_of(y):
        power = [abs(sum(v * cmath.exp(-2j * math.pi * k * i / 512) for i, v in enumerate(frame))) ** 2 for k in range(257)]
        mels.append(mel_bands(power))
        energy.append(10 * math.log10(sum(v * v for v in frame) / 400 + 1e-10))
    got, level = media.log_mel(payload)
    assert got.shape == (len(mels), 40) and np.abs(got - np.array(mels)).max() < 1e-3 and np.abs(level - np.array(energy)).max() < 1e-6
    # hysteresis: on within 3 dB of the loudest frame, off more than 9 dB below it
    spans, on = [], False
    for f, e in enumerate([*energy, -math.inf]):
        if not on and e >= max(energy) - 3:
            on, begin = True, f
        elif on and e < max(energy) - 9:
            on = False
            spans.append((begin, f))
    voiced = sum(round(1000 * (((end - 1) * 160 + 400) / 16000 - begin * 160 / 16000)) for begin, end in spans)
    means = [sum(m[b] for m in mels) / len(mels) for b in range(40)]
    bands = ",".join(str(round(sum(means[5 * i : 5 * i + 5]) / 5 * 4)) for i in range(8))
    row = media.media_digest(media.audio_features(make_docs([(1, text)]))).first()
    assert row.feature == f"frames={len(mels)};segments={len(spans)};voiced_ms={voiced};bands={bands}"
