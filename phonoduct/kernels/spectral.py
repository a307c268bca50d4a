"""Short-time spectra in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Centred frames over the zero-padded signal, one per row."""
    padded = np.pad(x, size // 2)
    return np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]


def magnitudes(x: np.ndarray, n_fft: int, win_length: int, hop: int) -> np.ndarray:
    """|STFT| as (frames, n_fft // 2 + 1); the window is centred in the transform."""
    w = np.zeros(n_fft)
    a = (n_fft - win_length) // 2
    w[a : a + win_length] = hann(win_length)
    f = frames(x, n_fft, hop)
    return np.concatenate([np.abs(np.fft.rfft(f[i : i + 512] * w, axis=1)) for i in range(0, len(f), 512)]) if len(f) else np.zeros((0, n_fft // 2 + 1))


def mel_of(hz: np.ndarray) -> np.ndarray:
    """Mel scale that is linear up to 1 kHz (200/3 Hz a mel) and logarithmic above (ln 6.4 / 27 a mel)."""
    hz = np.asarray(hz, float)
    return np.where(hz < 1000, hz * 3 / 200, 15 + np.log(np.maximum(hz, 1000) / 1000) * 27 / np.log(6.4))


def hz_of(mel: np.ndarray) -> np.ndarray:
    mel = np.asarray(mel, float)
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


@lru_cache(maxsize=8)
def mel_matrix(rate: int, n_fft: int, n_mels: int, fmin: float, fmax: float) -> np.ndarray:
    """Triangles of equal area, (n_mels, n_fft // 2 + 1)."""
    edge = hz_of(np.linspace(mel_of(fmin), mel_of(fmax), n_mels + 2))
    f = np.arange(n_fft // 2 + 1) * rate / n_fft
    up = (f - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None]
    down = (edge[2:, None] - f) / (edge[2:] - edge[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edge[2:] - edge[:-2]))[:, None]


def log_mel(
    x: np.ndarray, rate: int, preemph: float | None = None, n_mels: int = 80, n_fft: int = 2048, win_length: int = 1024, hop: int = 256, fmin: float = 125,
    fmax: float = 12000, min_level: float = 1e-5, max_level: float | None = None, normalize: bool = True,
) -> np.ndarray:
    """Log-compressed mel spectrogram, (1 + n // hop, n_mels) float32; normalised to 0..1 unless told otherwise."""
    x = np.asarray(x, float)
    if preemph is not None:
        x = x - preemph * np.append(0, x[:-1])
    m = magnitudes(x, n_fft, win_length, hop) @ mel_matrix(rate, n_fft, n_mels, fmin, fmax).T
    low = np.log(min_level)
    y = np.log(np.maximum(m, min_level))
    if max_level is not None:
        y = np.minimum(y, np.log(max_level))
    if normalize:
        y = np.clip((y - low) / -low, 0, 1) if max_level is None else (y - low) / (np.log(max_level) - low)
    return y.astype(np.float32)


def resample(x: np.ndarray, source: float, target: float, zeros: int = 32) -> np.ndarray:
    """Band-limited resampling by a Hann-windowed sinc with ``zeros`` zero crossings a side; ceil(n * target / source) samples."""
    x = np.asarray(x, float)
    if source == target or not len(x):
        return x
    n = int(np.ceil(len(x) * target / source))
    cut = min(1.0, target / source)
    half = int(np.ceil(zeros / cut))
    padded = np.pad(x, half + 1)
    out = np.empty(n)
    taps = np.arange(-half, half + 1)
    for a in range(0, n, 16_384):
        t = np.arange(a, min(a + 16_384, n)) * source / target
        i = np.floor(t).astype(int)
        d = taps - (t - i)[:, None]
        w = np.where(np.abs(d) * cut < zeros, 0.5 + 0.5 * np.cos(np.pi * d * cut / zeros), 0.0)
        out[a : a + len(t)] = (padded[i[:, None] + half + 1 + taps] * np.sinc(d * cut) * w).sum(axis=1) * cut
    return out


def filtered(x: np.ndarray, response, rate: float, tail: float = 1.0) -> np.ndarray:
    """A filter given by its frequency response (of angular frequency a sample), applied as one product of spectra."""
    n = len(x) + int(tail * rate)
    n = 1 << (n - 1).bit_length()
    w = 2 * np.pi * np.arange(n // 2 + 1) / n
    return np.fft.irfft(np.fft.rfft(x, n) * response(w), n)[: len(x)]
