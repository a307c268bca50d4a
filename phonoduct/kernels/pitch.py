"""Pitch tracking in the manner of Harvest, with refinement and an aperiodicity gate (Morise 2016, 2017).

Follows the published outline: band-passed zero crossings give candidates, instantaneous frequency of the first
harmonics scores and refines them, contours that are too short or jump are dropped. Not bit-equal to other programs.
"""

from __future__ import annotations

import numpy as np

from phonoduct.kernels.spectral import resample

CHANNELS = 40  # an octave
INNER = 8_000.0


def _band(n: int, rate: float, f: float) -> np.ndarray:
    """Spectrum of a Nuttall window of four periods, moved to f."""
    half = int(round(2 * rate / f))
    t = np.arange(-half, half + 1)
    w = sum(c * np.cos(k * np.pi * t / half) for k, c in enumerate((0.355768, 0.487396, 0.144232, 0.012604)))
    h = w * np.cos(2 * np.pi * f * t / rate)
    h /= np.abs((h * np.exp(-2j * np.pi * f * t / rate)).sum())
    return np.fft.rfft(np.roll(np.pad(h, (0, n - len(h))), -half))


def _contour(s: np.ndarray, rate: float, times: np.ndarray) -> np.ndarray:
    """Frequency from the spacing of upward zero crossings, at the given times; NaN outside."""
    i = np.flatnonzero((s[:-1] < 0) & (s[1:] >= 0))
    if len(i) < 3:
        return np.full(len(times), np.nan)
    at = (i - s[i] / (s[i + 1] - s[i])) / rate
    return np.interp(times, (at[1:] + at[:-1]) / 2, 1 / np.diff(at), np.nan, np.nan)


def candidates(x: np.ndarray, rate: float, times: np.ndarray, floor: float, ceil: float) -> np.ndarray:
    """(bands, frames) frequencies where rising, falling, peak and dip spacings of a band agree with its centre; else NaN."""
    n = 1 << int(len(x) + 4 * rate / floor + 2).bit_length()
    spec = np.fft.rfft(x, n)
    bands = floor * 0.9 * 2 ** (np.arange(int(np.log2(ceil * 1.1 / (floor * 0.9)) * CHANNELS) + 1) / CHANNELS)
    out = np.full((len(bands), len(times)), np.nan)
    for b, f in enumerate(bands):
        s = np.fft.irfft(spec * _band(n, rate, f), n)[: len(x)]
        d = np.diff(s)
        four = np.stack([_contour(v, rate, times) for v in (s, -s, d, -d)])
        mean, spread = four.mean(axis=0), four.max(axis=0) - four.min(axis=0)
        good = (np.abs(mean / f - 1) < 0.1) & (spread < 0.1 * mean) & (mean >= floor) & (mean <= ceil)
        out[b] = np.where(good, mean, np.nan)
    return out


def instantaneous(x: np.ndarray, rate: float, times: np.ndarray, f: np.ndarray, harmonics: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(refined frequency, score) of guesses at times: power-weighted instantaneous frequency of the first harmonics."""
    refined, score = np.full(len(f), np.nan), np.zeros(len(f))
    known = np.flatnonzero(np.isfinite(f))
    for part in (known[i : i + 256] for i in range(0, len(known), 256)):
        g = f[part, None]
        half = int(np.ceil(1.5 * rate / g.min()))
        k = np.arange(-half, half + 1)
        t = k / rate
        u = np.clip(t * g / 1.5, -1, 1)  # windows end where |u| = 1
        w = 0.42 + 0.5 * np.cos(np.pi * u) + 0.08 * np.cos(2 * np.pi * u)
        dw = -(g / 1.5) * np.pi * (0.5 * np.sin(np.pi * u) + 0.16 * np.sin(2 * np.pi * u))
        v = x[np.clip(np.rint(times[part] * rate).astype(int)[:, None] + k, 0, len(x) - 1)]
        turn = np.exp(-2j * np.pi * g * t)
        amps, insts, cur = [], [], np.ones_like(turn)
        for h in range(1, harmonics + 1):
            cur = cur * turn
            a, b = (cur * (w * v)).sum(1), (cur * (dw * v)).sum(1)
            power = np.abs(a) ** 2
            amps.append(np.sqrt(power))
            insts.append((h * g[:, 0] - (b * np.conj(a)).imag / np.maximum(power, 1e-30) / (2 * np.pi)) / h)
        amp, inst = np.stack(amps), np.stack(insts)
        all_ = amp.sum(0)
        heard = all_ > 0
        some = np.where(heard, all_, 1)
        refined[part] = np.where(heard, (amp * inst).sum(0) / some, np.nan)
        off = (amp * np.abs(inst - g[:, 0]) / g[:, 0]).sum(0) / some
        score[part] = np.where(heard, 1 / (1e-3 + off), 0)
    return refined, score


def periodic_power(x: np.ndarray, rate: float, times: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Share of the power from 100 to 4000 Hz among that up to 7900 Hz; high for voiced frames."""
    out = np.zeros(len(f))
    for k in np.flatnonzero(f > 0):
        half = int(np.ceil(1.5 * rate / f[k]))
        i = np.clip(int(round(times[k] * rate)) + np.arange(-half, half + 1), 0, len(x) - 1)
        p = np.abs(np.fft.rfft(x[i] * np.blackman(len(i)), 4096)) ** 2
        hz = np.arange(len(p)) * rate / 4096
        all_, low = p[(hz > 100) & (hz < 7900)].sum(), p[(hz > 100) & (hz < 4000)].sum()
        out[k] = low / all_ if all_ > 0 else 0
    return out


def track(x: np.ndarray, rate: float, frame_period: float = 5.0, floor: float = 71.0, ceil: float = 800.0, kind: str = "world") -> np.ndarray:
    """Hz at k * frame_period ms, 0 where unvoiced. ``world`` refines, ``true_world`` doesn't, ``refine_world`` also drops aperiodic frames."""
    if kind not in ("world", "true_world", "refine_world"):
        raise ValueError("kind is world, true_world or refine_world")
    x = np.asarray(x, float)
    times = np.arange(int(1000 * len(x) / rate / frame_period) + 1) * frame_period / 1000
    out = np.zeros(len(times))
    if len(x) < 4 * rate / floor or not np.any(x):
        return out
    inner = resample(x, rate, INNER) if rate > INNER else x
    inner_rate = min(rate, INNER)
    inner = inner - inner.mean()
    cand = candidates(inner, inner_rate, times, floor, ceil)
    # neighbouring bands that agree make one candidate
    best, best_score = np.full(len(times), np.nan), np.zeros(len(times))
    have = np.isfinite(cand)
    for _ in range(4):
        n = have.sum(axis=0)
        pick = np.where(n > 0, np.argmax(have, axis=0), 0)
        f = np.where(n > 0, cand[pick, np.arange(len(times))], np.nan)
        near = have & (np.abs(cand / f - 1) < 0.06)
        support = near.sum(axis=0)
        f = np.where(support > 0, np.nansum(np.where(near, cand, 0), axis=0) / np.maximum(support, 1), np.nan)
        refined, score = instantaneous(inner, inner_rate, times, f)
        score = np.where(support >= CHANNELS // 10, score * np.minimum(support, 10), 0)
        better = score > best_score
        best, best_score = np.where(better, refined if kind != "true_world" else f, best), np.where(better, score, best_score)
        have &= ~near
    ok = np.isfinite(best) & (best >= floor) & (best <= ceil)
    out[ok] = best[ok]
    # contours: neighbours within 10 %, at least 4 frames or 1.5 periods long
    linked = np.zeros(len(out), bool)
    linked[1:] = (out[1:] > 0) & (out[:-1] > 0) & (np.abs(out[1:] / np.maximum(out[:-1], 1e-9) - 1) < 0.1)
    run = np.cumsum(~linked)
    size = np.bincount(run)[run]
    out[size < max(4, int(6 / (floor * frame_period / 1000)) // 4)] = 0
    if kind == "refine_world":
        out[periodic_power(x, rate, times, out) < 0.5] = 0
    return out
