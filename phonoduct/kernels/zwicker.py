"""Loudness of time-varying sounds after ISO 532-1 (Zwicker), in sone every 2 ms.

The third-octave filters and the smoothing of levels are applied as frequency responses of the standard's shape rather
than by its table of filter coefficients.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

RATE, OUT = 48_000, 500

# Tables of the standard.
# centre frequencies step by a third of an octave from 25 Hz to 12.5 kHz
RAP = np.array([45, 55, 65, 71, 80, 90, 100, 120.0])
DLL = np.array([
    [-32, -24, -16, -10, -5, 0, -7, -3, 0, -2, 0], [-29, -22, -15, -10, -4, 0, -7, -2, 0, -2, 0], [-27, -19, -14, -9, -4, 0, -6, -2, 0, -2, 0],
    [-25, -17, -12, -9, -3, 0, -5, -2, 0, -2, 0], [-23, -16, -11, -7, -3, 0, -4, -1, 0, -1, 0], [-20, -14, -10, -6, -3, 0, -4, -1, 0, -1, 0],
    [-18, -12, -9, -6, -2, 0, -3, -1, 0, -1, 0], [-15, -10, -8, -4, -2, 0, -3, -1, 0, -1, 0],
], float)
LTQ = np.array([30, 18, 12, 8, 7, 6, 5, 4, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3.0])
A0 = np.array([0, 0, 0, 0, 0, 0, 0, 0, 0, 0, -0.5, -1.6, -3.2, -5.4, -5.6, -4, -1.5, 2, 5, 12])
DDF = np.array([0, 0, 0.5, 0.9, 1.2, 1.6, 2.3, 2.8, 3, 2, 0, -1.4, -2, -1.9, -1, 0.5, 3, 4, 4.3, 4])
DCB = np.array([-0.25, -0.6, -0.8, -0.8, -0.5, 0, 0.5, 1.1, 1.5, 1.7, 1.8, 1.8, 1.7, 1.6, 1.4, 1.2, 0.8, 0.5, 0, -0.5])
ZUP = np.array([0.9, 1.8, 2.8, 3.5, 4.4, 5.4, 6.6, 7.9, 9.2, 10.6, 12.3, 13.8, 15.2, 16.7, 18.1, 19.3, 20.6, 21.8, 22.7, 23.6, 24.0])
RNS = np.array([21.5, 18.0, 15.1, 11.5, 9.0, 6.1, 4.4, 3.1, 2.13, 1.36, 0.82, 0.42, 0.30, 0.22, 0.15, 0.10, 0.035, 0.0])
USL = np.array([
    [13.0, 8.2, 6.3, 5.5, 5.5, 5.5, 5.5, 5.5], [9.0, 7.5, 6.0, 5.1, 4.5, 4.5, 4.5, 4.5], [7.8, 6.7, 5.6, 4.9, 4.4, 3.9, 3.9, 3.9], [6.2, 5.4, 4.6, 4.0, 3.5, 3.2, 3.2, 3.2],
    [4.5, 3.8, 3.6, 3.2, 2.9, 2.7, 2.7, 2.7], [3.7, 3.0, 2.8, 2.35, 2.2, 2.2, 2.2, 2.2], [2.9, 2.3, 2.1, 1.9, 1.8, 1.7, 1.7, 1.7], [2.4, 1.7, 1.5, 1.35, 1.3, 1.3, 1.3, 1.3],
    [1.95, 1.45, 1.3, 1.15, 1.1, 1.1, 1.1, 1.1], [1.5, 1.2, 0.94, 0.86, 0.82, 0.82, 0.82, 0.82], [0.72, 0.67, 0.64, 0.63, 0.62, 0.62, 0.62, 0.62], [0.59, 0.53, 0.51, 0.50, 0.42, 0.42, 0.42, 0.42],
    [0.40, 0.33, 0.26, 0.24, 0.24, 0.22, 0.22, 0.22], [0.27, 0.21, 0.20, 0.18, 0.17, 0.17, 0.17, 0.17], [0.16, 0.15, 0.14, 0.12, 0.11, 0.11, 0.11, 0.11], [0.12, 0.11, 0.10, 0.08, 0.08, 0.08, 0.08, 0.08],
    [0.09, 0.08, 0.07, 0.06, 0.06, 0.06, 0.06, 0.05], [0.06, 0.05, 0.03, 0.02, 0.02, 0.02, 0.02, 0.02],
])


@lru_cache(maxsize=2)
def _responses(n: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(step, band, smoothing) of the 28 third octaves; a band is followed at 1 / step of the rate, 16 times its centre or more."""
    width = 2 ** (1 / 6) - 2 ** (-1 / 6)
    out = []
    for k in range(28):
        fm = 1000 * 2 ** ((k - 16) / 3)
        step = max(s for s in (1, 2, 4, 8, 16) if s == 1 or RATE / s >= 16 * fm)
        f = np.maximum(np.arange(n // step // 2 + 1) * (RATE / n), 1e-3)
        one = 1 / (1 + 2j * np.pi * f * (2 / (3 * min(fm, 1000))))
        ratio = (f / fm - fm / f) / width
        out.append((step, 1 / np.sqrt(1 + (ratio * ratio) ** 3), one * one * one))
    return out


def band_levels(x: np.ndarray, tail: float = 0.25) -> np.ndarray:
    """(frames, 28) third-octave levels in dB re 20 µPa every 2 ms of a 48 kHz signal in Pa."""
    n = 1 << (len(x) + int(tail * RATE) - 1).bit_length()
    frames = -(-len(x) // (RATE // OUT))
    spectrum, out = np.fft.rfft(x, n), []
    for step, band, smooth in _responses(n):
        m, slow = n // step, n // max(step, 8)  # smoothed powers hold nothing above a few hundred Hz
        power = np.fft.irfft(spectrum[: m // 2 + 1] * band, m) / step
        power = np.fft.rfft(power * power) * smooth
        power = np.fft.irfft(power[: slow // 2 + 1], slow) * (slow / m)
        out.append(10 * np.log10(np.maximum(power[:: RATE // OUT * slow // n][:frames], 1e-12) / 4e-10))
    return np.stack(out, axis=1)


def core_loudness(levels: np.ndarray, field: str) -> np.ndarray:
    """(frames, 21) main loudness of the critical bands."""
    low = levels[:, :11]
    step = np.minimum((low[:, None, :] > RAP[None, :, None] - DLL[None]).sum(axis=1), 7)
    power = 10 ** ((low + DLL[step, np.arange(11)]) / 10)
    joined = np.stack([power[:, :6].sum(1), power[:, 6:9].sum(1), power[:, 9:11].sum(1)], axis=1)
    le = np.concatenate([10 * np.log10(np.maximum(joined, 1e-12)), levels[:, 11:28]], axis=1) - A0
    if field == "diffuse":
        le = le + DDF
    heard = le > LTQ
    le = le - DCB
    core = 0.0635 * 10 ** (0.025 * LTQ) * ((0.75 + 0.25 * 10 ** (0.1 * (le - LTQ))) ** 0.25 - 1)
    core = np.where(heard, np.maximum(core, 0), 0)
    core[:, 0] *= np.minimum(0.4 + 0.32 * core[:, 0] ** 0.2, 1)
    return np.concatenate([core, np.zeros((len(core), 1))], axis=1)


def nonlinear_decay(core: np.ndarray, steps: int = 24) -> np.ndarray:
    """Decay of the critical bands after loud moments: two coupled capacitors, ``steps`` steps a frame.

    ``core`` is (frames, bands), where the bands may be those of many waves.
    """
    short, long, var = 0.005, 0.015, 0.075
    dt = 1 / (OUT * steps)
    p, q = (var + long) / (var * short), 1 / (short * var)
    l1, l2 = -p / 2 + np.sqrt(p * p / 4 - q), -p / 2 - np.sqrt(p * p / 4 - q)
    den, e1, e2 = var * (l1 - l2), np.exp(l1 * dt), np.exp(l2 * dt)
    b0, b1 = (e1 - e2) / den, ((var * l2 + 1) * e1 - (var * l1 + 1) * e2) / den
    b2, b3 = ((var * l1 + 1) * e1 - (var * l2 + 1) * e2) / den, (var * l1 + 1) * (var * l2 + 1) * (e1 - e2) / den
    b4, b5 = np.exp(-dt / long), np.exp(-dt / var)
    o, u = np.zeros(core.shape[1]), np.zeros(core.shape[1])
    out = np.empty_like(core)
    after = np.append(core[1:], np.zeros((1, core.shape[1])), axis=0)
    for t in range(len(core)):
        for s in range(steps):
            x = core[t] + (after[t] - core[t]) * (s / steps)
            falling, charged = x < o, o > u
            new = np.where(falling, np.maximum(x, np.where(charged, o * b2 - u * b3, o * b4)), x)
            u = np.where(falling, np.where(charged, np.minimum(o * b0 - u * b1, new), new), np.where(new > u, (u - x) * b5 + x, x))
            o = new
            if s == 0:
                out[t] = o
    return out


def total(core: np.ndarray) -> np.ndarray:
    """Loudness of each frame: area under the specific loudness, whose upper slopes fall as the tables say."""
    rns, usl, ends = RNS.tolist(), USL.tolist(), (ZUP + 0.0001).tolist()
    out = np.zeros(len(core))
    for t, c in enumerate(core.tolist()):
        if not any(c):
            continue
        n = z1 = n1 = 0.0
        j = 17
        for i in range(21):
            top, level = ends[i], c[i]
            g = min(max(i - 1, 0), 7)
            while z1 < top:
                if n1 > level:
                    n2 = max(rns[j], level)
                    z2 = z1 + (n1 - n2) / usl[j][g]
                    if z2 > top:
                        z2, n2 = top, n1 - (top - z1) * usl[j][g]
                    n += (z2 - z1) * (n1 + n2) / 2
                else:
                    if n1 < level:
                        j = next(k for k, r in enumerate(rns) if r <= level)
                    z2, n2 = top, level
                    n += n2 * (z2 - z1)
                while n2 <= rns[j] and j < 17:
                    j += 1
                z1, n1 = z2, n2
        out[t] = max(n, 0.0)
    return out


def weighted_in_time(n: np.ndarray, steps: int = 24) -> np.ndarray:
    """Duration weighting of (frames, waves): two low-passes (3.5 ms and 70 ms) in parallel."""
    fast, slow = (np.exp(-1 / (OUT * steps * tau)) for tau in (0.0035, 0.07))
    a, b = np.zeros(n.shape[1]), np.zeros(n.shape[1])
    out, after = np.empty_like(n), np.append(n[1:], np.zeros((1, n.shape[1])), axis=0)
    for t in range(len(n)):
        for s in range(steps):
            x = n[t] + (after[t] - n[t]) * (s / steps)
            a, b = fast * a + (1 - fast) * x, slow * b + (1 - slow) * x
            if s == 0:
                out[t] = 0.47 * a + 0.53 * b
    return out


def loudness_many(xs: list[np.ndarray], field: str = "diffuse") -> list[np.ndarray]:
    """Loudness in sone every 2 ms of 48 kHz signals in Pa; ``field`` is free or diffuse. The waves pass the recursions side by side."""
    if field not in ("free", "diffuse"):
        raise ValueError("field is free or diffuse")
    out: list[np.ndarray] = [np.zeros(0)] * len(xs)
    by_length = sorted((k for k in range(len(xs)) if len(xs[k])), key=lambda k: len(xs[k]))
    for part in (by_length[i : i + 64] for i in range(0, len(by_length), 64)):
        cores = [core_loudness(band_levels(np.asarray(xs[k], float)), field) for k in part]
        frames = max(map(len, cores))
        side = np.concatenate([np.pad(c, ((0, frames - len(c)), (0, 0))) for c in cores], axis=1)
        decayed = nonlinear_decay(side).reshape(frames, len(part), 21)
        n = weighted_in_time(np.stack([total(decayed[:, i]) for i in range(len(part))], axis=1))
        for i, k in enumerate(part):
            out[k] = n[: len(cores[i]), i]
    return out


def loudness(x: np.ndarray, field: str = "diffuse") -> np.ndarray:
    return loudness_many([x], field)[0]
