"""Programme loudness and range after ITU-R BS.1770 and EBU Tech 3342."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from phonoduct.kernels.spectral import filtered


@dataclass(frozen=True)
class Ebur128:
    i: float
    lra_low: float
    lra_high: float

    def __str__(self) -> str:
        return f"I={self.i:.2f}, LRA_low={self.lra_low:.2f}, LRA_high={self.lra_high:.2f}"


def k_weighting(rate: float):
    """Response of the head shelf and the high-pass at any rate."""
    k = np.tan(np.pi * 1681.974450955533 / rate)
    q, high = 0.7071752369554196, 10 ** (3.999843853973347 / 20)
    mid = high**0.4996667741545416
    a0 = 1 + k / q + k * k
    shelf = np.array([high + mid * k / q + k * k, 2 * (k * k - high), high - mid * k / q + k * k]) / a0, np.array([a0, 2 * (k * k - 1), 1 - k / q + k * k]) / a0
    k, q = np.tan(np.pi * 38.13547087602444 / rate), 0.5003270373238773
    a0 = 1 + k / q + k * k
    high_pass = np.array([1.0, -2.0, 1.0]), np.array([a0, 2 * (k * k - 1), 1 - k / q + k * k]) / a0

    def response(w: np.ndarray) -> np.ndarray:
        z = np.exp(-1j * w)[:, None] ** np.arange(3)
        return (z @ shelf[0]) / (z @ shelf[1]) * (z @ high_pass[0]) / (z @ high_pass[1])

    return response


def _blocks(power: np.ndarray, rate: float, seconds: float) -> np.ndarray:
    """Mean power of windows of ``seconds`` every 0.1 s."""
    size, hop = int(round(seconds * rate)), int(round(0.1 * rate))
    c = np.append(0, np.cumsum(power))
    a = np.arange(0, len(power) - size + 1, hop)
    return (c[a + size] - c[a]) / size


def _level(p: np.ndarray) -> np.ndarray:
    return -0.691 + 10 * np.log10(np.maximum(p, 1e-20))


def ebur128(x: np.ndarray, rate: float) -> Ebur128 | None:
    """Integrated loudness (400 ms blocks, gates at -70 LUFS and 10 LU under the mean) and the 10 % and 95 % points of the
    short-term loudness (3 s, gates at -70 LUFS and 20 LU under the mean); -70 where nothing passes the gates."""
    power = filtered(np.asarray(x, float), k_weighting(rate), rate) ** 2

    def gated(p: np.ndarray, below: float) -> np.ndarray:
        p = p[_level(p) > -70]
        return p[_level(p) > _level(p.mean()) - below] if len(p) else p

    main, short = gated(_blocks(power, rate, 0.4), 10), gated(_blocks(power, rate, 3.0), 20)
    low, high = np.percentile(_level(short), [10, 95]) if len(short) else (-70.0, -70.0)
    return Ebur128(float(_level(main.mean())) if len(main) else -70.0, float(low), float(high))
