"""Kernels for convolution: band-pass FIR taps and complex Morlet wavelets."""

from __future__ import annotations

import numpy as np

# Fixed value: taps needed by a Hamming window, in periods of the transition width.
HAMMING_FACTOR = 3.3


def hamming_length(transition_hz: float, rate: float) -> int:
    """Odd number of taps that reaches the transition width."""
    n = int(round(HAMMING_FACTOR * rate / transition_hz))
    return n + 1 - n % 2


def lowpass(cutoff_hz: float, length: int, rate: float) -> np.ndarray:
    """Hamming-windowed sinc with unit gain at 0 Hz."""
    n = np.arange(length) - length // 2
    fc = 2.0 * cutoff_hz / rate
    taps = fc * np.sinc(fc * n) * (0.54 + 0.46 * np.cos(2 * np.pi * n / (length - 1)))
    return taps / taps.sum()


def bandpass(
    low_hz: float,
    high_hz: float,
    rate: float,
    low_transition: float = 2.0,
    high_transition: float = 2.0,
) -> np.ndarray:
    """Difference of two low-passes with cutoffs in the middle of the transitions."""
    parts = [
        (high_hz + high_transition / 2, hamming_length(high_transition, rate), 1.0),
        (low_hz - low_transition / 2, hamming_length(low_transition, rate), -1.0),
    ]
    taps = np.zeros(max(n for _, n, _ in parts))
    for cutoff, n, sign in parts:
        at = (len(taps) - n) // 2
        taps[at : at + n] += sign * lowpass(cutoff, n, rate)
    return taps


def default_transitions(low_hz: float, high_hz: float, rate: float) -> tuple[float, float]:
    """Transition widths when none are given: a quarter of the edge, at least 2 Hz,
    and never past 0 Hz or half the sampling rate."""
    low = min(max(low_hz * 0.25, 2.0), low_hz)
    high = min(max(high_hz * 0.25, 2.0), rate / 2.0 - high_hz)
    return low, high


def morlet(frequency: float, rate: float, cycles: float = 7.0) -> np.ndarray:
    """Complex Morlet wavelet: a Gaussian of ``cycles`` / (2 pi f) seconds around exp(2 pi i f t).

    Taps lie at k / rate for integers |k| below five deviations; the norm is sqrt(2).
    """
    deviation = cycles / (2 * np.pi * frequency)
    reach = max(1, int(np.ceil(5 * deviation * rate)))
    phase = np.arange(1 - reach, reach) / rate
    taps = np.exp(-0.5 * (phase / deviation) ** 2) * np.exp(2j * np.pi * frequency * phase)
    return taps * np.sqrt(2 / np.sum(np.abs(taps) ** 2))
