"""What is a line's shingle, a band and a similar pair: fixed for both styles of ``lines``."""

from __future__ import annotations

SHINGLE = 8
BANDS = 6
ROWS = 3
SIMILAR = 0.8
#: Words of 64 bits that a line's marks take.
WORDS = 32
#: XOR constants of the signatures: multiples of the golden ratio's 64-bit fraction.
MASKS = [0x9E3779B97F4A7C15 * (i + 1) % (1 << 64) for i in range(BANDS * ROWS)]
