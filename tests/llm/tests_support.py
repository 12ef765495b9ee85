"""Invented texts and plain sets for the tests."""

import numpy as np

from tidemill.llm import kernel as K


def prose(rng, n):
    return " ".join("".join(rng.choice(list("aeioubcdlmnrst"), rng.integers(2, 8))) for _ in range(n))


def shingle_set(text):
    low = bytes(K.LOWER[np.frombuffer((text or "").encode(), np.uint8)]).split()
    return {tuple(low[k : k + 5]) for k in range(len(low) - 4)} if len(low) >= 5 else ({tuple(low)} if low else set())
