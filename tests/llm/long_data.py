"""Long texts for tests."""

import random


def one_byte(n: int) -> str:
    return "x" * n


def sentences(seed: int, n: int) -> str:
    """n words that no other seed has in the same order."""
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)) + " "
