"""Character n-grams of many texts at once, as numpy arrays."""

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Characters worked on together; texts are cut between words into parts of this size, never shortened.
CHARACTERS = 300_000


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


def letter_codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, lower case, every run of non-letters as one 0; and the
    number of the text that each belongs to. The row begins and ends with 0."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\0".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    owner = np.repeat(np.arange(len(lowered) + 1), [1, *[len(t) + 1 for t in lowered]])
    codes = np.where(letter_table()[codes], codes, 0)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep].astype(np.uint64), np.maximum(owner[keep] - 1, 0)


def windows(codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The n shifted views of all windows of n characters without a gap inside, and their texts.

    A gap may stand at either end, so that beginnings and ends of words are told apart; a window never
    holds letters of two texts.
    """
    count = max(0, len(codes) - n + 1)
    inside = np.ones(count, dtype=bool)
    for i in range(1, n - 1):
        inside &= codes[i : i + count] != 0
    if n == 1:
        inside &= codes[:count] != 0
    elif n == 2:
        inside &= (codes[:count] != 0) | (codes[1 : 1 + count] != 0)
    at = np.nonzero(inside)[0]
    middle = owner[at + (1 if n > 2 else 0)]
    return [codes[at + i] for i in range(n)], middle


def parts(texts: Sequence[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(numbers, texts) of bounded size; a very long text comes in several parts, cut after a space."""
    numbers: list[int] = []
    held: list[str] = []
    size = 0
    for number, text in enumerate(texts):
        begin = 0
        while begin < len(text) or not begin:
            end = begin + CHARACTERS
            if end < len(text):
                end = text.rfind(" ", begin + 1, end) + 1 or end
            piece = text[begin:end] if begin or end < len(text) else text
            if held and size + len(piece) > CHARACTERS:
                yield np.array(numbers), held
                numbers, held, size = [], [], 0
            numbers.append(number)
            held.append(piece)
            size += len(piece)
            begin = max(end, 1)
    if held:
        yield np.array(numbers), held
