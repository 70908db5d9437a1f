"""Words, shingles and hashes for the operators on text; runs in the Arrow workers."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs of letters or digits.
WORD = re.compile(r"[^\W_]+")
SHINGLE = 5
_MULTIPLIERS = np.array([xxhash.xxh64_intdigest(str(i)) | 1 for i in range(64)], dtype=np.uint64)


@lru_cache(maxsize=1 << 17)
def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(word_hash, words), dtype=np.uint64, count=len(words))


_ASCII = {i: chr(i) if chr(i).isalnum() else " " for i in range(128)}


def lower_words(text: str) -> list[str]:
    """Lower-cased runs of letters or digits; ASCII texts take a faster way."""
    return text.lower().translate(_ASCII).split() if text.isascii() else WORD.findall(text.lower())


def plain_words(text: str) -> list[str]:
    """The same with character entities resolved."""
    return lower_words(html.unescape(text) if "&" in text else text)


def shingles(hashed: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash for each run of ``size`` words; empty when there are fewer words."""
    n = len(hashed) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=np.uint64)
        for i in range(size):
            out += hashed[i : i + n] * _MULTIPLIERS[i]
        out ^= out >> np.uint64(31)
        out *= _MULTIPLIERS[63]
    return out


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, with one machine word per row of bits."""
    if not a or not b:
        return 0
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    rows = full
    for y in b:
        u = rows & at.get(y, 0)
        rows = ((rows + u) | (rows - u)) & full
    return len(a) - rows.bit_count()


class Lexicon:
    """Properties of the words seen so far, as arrays by number; forgotten when there are too many."""

    MOST = 400_000

    def __init__(self, properties: Callable[[str], tuple], kinds: tuple) -> None:
        self.properties = properties
        self.numbers: dict[str, int] = {}
        self.columns = tuple(np.zeros(1024, dtype=kind) for kind in kinds)

    def _add(self, word: str) -> None:
        n = self.numbers[word] = len(self.numbers)
        if n == len(self.columns[0]):
            self.columns = tuple(np.concatenate((c, np.zeros_like(c))) for c in self.columns)
        for column, value in zip(self.columns, self.properties(word), strict=True):
            column[n] = value

    def look_up(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """An array for each property."""
        if len(self.numbers) > self.MOST:
            self.numbers.clear()
        try:
            numbers = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        except KeyError:
            for w in words:
                if w not in self.numbers:
                    self._add(w)
            numbers = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        return tuple(c[numbers] for c in self.columns)


class Bitmap:
    """A set of 64-bit hashes as a bitmap of fixed size (4 MB): it has every hash put in, and by chance few others. It only saves work: what passes is joined exactly.

    With ``n`` different hashes in it, a foreign one passes with probability 1 - exp(-n / 2**25): 3 % at a million, nearly all from a hundred million on.
    """

    BITS = 25

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @classmethod
    def _place(cls, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            spot = (hashed * _MULTIPLIERS[62]) >> np.uint64(64 - cls.BITS)
        return (spot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63))

    @classmethod
    def of(cls, hashed: DataFrame) -> Bitmap:
        """From a table with one column, an array of hashes as longs. Partial bitmaps meet word by word; the driver gets 2**19 rows at most."""
        (column,) = hashed.columns

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words = np.zeros(1 << (cls.BITS - 6), dtype=np.uint64)
            for pdf in batches:
                found = [x for x in pdf[column] if x is not None and len(x)]
                if found:
                    np.bitwise_or.at(words, *cls._place(np.concatenate(found).astype(np.int64).view(np.uint64)))
            kept = np.flatnonzero(words)
            yield pd.DataFrame({"word": kept, "bits": words[kept].view(np.int64)})

        by_word = hashed.mapInPandas(partial, "word long, bits long").groupBy("word").agg(
            F.bit_or("bits").alias("bits")
        )
        words = np.zeros(1 << (cls.BITS - 6), dtype=np.uint64)
        found = by_word.toArrow().to_pandas()
        words[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.int64).view(np.uint64)
        return cls(words)

    def has(self, hashed: np.ndarray) -> np.ndarray:
        word, bit = self._place(hashed)
        return (self.words[word] & bit) != 0
