"""Words of a text, remembered by number so that features are made once a word, not once a use."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np

#: Distinct words a Python worker remembers before it starts afresh.
KEEP_WORDS = 200_000
#: Characters of text that are taken together.
CHUNK_CHARS = 1_000_000


class WordRows:
    """Rows of features by word. ``make`` gives an array with a row for each of some new words."""

    def __init__(self, make: Callable[[list[str]], np.ndarray], keep: int = KEEP_WORDS):
        self.make, self.keep = make, keep
        self.number: dict[str, int] = {}
        self.rows = make([])

    def chunks(self, texts: list[str]) -> Iterator[list[np.ndarray]]:
        """For runs of texts, the word numbers of each; numbers hold until the next run."""
        at = 0
        while at < len(texts):
            lists, size = [], 0
            while at < len(texts) and size < CHUNK_CHARS:
                size += len(texts[at])
                lists.append(texts[at].split())
                at += 1
            if len(self.number) > self.keep:
                self.number, self.rows = {}, self.make([])
            new = list(set().union(*lists).difference(self.number))
            if new:
                self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
                self.rows = np.concatenate([self.rows, self.make(new)])
            number = self.number
            yield [np.fromiter([number[w] for w in words], np.int64, len(words)) for words in lists]


def ngram_buckets(word: str, sizes: tuple[int, ...], buckets: int) -> list[int]:
    """Buckets of a word and of its character n-grams (in UTF-8, with marks at both ends)."""
    raw = b"<" + word.encode("utf-8", "surrogatepass") + b">"
    crc, n = zlib.crc32, len(raw)
    return [crc(raw) % buckets] + [crc(raw[i : i + k], k) % buckets for k in sizes for i in range(n - k + 1)]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
