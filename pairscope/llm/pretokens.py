"""The split of a text that byte-level vocabularies expect, for many texts at once.

The classes of characters are those of the library that the vocabularies are for (other libraries know other versions of
Unicode): it is asked once which characters it takes for letters, numbers and spaces. Where words start follows from
neighbouring classes: a run of letters, numbers or other marks takes one plain space before it; of a run of white space
before something else the last character stands alone (or goes with what follows, if a plain space); endings such as 's
stand alone.
"""

from __future__ import annotations

import functools

import numpy as np
import tiktoken

# fixed values: the endings that stand alone, and the classes of characters
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
OTHER, LETTER, NUMBER, SPACE, STOP = 0, 1, 2, 3, 4


@functools.cache
def _classes() -> np.ndarray:
    table = np.full(0x110001, OTHER, np.uint8)
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        # an encoding of single bytes drops what its pattern does not match
        one = tiktoken.Encoding(f"class {kind}", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(one.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    table[0x110000] = STOP
    return table


def split(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The words of all texts in order, and how many each text has."""
    lengths = np.array([len(t) for t in texts], np.int64)
    joined = "\n".join(texts) + "\n"
    point = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    stops = np.cumsum(lengths + 1) - 1
    point[stops] = 0x110000
    kind = _classes()[point]
    n = len(kind)
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start[stops] = True
    plain = point == 32
    # runs of white space that something other than the end follows
    at = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != STOP))
    start[at] = True
    start[at[plain[at]] + 1] = False
    # endings
    mark = np.flatnonzero((point == 39) & start)
    mark = mark[mark + 1 < n]
    for ending in ENDINGS:
        fits = mark[mark + len(ending) <= n]
        for k, c in enumerate(ending):
            fits = fits[point[fits + k] == ord(c)]
        start[fits + 1] = False
        start[fits + len(ending)] = True
    start[stops] = True
    first = np.flatnonzero(start)
    ends = np.append(first[1:], n)
    real = kind[first] != STOP
    where = np.searchsorted(stops, first[real])
    return [joined[a:b] for a, b in zip(first[real].tolist(), ends[real].tolist())], np.bincount(where, minlength=len(texts))
