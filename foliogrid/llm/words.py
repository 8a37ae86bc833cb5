"""Words of many texts at a time, as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: ASCII white space, as ``bytes.split`` takes it.
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: Masks of the first 0 to 8 bytes of a little-endian integer.
FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes, starts, buffer)`` of the words of the texts, A-Z lowered, in order.

    ``starts`` are places in ``buffer``, which holds the lowered texts, each followed by a line break.
    """
    joined = b"\n".join([*texts, b"\0" * 8]).lower()
    buffer = np.frombuffer(joined, np.uint8)
    n = len(buffer) - 8
    # the first place counts as after white space, and every text ends with a break
    edge = np.diff(SPACE[buffer[:n]].view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = ends - starts
    eight = np.ndarray((n + 1,), "<u8", joined, strides=(1,))
    h = mixed((eight[starts] & FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * M2)
    left = np.flatnonzero(size > 8)
    for at in range(8, LONG, 8):
        if not len(left):
            break
        h[left] = mixed(h[left] ^ (eight[starts[left] + at] & FIRST[np.minimum(size[left] - at, 8)]))
        left = left[size[left] > at + 8]
    for i in left.tolist():
        h[i] = xxhash.xxh64_intdigest(joined[starts[i] : ends[i]])
    return h, starts, buffer[:n]


def distinct_by_owner(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an ascending small ``owner`` and a value, sorted, each once."""
    # one fast sort of a prefix of both unless it leaves unequal values tied
    brief = (owner.astype(np.uint64) << np.uint64(40)) | (values >> np.uint64(24))
    order = np.argsort(brief, kind="stable")
    brief, sorted_ = brief[order], values[order]
    if ((brief[1:] == brief[:-1]) & (sorted_[1:] != sorted_[:-1])).any() or (len(owner) and owner[-1] >= 1 << 24):
        order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], values[new]


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(values, sizes)``: the distinct shingles of ``k`` words of each text, one text after the other.

    A text of fewer words has one shingle of all of them, a text without words has none.
    """
    hashes, starts, _ = word_hashes(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, ends)
    words = np.diff(upto, prepend=0)
    owner = np.repeat(np.arange(len(texts)), words)
    acc = np.full(max(len(hashes) - k + 1, 0), k, np.uint64)
    for j in range(k):
        acc = mixed(acc + hashes[j : j + len(acc)])
    whole = owner[: len(acc)] == owner[k - 1 : k - 1 + len(acc)]
    owners, values = owner[: len(acc)][whole], acc[whole]
    short = np.flatnonzero((words > 0) & (words < k))
    if len(short):
        few = np.empty(len(short), np.uint64)
        for at, i in enumerate(short.tolist()):
            h = np.array([words[i]], np.uint64)
            for j in range(upto[i] - words[i], upto[i]):
                h = mixed(h + hashes[j])
            few[at] = h[0]
        owners, values = np.concatenate([owners, short]), np.concatenate([values, few])
        order = np.argsort(owners, kind="stable")
        owners, values = owners[order], values[order]
    owners, values = distinct_by_owner(owners, values)
    return values, np.bincount(owners, minlength=len(texts))
