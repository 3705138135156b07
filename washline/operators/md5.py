"""md5 of many short texts at once, as numpy arrays; the same digests as Spark's and SQL's ``md5``.

``run_digests`` hashes ``id|prefix run`` for many ids and runs. Texts of one length share the place of their
suffix, so a run changes only a few of the sixteen words of a block; a text that does not fit one block goes to hashlib.
"""

from __future__ import annotations

import hashlib

import numpy as np

ONE_BLOCK = 55          # bytes that fit one block, with their length
TOGETHER = 8_192        # digests that are worked out in one array
_U = np.uint32
_K = np.floor(np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * 2.0 ** 32).astype(np.uint64).astype(_U)
_SHIFTS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_START = [_U(0x67452301), _U(0xEFCDAB89), _U(0x98BADCFE), _U(0x10325476)]


def _one_block(words: list, shape: tuple[int, int]) -> np.ndarray:
    """(4, *shape) digest words of blocks; ``words``: sixteen arrays that broadcast to ``shape``."""
    a, b, c, d = (np.full(shape, v, _U) for v in _START)
    f, t = np.empty(shape, _U), np.empty(shape, _U)
    for i in range(64):
        kind, at = divmod(i, 16)
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            at = (7 * i) % 16
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        np.add(a, words[at] + _K[i], out=a)
        s = _SHIFTS[kind][i % 4]
        np.left_shift(a, _U(s), out=t)
        np.right_shift(a, _U(32 - s), out=a)
        np.bitwise_or(a, t, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return np.stack([x + v for x, v in zip((a, b, c, d), _START)])


def run_digests(ids: list[bytes], suffixes: list[bytes]):
    """(rows, first suffix, digest words (4, suffixes, rows)) of ``id|suffix``, piece by piece, each pair once.

    The first word, its bytes turned round, is the number of the first eight hex digits.
    """
    sizes = np.array([len(x) for x in ids], np.int64)
    with np.errstate(over="ignore"):
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            for lo in range(0, len(rows), TOGETHER):
                yield from _same_size([ids[i] for i in rows[lo:lo + TOGETHER].tolist()], rows[lo:lo + TOGETHER], size, suffixes)


def _same_size(texts: list[bytes], rows: np.ndarray, size: int, suffixes: list[bytes]):
    n = len(rows)
    if size + 1 + max(map(len, suffixes)) > ONE_BLOCK:
        for k, x in enumerate(suffixes):
            raw = b"".join([hashlib.md5(t + b"|" + x).digest() for t in texts])
            yield rows, k, np.ascontiguousarray(np.frombuffer(raw, "<u4").reshape(n, 4).T)[:, None, :]
        return
    block = np.zeros((n, 64), np.uint8)
    block[:, :size] = np.frombuffer(b"".join(texts), np.uint8).reshape(n, size)
    fixed = np.ascontiguousarray(block.view("<u4").T).astype(_U)
    step = max(1, TOGETHER // n)
    for k in range(0, len(suffixes), step):
        some = suffixes[k:k + step]
        tails = np.zeros((len(some), 64), np.uint8)
        for j, x in enumerate(some):
            end = size + 1 + len(x)
            tails[j, size:end + 1] = np.frombuffer(b"|" + x + b"\x80", np.uint8)
            tails[j, 56:] = np.frombuffer((8 * end).to_bytes(8, "little"), np.uint8)
        tail = tails.view("<u4").astype(_U)
        words = [fixed[i][None, :] + tail[:, i, None] if 4 * i < size else tail[:, i, None] for i in range(16)]
        yield rows, k, _one_block(words, (len(some), n))


def hex_texts(words: np.ndarray) -> list[str]:
    """The hex digests of (4, n) digest words."""
    raw = np.ascontiguousarray(words.T).astype("<u4").tobytes().hex()
    return [raw[i:i + 32] for i in range(0, len(raw), 32)]
