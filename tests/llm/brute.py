"""Plain Python versions of the contracts, written apart from the operators."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def term_fingerprint(text: str) -> int:
    """The weighted word-pair SimHash."""
    found, counts, total = WORD.findall(text), [0] * 64, 0
    for i, a in enumerate(found):
        h, w = xxhash.xxh64_intdigest(a.encode(), 42), 1 + (len(a) > 3)
        if i + 1 < len(found):
            b = found[i + 1]
            h, w = xxhash.xxh64_intdigest(b.encode(), h), w + (len(b) > 3)
        total += w
        for bit in range(64):
            counts[bit] += w * (h >> bit & 1)
    return sum(1 << b for b in range(64) if 2 * counts[b] > total)


def shingle_fingerprint(text: str) -> int:
    """The contract's SimHash over three-word shingles."""
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] if len(found) > 2 else [" ".join(found)][: len(found)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(fps: dict[int, int], radius: int = 2) -> dict[int, int]:
    """The smallest id reachable over links within the radius, by comparing all pairs."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    values = np.array([fps[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= radius):
            a, b = find(i), find(ids[k + 1 + j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def base_secrets(text: str) -> list[tuple[int, int, str]]:
    """The base spans, straight from the contract's patterns."""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(a, b, k) for a, _, b, k in sorted(found)]


def tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return made


def pieces(ids: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """``(start, length, crc)`` of a document's pieces."""
    ids = [*ids, 0]
    first = len(ids) if len(ids) <= capacity else (len(ids) - 1) % capacity + 1
    cuts = [(0, first)] + [(a, capacity) for a in range(first, len(ids), capacity)]
    return [(a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for a, n in cuts]


def best_fit_bins(lengths: list[int], capacity: int) -> list[int]:
    """The rooms left by best-fit decreasing, one piece at a time."""
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, r in enumerate(rooms) if r >= n]
        if fit:
            k = min(fit, key=lambda k: rooms[k])
            rooms[k] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)
