"""Plain counterparts of the run, encoding and code operators."""

import hashlib
import re
import zlib
from fractions import Fraction

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def tail(doc, words):
    h = zlib.crc32(str(doc).encode())
    n, g = len(words), h // 10
    if doc is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def runs(words):
    """(start, length, period) of all runs, by trying every period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)         # ascending periods: the first is the smallest
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(doc, text, edit=tail):
    """n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    words = edit(doc, SPACE_WORDS.findall(text or ""))
    found = runs(words)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(words, found))]
    return len(found), *best, 1000 * best[1] // best[2] if found else None, *sha
