"""Plain counterparts of the operators over lists of (id, text)."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = SPACE_WORDS.findall(text)
    lines = [x for x in text.split("\n") if SPACE_WORDS.search(x)]
    places = defaultdict(list)
    for i in range(len(words) - 4):
        places[tuple(words[i:i + 5])].append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def licences(text, phrases):
    words = ALNUM_WORDS.findall(low(text))
    places, labels = [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def leaks(docs, bench, window=10):
    """id -> n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = defaultdict(set)
    for item, text in bench:
        w = ALNUM_WORDS.findall(low(text))
        for i in range(max(1, len(w) - window + 1)):
            if w:
                windows[tuple(w[i:i + window])].add(str(item))
    sizes = {len(k) for k in windows}
    out = {}
    for doc, text in docs:
        w = ALNUM_WORDS.findall(low(text))
        hit, items = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                key = tuple(w[i:i + size])
                if key in windows:
                    hit |= set(range(i, i + size))
                    items |= windows[key]
        out[doc] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    return out


def substrings(docs, window=50):
    """id -> n_words, n_removed, kept_sha256."""
    first = {}
    split = [(doc, SPACE_WORDS.findall(text or "")) for doc, text in docs]
    for doc, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = {}
    for doc, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i:i + window])] < doc:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def near(docs, threshold=75):
    """id -> n_shingles, component_id, kept."""
    sets = {}
    for doc, text in docs:
        w = SPACE_WORDS.findall(low(text))
        sets[doc] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    lists = defaultdict(list)
    for doc, s in sets.items():
        for x in s:
            lists[x].append(doc)
    common = Counter((a, b) for ds in lists.values() for i, a in enumerate(ds) for b in ds[i + 1:])
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}
