"""Plain versions of the operators, which the tests compare with."""

import hashlib
import re
from collections import Counter

import numpy as np


def decontaminated(text: str | None, items: list[tuple[str, str]], window: int = 8) -> tuple[int, int, int, str]:
    """(n_words, n_hit, n_items, items_sha256) by comparing every position with every window."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    ws, hit, found = cut(text), set(), set()
    for name, t in items:
        it = cut(t)
        for x in range(max(1, len(it) - window + 1) if it else 0):
            w = it[x : x + window]
            for s in range(len(ws) - len(w) + 1):
                if ws[s : s + len(w)] == w:
                    hit |= set(range(s, s + len(w)))
                    found.add(name)
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def shingles(text: str) -> Counter:
    """The multiset of five-word shingles."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 5 + 1))) if w else Counter()


def near_classes(texts: list[str]) -> list[int]:
    """The class (least index) of each text by comparing all pairs."""
    sets = [shingles(t) for t in texts]
    cls = list(range(len(texts)))

    def root(x):
        while cls[x] != x:
            x = cls[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            inter, union = sum((sets[i] & sets[j]).values()), sum((sets[i] | sets[j]).values())
            if texts[i] == texts[j] or (union and inter / union >= 0.8):
                a, b = sorted((root(i), root(j)))
                cls[b] = a
    return [root(i) for i in range(len(texts))]


def rules_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """COUNTS of one text, plainly."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def repeated_bytes(texts: list[bytes], length: int = 100) -> list[np.ndarray]:
    """Which bytes of each text (in order of ids) go."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            x = t[s : s + length]
            if x in seen:
                gone[s : s + length] = True
            seen.add(x)
        out.append(gone)
    return out
