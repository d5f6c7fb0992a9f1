"""Plain Python versions of the operators, for small inputs."""

import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def groups(rows, size, percent=80):
    """The least id of each row's group, by comparing all sets."""
    sets = {key: shingles(text, size) for key, text in rows}
    parent = {key: key for key in sets}

    def find(key):
        while parent[key] != key:
            key = parent[key]
        return key

    keys = list(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {key: (len(sets[key]), find(key)) for key in keys}


class NGrams:
    def __init__(self, texts, order, discount=0.75):
        self.order, self.discount = order, discount
        self.count = [Counter() for _ in range(order + 1)]
        for text in texts:
            tokens = self.tokens(text)
            for size in range(1, order + 1):
                for k in range(len(tokens) - size + 1):
                    self.count[size][tuple(tokens[k : k + size])] += 1
        self.followers = Counter(gram[:-1] for size in range(2, order + 1) for gram in self.count[size])
        words = {gram: n for gram, n in self.count[1].items() if gram != ("<s>",)}
        self.total, self.distinct = sum(words.values()), len(words)

    @staticmethod
    def tokens(text):
        return ["<s>", *WORD.findall((text or "").translate(LOWER)), "</s>"]

    def chance(self, context, word):
        if not context:
            return (self.count[1][(word,)] + 1) / (self.total + self.distinct + 1)
        seen, lower = self.count[len(context)][context], self.chance(context[1:], word)
        if not seen:
            return lower
        own = max(self.count[len(context) + 1][(*context, word)] - self.discount, 0) / seen
        return own + self.discount * self.followers[context] / seen * lower

    def score(self, text, order=None):
        tokens, size = self.tokens(text), order or self.order
        return sum(math.log10(self.chance(tuple(tokens[max(0, k - size + 1) : k]), tokens[k])) for k in range(1, len(tokens)))


def repeated_spans(texts, length=200):
    raw = [(text or "").encode() for text in texts]
    seen = Counter(data[k : k + length] for data in raw for k in range(len(data) - length + 1))
    found = []
    for data in raw:
        marks = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if seen[data[k : k + length]] > 1:
                marks[k : k + length] = b"\1" * length
        found.append([(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(marks))])
    return raw, found


def quality_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines, earlier, double = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            double += line in earlier
            earlier.add(line)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), double, len(covered)
