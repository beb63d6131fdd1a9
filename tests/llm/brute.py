"""Plain Python versions of what the operators compute."""

import collections
import re

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def space_words(text):
    return SPACE.findall(text or "")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def quality_counts(text):
    text = text or ""
    w = space_words(text)
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    seen = collections.defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i:i + 5])].append(i)
    inside = {k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    n = len(w)
    return dict(n_words=n, word_chars=sum(map(len, w)), n_symbols=len(re.findall(r"[#*$%&|<>]", text)),
                n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(inside),
                base_failed=n < 10 or 100 * len(inside) > 20 * n)


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def similarity_classes(docs):
    """{doc_id: (set size, smallest reachable doc_id)} of (doc_id, text) by comparing all pairs that share a shingle."""
    sets = {d: shingle_set(t) for d, t in docs}
    places = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            places[g].append(d)
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for d, s in sets.items():
        common = collections.Counter(e for g in s for e in places[g] if e < d)
        for e, o in common.items():
            if 100 * o >= 80 * (len(s) + len(sets[e]) - o):
                a, b = find(d), find(e)
                top[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def alnum_words(text):
    return ALNUM.findall(ascii_lower(text))


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]
