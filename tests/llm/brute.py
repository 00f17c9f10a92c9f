"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def folded_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def ngrams(text, width=4):
    w = folded_words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def near_copies(rows, percent=85, width=4):
    """id -> (set size, smallest reachable id) of (id, text) rows with different ids."""
    sets = {i: ngrams(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if not x or not y or min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                continue
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def repeated_passages(rows, run_words):
    """(id, start, end, words, kept) of (id, text) rows with different ids, windows looked up one by one."""
    first, out = {}, []
    for i, text in sorted(rows):
        spans = [m.span() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
        low = [text[a:b].translate(FOLD) for a, b in spans]
        found = []
        for p in range(len(low) - run_words + 1):
            kept, at = first.setdefault(tuple(low[p : p + run_words]), (i, p))
            if kept == i and p - at < run_words:
                continue
            if found and p <= found[-1][1] + run_words:
                found[-1][1] = p
            else:
                found.append([p, p, kept])
        out += [(i, spans[a][0], spans[b + run_words - 1][1], b + run_words - a, kept) for a, b, kept in found]
    return out


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def hits(text, items):
    """(words, hit words, items) of one text for (item id, text) items."""
    words, hit, found = bench_words(text), set(), set()
    for item, passage in items:
        w = bench_words(passage)
        width = min(13, len(w))
        if not width:
            continue
        windows = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
        for s in range(len(words) - width + 1):
            if tuple(words[s : s + width]) in windows:
                hit.update(range(s, s + width))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    threes = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(threes)
    covered = {i + k for i, t in enumerate(threes) if count[t] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), len(covered),
    )


def best_path(vocabulary, text):
    """The ids of the best path over the whole text at once."""
    if not text:
        return []
    chars = (" " + text).replace(" ", "▁")
    best, back = [0.0], [0]
    for end in range(1, len(chars) + 1):
        top = None
        for start in range(max(0, end - vocabulary.longest), end):
            score = vocabulary.scores.get(chars[start:end])
            if score is None:
                if start < end - 1:
                    continue
                score = vocabulary.unknown
            if top is None or best[start] + score > top:
                top, origin = best[start] + score, start
        best.append(top)
        back.append(origin)
    spans, end = [], len(chars)
    while end:
        spans.append((back[end], end))
        end = back[end]
    out = []
    for start, end in reversed(spans):
        piece = chars[start:end]
        out += [vocabulary.ids[piece]] if piece in vocabulary.ids else vocabulary.spell(piece)
    return out
