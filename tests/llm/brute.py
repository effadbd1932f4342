"""Plain versions of the text operators, for small inputs: every pair, every window."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from skytally.llm.tokens import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def substrings(rows, size):
    """doc_id -> (words, removed, kept text); rows: (doc_id, text) with different ids."""
    first: dict[tuple, int] = {}
    for doc, text in sorted(rows):
        w = words(text)
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), doc)
    out = {}
    for doc, text in rows:
        w = words(text)
        gone = {k for i in range(len(w) - size + 1) if first[tuple(w[i : i + size])] < doc for k in range(i, i + size)}
        out[doc] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def shingles(text, size=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def near_groups(rows, percent=75):
    """doc_id -> (set size, least id of its component)."""
    sets = {doc: shingles(text) for doc, text in rows}
    label = {doc: doc for doc in sets}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    low, high = sorted((top(a), top(b)))
                    label[high] = low
    return {doc: (len(s), top(doc)) for doc, s in sets.items()}


def lines(rows, similarity=0.85):
    """doc_id -> (lines, removed, text)."""
    seen: list[frozenset] = []
    out = {}
    for doc, text in sorted(rows):
        kept, parts = [], (text or "").split("\n")
        for part in parts:
            s = frozenset(words(part.translate(LOWER)))
            if not s or not any(len(s & o) >= similarity * len(s | o) - 1e-9 for o in seen):
                kept.append(part)
            if s and s not in seen:
                seen.append(s)
        out[doc] = (len(parts), len(parts) - len(kept), "\n".join(kept))
    return out


def alignment(a, b, match=2, mismatch=-1, gap=-1):
    """Smith-Waterman, cell by cell: the best score."""
    best, row = 0, [0] * (len(a) + 1)
    for y in b:
        fresh = [0]
        for j, x in enumerate(a, 1):
            fresh.append(max(0, row[j - 1] + (match if x == y else mismatch), row[j] + gap, fresh[-1] + gap))
        best, row = max(best, *fresh), fresh
    return best


def personal(text):
    """Base spans as (kind, start, end), by kind and then start."""
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def pieces(codec, text, document):
    """Ids of a text by one agenda for each chunk, as plain loops over all adjacent pairs; only the keyed hash is the operator's."""
    start = np.uint64(xxhash.xxh3_64_intdigest(document.to_bytes(8, "little", signed=True), codec.seed))
    out = []
    for place, chunk in enumerate(re.findall(" *[^ \n]+| +|\n", text)):
        keyed = mix(np.array([(int(start) + place * 0x9E3779B97F4A7C15) % 2**64], np.uint64))
        symbols = [int(codec.symbol_of[ord(c)]) if codec.symbol_of[ord(c)] >= 0 else c for c in chunk]
        skipped, turn = set(), 0
        ends = list(range(len(symbols) + 1))
        while True:
            known = [(-float(codec.score[m]), i, m) for i in range(len(symbols) - 1) if (m := codec.pairs.get((symbols[i], symbols[i + 1]))) is not None and tuple(ends[i : i + 3]) not in skipped]
            if not known:
                break
            _, i, m = min(known)
            if codec.skips(keyed, np.array([turn]))[0]:
                skipped.add(tuple(ends[i : i + 3]))
            else:
                symbols[i : i + 2] = [m]
                del ends[i + 1]
            turn += 1
        for s in symbols:
            out += [int(codec.byte_id[b]) for b in s.encode()] if isinstance(s, str) else [s]
    return out


def points(root):
    """Points of every element of a parsed page, each looked at by itself from its whole subtree."""
    from skytally.llm import html_text as h

    def everything(node):
        return [node, *(x for c in node.elements() for x in everything(c))]

    def text(node, wanted=lambda n: True):
        return len("".join(c for c in node.children if isinstance(c, str)).strip()) + sum(text(c) for c in node.elements() if wanted(c))

    def link_text(node):
        return text(node) if node.tag == "a" else sum(link_text(c) for c in node.elements())

    out = dict.fromkeys(everything(root), 0.0)
    for node in out:
        running = text(node, lambda c: c.tag not in h._BLOCK)
        if node.tag in h._BLOCK and node is not root and running >= h.LEAST_TEXT:
            gain = 1 + "".join(c for c in node.children if isinstance(c, str)).count(",") + min(running // 100, h.MOST_LENGTH)
            container = node.parent if node.tag in h._PARAGRAPH else node
            out[container] += gain
            if container.parent is not None:
                out[container.parent] += gain / 2
    def gain_of(node):
        running = text(node, lambda c: c.tag not in h._BLOCK)
        own = 0.0
        if node.tag in h._BLOCK and node is not root and running >= h.LEAST_TEXT:
            own = (1 + "".join(c for c in node.children if isinstance(c, str)).count(",") + min(running // 100, h.MOST_LENGTH)) * (1 - link_text(node) / text(node))
        return own + sum(gain_of(c) for c in node.elements())

    total, length = gain_of(root), text(root)
    held = {n: gain_of(n) / total if total else text(n) / length if length else 0 for n in out}
    density = {n: link_text(n) / text(n) if text(n) else 0 for n in out}
    weak = {n: n.noisy == h._WEAKLY and not (density[n] < h.LINKED and gain_of(n) >= 2) for n in out}
    noise = {n: (held[n] <= h.MOST and (n.noisy >= h._NAMED or weak[n])) or (n.noisy == h._READERS_OWN and total - gain_of(n) >= 2) for n in out}
    for node in out:
        above, named = node, False
        while above is not None:
            named |= noise[above]
            above = above.parent
        out[node] *= (1 - density[node]) * (h.NAMED if named else h.MENTIONED if node.noisy and held[node] <= h.MOST else h.ARTICLE if node.tag in ("article", "main") else 1)
    return out


def pattern_scores(edges, seed, rounds, support):
    """Scores of patterns over (pattern, value) edges after some rounds."""
    score = dict(seed)
    for _ in range(rounds):
        of = {p: [score[v] for q, v in edges if q == p] for p, _ in edges}
        patterns = {p: sum(x) / len(x) for p, x in of.items() if sum(s >= 0.5 for s in x) >= support}
        for v in seed:
            missed = 1.0
            for p, w in edges:
                if w == v:
                    missed *= 1 - min(patterns.get(p, 0.0), 0.999999)
            score[v] = max(seed[v], 1 - missed)
    return patterns
