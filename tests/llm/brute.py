"""Plain Python forms of the operators, written from their definitions."""

import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, radius=4):
    """prints: id -> fingerprint; id -> smallest reachable id."""
    by = defaultdict(list)
    for i, f in prints.items():
        by[f].append(i)
    fs, at = sorted(by), {}
    for f in fs:
        if f in at:
            continue
        stack, seen = [f], {f}
        while stack:
            x = stack.pop()
            for y in fs:
                if y not in seen and bin(x ^ y).count("1") <= radius:
                    seen.add(y)
                    stack.append(y)
        least = min(i for y in seen for i in by[y])
        at |= {y: least for y in seen}
    return {i: at[f] for i, f in prints.items()}


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, repeats = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            repeats += x in seen
            seen.add(x)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered)


def norm_lines(text):
    """Normalised lines that hold a word, each with its neighbours."""
    lines = [" ".join(WORD.findall(x.lower())) for x in (text or "").split("\n")]
    lines = [x for x in lines if x]
    return [(x, lines[i - 1] if i else "<", lines[i + 1] if i + 1 < len(lines) else ">") for i, x in enumerate(lines)]


def frequent(docs, docs_limit, contexts_limit):
    """docs: (id, text, host); {(host, line)} above both limits: of documents, and of different texts, compared by their lines."""
    who, where = defaultdict(set), defaultdict(set)
    for i, t, host in docs:
        lines = tuple(x for x, _, _ in norm_lines(t))
        for x in lines:
            who[host, x].add((i, t))
            where[host, x].add(lines)
    return {k for k in who if len(who[k]) > docs_limit and len(where[k]) > contexts_limit}


def spread(docs, min_sites, min_contexts):
    """Lines on enough sites and in enough different texts."""
    who, where = defaultdict(set), defaultdict(set)
    for _, t, site in docs:
        lines = tuple(x for x, _, _ in norm_lines(t))
        for x in lines:
            who[x].add(site)
            where[x].add(lines)
    return {x for x in who if len(who[x]) >= min_sites and len(where[x]) >= min_contexts}


def targets(sizes, weights=(5, 2, 1), most=3):
    """sizes: source -> words; null last. The excess is reshared until no source is above its stop."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > most * sizes[s]}
        if not above:
            return out | share
        out |= {s: float(most * sizes[s]) for s in above}
        rest -= sum(most * sizes[s] for s in above)
        open_ -= above
    return out
