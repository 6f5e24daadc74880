"""Plain restatements of what the operators are to find, for small inputs."""

import re

FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def folded(text):
    return FOLDED.findall((text or "").translate(UPPER))


def fold_items(rows):
    return [(str(r["item_id"]), folded(r["text"])) for r in rows]


def word_hits(words, items):
    hit, names = set(), set()
    for name, item in items:
        k = min(10, len(item))
        if not k:
            continue
        windows = {tuple(item[i:i + k]) for i in range(len(item) - k + 1)}
        for i in range(len(words) - k + 1):
            if tuple(words[i:i + k]) in windows:
                hit |= set(range(i, i + k))
                names.add(name)
    return hit, names


def shingle_set(text):
    words = folded(text)
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def links(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    out = {i: set() for i in texts}
    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) * 10 >= 8 * len(sets[a] | sets[b]):
                out[a].add(b)
                out[b].add(a)
    return out


def linked_groups(texts):
    near, seen, groups = links(texts), set(), []
    for i in sorted(texts):
        if i in seen:
            continue
        group, todo = set(), [i]
        while todo:
            j = todo.pop()
            if j not in group:
                group.add(j)
                todo += near[j]
        seen |= group
        groups.append(group)
    return groups


BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]


def base_spans(text):
    found = []
    for n, (kind, pattern, group, least) in enumerate(BASE):
        for m in pattern.finditer(text or ""):
            if len(m.group(group)) >= least:
                found.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return [line for _, _, line in sorted(found)]
