"""Plain single-process versions of the operators' results, for small tables."""

import hashlib
import html
import re
from collections import defaultdict


def fold(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def exact_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[hashlib.sha256(fold(text).encode()).hexdigest()].append(doc_id)
    out = []
    for doc_id, text in rows:
        digest = hashlib.sha256(fold(text).encode()).hexdigest()
        ids = groups[digest]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), digest))
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words(fold(text))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()


def jaccard_components(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    seen = set()
    for ids in holders.values():
        for a in range(len(ids)):
            for b in ids[a + 1 :]:
                if (ids[a], b) not in seen:
                    seen.add((ids[a], b))
                    x, y = sets[ids[a]], sets[b]
                    if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                        parent[root(ids[a])] = root(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = root(i)
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)]


def personal(text):
    """Base matches by the patterns as they are written in the contract."""
    text = text or ""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    out = []
    for number, (kind, pattern) in enumerate(patterns.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            if kind == "card":
                if not 14 <= len(digits) <= 19:
                    continue
                odd = digits[-1::-2]
                even = [2 * d - 9 if d > 4 else 2 * d for d in digits[-2::-2]]
                if (sum(odd) + sum(even)) % 10:
                    continue
            out.append((m.start(), number, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def license_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
    hits = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    places = [i for i, _ in hits]
    return len(w), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def article(source):
    """Main text of the generated pages, all of which mark their article and close no inline tag."""
    body = re.search(r"<article>(.*?)</article>", source or "", re.DOTALL)
    blocks = re.split(r"</?(?:p|h1|h2|h3|li|ul)>", body[1]) if body else []
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if False else "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(x for x in lines if x)
