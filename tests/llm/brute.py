"""Plain versions of the operators, over lists of (id, text)."""

import hashlib
import re
import string
from collections import Counter, defaultdict

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", "", t or "")].append((-len(t or ""), i))
    out = {}
    for t, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), keep == i, hashlib.sha256(t.encode()).hexdigest())
    return out


def contamination(rows, items, size=10):
    cut = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (s or "").translate(LOWER))
    windows = defaultdict(set)
    for i, s in items:
        w = cut(s)
        for k in range(max(1, len(w) - size + 1)):
            if w:
                windows[tuple(w[k : k + size])].add(i)
    out = {}
    for i, s in rows:
        w, hit, found = cut(s), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    return out


def components(rows, k=3, percent=90):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if b < a and n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def lines(rows, percent=80):
    seen, holders, out = [], defaultdict(list), {}
    for i, t in sorted(rows):
        gone, parts = [], (t or "").split("\n")
        for k, line in enumerate(parts):
            s = set(words(line))
            if not s:
                continue
            counts = Counter(j for w in s for j in holders[w])
            if any(100 * n >= percent * (len(s) + len(seen[j]) - n) for j, n in counts.items()):
                gone.append(k)
            for w in s:
                holders[w].append(len(seen))
            seen.append(s)
        out[i] = (len(parts), gone)
    return out


def substrings(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.split("."))) or (kind == "card" and 16 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 8 <= len(d) <= 15)


def personal(text):
    found = [[(k, m.start(), m.end()) for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in BASE]
    spans = ",".join("%s:%d:%d" % x for f in found for x in f)
    return [*map(len, found), hashlib.sha256(spans.encode()).hexdigest()], spans
