"""Plain-Python versions of the operators, for small inputs."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def size_crc(text):
    b = (text or "").encode()
    return len(b) + 16, zlib.crc32(b)


def luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def base_pii(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def decontaminate(docs, items):
    wins = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - 12)) if w and i is not None else []:
            wins[tuple(w[k : k + 13])].add(str(i))
    lens = {len(k) for k in wins}
    out = []
    for d, t in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in lens:
            for k in range(len(w) - n + 1):
                if x := wins.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def license_base(text):
    w = ALNUM.findall((text or "").translate(LOWER))
    at = []
    for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = p.split()
        at += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    pos = sorted(k for k, _ in at)
    return len(w), len(at), pos[0] if pos else None, pos[-1] if pos else None, ",".join(sorted({x for _, x in at}))


def shingles(text):
    w = SPACED.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def classes(n, edges):
    p = list(range(n))

    def root(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in edges:
        p[root(a)] = root(b)
    return [root(i) for i in range(n)]


def jaccard_links(docs):
    """docs: (doc_id, text); rows (doc_id, n_shingles, n_similar, component_id)."""
    s = [shingles(t) for _, t in docs]
    index = defaultdict(list)
    for i, x in enumerate(s):
        for g in x:
            index[g].append(i)
    deg, edges = [0] * len(docs), []
    for i, x in enumerate(s):
        for j, n in Counter(j for g in x for j in index[g] if j < i).items():
            if 100 * n >= 80 * (len(x) + len(s[j]) - n):
                deg[i] += 1
                deg[j] += 1
                edges.append((i, j))
    c = classes(len(docs), edges)
    low = {}
    for i, r in enumerate(c):
        low[r] = min((x for x in (low.get(r), docs[i][0]) if x is not None), default=None)
    return [(docs[i][0], len(s[i]), deg[i], low[c[i]]) for i in range(len(docs))]


def repeated_bytes(docs, k=400):
    """docs: (doc_id, text); rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    seen = Counter()
    raw = [(t or "").encode() for _, t in docs]
    for b in raw:
        seen.update(hash(b[i : i + k]) for i in range(len(b) - k + 1))
    out = []
    for (d, _), b in zip(docs, raw):
        runs = []
        for i in range(len(b) - k + 1):
            if seen[hash(b[i : i + k])] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + k
                else:
                    runs.append([i, i + k])
        kept, at = b"", 0
        for s, e in runs:
            kept += b[at:s]
            at = e
        out.append((d, len(b), sum(e - s for s, e in runs), len(runs), sha(kept + b[at:])))
    return out


def shared_words(docs, k=51):
    """docs: (doc_id, text); rows (doc_id, words in runs of k words that stand in another row)."""
    ws = [ALNUM.findall((t or "").translate(LOWER)) for _, t in docs]
    where = defaultdict(set)
    for r, w in enumerate(ws):
        for i in range(len(w) - k + 1):
            where[hash(tuple(w[i : i + k]))].add(r)
    out = []
    for (d, _), w in zip(docs, ws):
        hit = set()
        for i in range(len(w) - k + 1):
            if len(where[hash(tuple(w[i : i + k]))]) > 1:
                hit.update(range(i, i + k))
        out.append((d, len(hit)))
    return out


def letters(text):
    """Lower-cased letters, runs of anything else as one space."""
    out = []
    for c in text or "":
        if unicodedata.category(c)[0] == "L":
            out.append(c.lower() if len(c.lower()) == 1 and ord(c) < 1 << 16 else c)
        elif not out or out[-1] != " ":
            out.append(" ")
    return "".join(out)


def _hashed(gram):
    mask, h = (1 << 64) - 1, 0
    for c in gram:
        h = (h * 0x9E3779B97F4A7C15 + ord(c)) & mask
    h = ((h + len(gram)) * 0xD6E8FEB86659FD93) & mask
    return ((h ^ (h >> 32)) * 0xFF51AFD7ED558CCD & mask) >> 48


def naive_bayes(train, texts, orders, cells, smoothing):
    """train: (text, lang); for each text (language, posterior), or None without a letter."""
    grams = lambda t: [_hashed(f[i : i + k]) for f in [letters(t)] for k in orders for i in range(len(f) - k + 1)]
    counts, docs = defaultdict(Counter), Counter()
    for t, lang in train:
        counts[lang].update(grams(t))
        docs[lang] += 1
    out = []
    for t in texts:
        score = {}
        for lang, c in sorted(counts.items()):
            total = sum(c.values()) + smoothing * cells
            score[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log((c[g] + smoothing) / total) for g in grams(t))
        best = max(score, key=lambda x: score[x])
        out.append((best, 1 / sum(math.exp(s - score[best]) for s in score.values())) if any(unicodedata.category(c)[0] == "L" for c in t or "") else None)
    return out


def squares(sizes, size):
    """For each piece the fill level of the window that it goes to: the sum of squared counts of partly filled windows gets least; ties: the fullest."""
    c, out = Counter(), []
    for n in sizes:
        tries = []
        for h in [0, *(h for h in c if c[h] and h + n <= size)] if n < size else [0]:
            d = Counter(c)
            if h:
                d[h] -= 1
            if h + n < size:
                d[h + n] += 1
            tries.append((sum(x * x for x in d.values()), -h, d))
        _, h, c = min(tries, key=lambda x: x[:2])
        out.append(-h)
    return out
