"""Plain Python versions of the contracts, over lists of (doc_id, text)."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOW = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(LOW))


def contamination(docs, items, span=10):
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(span, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[s : s + n])].add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s : s + n])) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[x]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def phrases(docs, known):
    out = []
    for d, t in docs:
        w = words(t)
        at = [(i, k) for k, p in known.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        out.append((d, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({k for _, k in at}))))
    return out


def exact(docs):
    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in docs]
    groups = defaultdict(list)
    for d, t in norm:
        groups[t].append(d)
    keep = {t: min((d for d in ds if d is not None), default=None) for t, ds in groups.items()}
    return [(d, keep[t], len(groups[t]), sha(t)) for d, t in norm]


def near(docs, shingle, percent=80):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        n = min(shingle, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set())
    comp = list(range(len(docs)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                comp[root(i)] = root(j)
    first = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        first[root(i)].append(d)
    low = {r: min((d for d in ds if d is not None), default=None) for r, ds in first.items()}
    return [(d, len(sets[i]), low[root(i)], d == low[root(i)]) for i, (d, _) in enumerate(docs)]


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(docs):
    out = []
    for d, t in docs:
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        n = Counter(k for _, k, _ in spans)
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        out.append((d, n[0], n[1], n[2], sha(said)))
    return out


def conversations(turns):
    by = defaultdict(list)
    for c, n, r, t in turns:
        by[c].append((n is not None, n or 0, r or "", t or ""))
    out = []
    for c, ts in by.items():
        ts.sort()
        lost = "".join(t for _, _, r, t in ts if r == "assistant")
        out.append((c, len(ts), sha("".join(f"{r}\n{t}\n" for _, _, r, t in ts)), len(lost), sha(lost)))
    return out


def token_rows(docs, encode):
    import numpy as np

    out, start = [], 0
    for d, t in sorted(((d, t or "") for d, t in docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = [*encode(t), 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def interaction(rows, labels):
    """rows of (doc_id, text, source), labels of (doc_id, quality, toxic)."""
    from itertools import permutations

    good, toxic = ({d for d, *v in labels if v[i] == 1 and d is not None} for i in (0, 1))
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    parts = defaultdict(list)
    for d, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > first[t]}
        parts[s or ""].append(({k for k, v in fails.items() if v}, d in good, d in toxic))
    out = []
    for s, docs in parts.items():
        removed = {}
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [x for x in docs if f in x[0] and not x[0] & before]
                removed[order, f] = len(gone)
                out.append((s, order, k + 1, sum(not x[0] & set(order[: k + 1]) for x in docs), len(gone), sum(f in x[0] for x in docs) - len(gone), sum(x[0] == {f} for x in docs), sum(x[1] for x in gone), sum(x[2] for x in gone)))
    total = Counter()
    for (_, order, k, *_), i in zip(out, range(len(out))):
        total[out[i][0], order[k - 1]] += out[i][4]
    return [(*r, total[r[0], r[1][r[2] - 1]]) for r in out]


def divergence(rows, least=10, top=10):
    """rows of (text, lang, source)."""
    rows = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW)), a or "", b or "") for t, a, b in rows]
    df, count = defaultdict(Counter), defaultdict(Counter)
    for w, a, b in rows:
        df[a].update(set(w))
        count[a, b].update(w)
        count[a, None].update(w)
    out = []
    for a in {k[0] for k in count}:
        kept = [t for t, n in df[a].items() if n >= least]
        p = {}
        for k, c in count.items():
            if k[0] == a:
                n = sum(c[t] for t in kept)
                p[k[1]] = {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for b in p:
            if b is not None:
                pairs = sorted((-sum(f(p[b][t], p[o][t]) for t in kept), o.encode()) for o in p if o not in (b, None))
                terms = sorted((-f(p[b][t], p[None][t]), t.encode()) for t in kept if count[a, b][t] and p[b][t] > p[None][t])
                out += [(a, b, part, i.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms[:top])) for k, (v, i) in enumerate(found)]
    return out
