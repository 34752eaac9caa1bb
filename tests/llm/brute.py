"""Plain versions of the operators' contracts, to hold the Spark ones against on small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def pii(text):
    text = text or ""
    kinds = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d))))
            return 12 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    found = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(kinds.items()) for m in re.finditer(p, text) if good(k, m[0]))
    n = Counter(f[3] for f in found)
    return tuple(n[k] for k in kinds), sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in found))


def targets(sizes):
    """{source: size} to {source: target}; None sorts last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def decontaminate(docs, items):
    """[(doc_id, text)], [(item_id, text)] to {doc_id: (n_words, n_hit, ids)}."""
    windows = defaultdict(set)
    for i, t in items:
        w = ITEM_WORD.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        for a in range(len(w) - n + 1) if n else ():
            windows[tuple(w[a : a + n])].add(str(i))
    lengths = {len(w) for w in windows}
    out = {}
    for d, t in docs:
        w = ITEM_WORD.findall((t or "").translate(LOWER))
        hit, ids = set(), set()
        for n in lengths:
            for a in range(len(w) - n + 1):
                if got := windows.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    ids |= got
        out[d] = (len(w), len(hit), sorted(ids))
    return out


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = list(zip(words, words[1:], words[2:]))
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def repeats(docs, n=50):
    """[(doc_id, text)] to {doc_id: (n_bytes, n_removed, n_spans, sha)}."""
    first = {}
    data = [(d, (t or "").encode()) for d, t in docs]
    for d, b in data:
        for i in range(len(b) - n + 1):
            w = b[i : i + n]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, b in data:
        cover = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < d:
                cover[i : i + n] = b"\1" * n
        spans = sum(1 for i, c in enumerate(cover) if c and not (i and cover[i - 1]))
        rest = bytes(x for x, c in zip(b, cover) if not c)
        out.append((d, len(b), sum(cover), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def shingles(text, k=4):
    w = WORD.findall((text or "").translate(LOWER))
    return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else ({tuple(w)} if w else set())


def components(docs, k=4, percent=80):
    """[(doc_id, text)] to [(doc_id, n_shingles, component_id, kept)]."""
    sets = [(d, shingles(t, k)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = defaultdict(set)
    for i, (_, s) in enumerate(sets):
        for g in s:
            index[g].add(i)
    for i, (d, s) in enumerate(sets):
        common = Counter(j for g in s for j in index[g] if j < i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = find(d), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def thue_morse(n, one="a", other="b"):
    """A string that polynomials modulo a power of two hash like its complement, and that."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((one, other)[b] for b in bits), "".join((other, one)[b] for b in bits)


def url(u):
    """(host, path, rule, verdict or None) of a url."""
    host = path = ""
    if u is not None and "://" in u:
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut].translate(LOWER), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host[-len(h) - 1 :] == "." + h) and path[: len(p)] == p]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def shards(rows, n, fine=64, cells=8192, weights=(4, 1, 1)):
    """[(doc_id, text)] to the shard of each row by the dot-product rule, for groups that no shard is too small for."""
    import xxhash

    group = lambda t: b"null" if t is None else hashlib.md5(t.encode()).digest()
    vector = lambda t: [len((t or "").encode()) + 16, len(WORD.findall(t or "")), 1]
    sums = defaultdict(lambda: [0, 0, 0])
    for _, t in rows:
        sums[group(t)] = [a + b for a, b in zip(sums[group(t)], vector(t))]
    total = [max(1, sum(v[i] for v in sums.values())) for i in range(3)]
    packed = defaultdict(lambda: [0, 0, 0])
    name = {}
    for g, v in sums.items():
        name[g] = (0, g, 0) if max(a / b for a, b in zip(v, total)) > 1 / (n * fine) else (1, b"", xxhash.xxh64_intdigest(g, seed=42) % cells)
        packed[name[g]] = [a + b for a, b in zip(packed[name[g]], v)]
    share = {k: [a / b for a, b in zip(v, total)] for k, v in packed.items()}
    room, where = [[1 / n] * 3 for _ in range(n)], {}
    for k in sorted(sorted(share), key=lambda k: -max(share[k])):
        fit = [sum(r * v * w for r, v, w in zip(left, share[k], weights)) for left in room]
        at = max(range(n), key=lambda i: (round(fit[i], 14), -i))
        room[at] = [r - v for r, v in zip(room[at], share[k])]
        where[k] = at
    return [where[name[group(t)]] for _, t in rows]
