"""Plain versions of the training-data queries, written from their contracts, for small tables."""

import hashlib
import re
import zlib
from collections import Counter

import public_tokenizers


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tokens(rows):
    """op1: (doc_id, start, n_tokens, crc32) of (doc_id, text) rows with distinct ids."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for d, x in sorted(rows, key=lambda r: r[0]):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        out.append((d, start, len(ids), crc))
        start += len(ids)
    return out


KINDS = [
    ("assign", re.compile(r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]"
                          r"|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))"
                          r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24)]


def secrets(text):
    """op2: counts by kind and the base spans as text."""
    found = []
    for k, (kind, pattern, group, least) in enumerate(KINDS):
        for m in pattern.finditer(text or ""):
            if len(m.group(group)) >= least:
                found.append((m.start(), k, kind, m.end()))
    n = Counter(f[2] for f in found)
    spans = ",".join(f"{kind}:{a}:{z}" for a, _, kind, z in sorted(found))
    return n["assign"], n["access"], n["hex"], sha(spans), spans


def quality(text):
    """op4: the base measures."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    hit = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(hit), failed)


def bpe(text):
    """op5: (n_tokens, ids hash, decoded hash) by the library."""
    from tokenizers import Tokenizer
    t = bpe.__dict__.setdefault("tok", Tokenizer.from_file(
        public_tokenizers.path("word_bpe_49k.json")))
    t.no_truncation()
    t.no_padding()
    ids = t.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def links(rows, size=3, percent=90):
    """op6: [(doc_id, n_shingles, component_id)] over (doc_id, text) rows, all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size
                    else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) \
                    and 100 * len(a & b) >= percent * len(a | b):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, d), d)
    return [(d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def repeats(rows, size=400):
    """op8: [(doc_id, n_bytes, n_removed, n_spans, kept hash)]."""
    raws = [(d, (t or "").encode()) for d, t in rows]
    n = Counter(r[i:i + size] for _, r in raws for i in range(len(r) - size + 1))
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - size + 1):
            if n[r[i:i + size]] > 1:
                gone[i:i + size] = b"\1" * size
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((d, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def contamination(rows, items, window=13):
    """op9: [(doc_id, n_words, n_hit, n_items, items hash, contaminated)]."""
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    grams = {}
    for i, t in items:
        w = split(t)
        size = min(window, len(w))
        for a in range(len(w) - size + 1 if w else 0):
            grams.setdefault(tuple(w[a:a + size]), set()).add(str(i))
    sizes = {len(g) for g in grams}
    out = []
    for d, t in rows:
        w = split(t)
        hit, found = set(), set()
        for size in sizes:
            for a in range(len(w) - size + 1):
                g = grams.get(tuple(w[a:a + size]))
                if g:
                    hit.update(range(a, a + size))
                    found |= g
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return out


def ranked(rows, items, k=10):
    """op11: (item_id, rank, doc_id, score) of (id, text) rows; distinct document ids."""
    import math
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [(d, Counter(term.findall((t or "").translate(low)))) for d, t in rows]
    terms = [(d, c) for d, c in terms if c]
    n_docs, total = len(terms), sum(c.total() for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in terms:
            m = 10 + (90 * c.total() * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in set(term.findall((text or "").translate(low))) if c[t])
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found, key=lambda f: f[:3])[:k])]
    return out


def merkle(rows, claim):
    """op12: rows are (doc_id, source, lang, n_chars, text); ``claim`` gives the told row."""
    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def climb(nodes):
        tree = [nodes]
        while len(tree[-1]) > 1:
            tree.append([sha("".join(tree[-1][i:i + 3])) for i in range(0, len(tree[-1]), 3)])
        return tree

    def path(tree, i):
        for low in tree[:-1]:
            yield low[i - i % 3:i], low[i + 1:i - i % 3 + 3]
            i //= 3

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, sha("".join(map(enc, r))), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names]
    top = climb([t[-1][0] for t in trees])
    root, out = top[-1][0], []
    for k, (s, tree) in enumerate(zip(names, trees)):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            steps = [*path(tree, i), *path(top, k)]
            node = sha("".join(map(enc, claim(r))))
            for a, z in steps:
                node = sha("".join(a) + node + "".join(z))
            proof = sha("".join("".join(a) + "".join(z) for a, z in steps))
            out.append((r[0], leaf, tree[-1][0], root, proof, node, node == root))
    return out


def archived(rows, least=0):
    """op13: (page_id, bytes, digest, type, refers_to) of (page_id, html) rows."""
    import base64
    first = {}
    for p, t in rows:
        body = (t or "").encode()
        if len(body) >= least and p is not None and p > first.get(body, (-1 << 63)):
            first[body] = p
    out = []
    for p, t in rows:
        body = (t or "").encode()
        f = first.get(body) if len(body) >= least else None
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        response = f is None or f == p
        out.append((p, len(body), digest, "response" if response else "revisit", None if response else f))
    return out
