"""Plain Python versions of the operators, written from their contracts."""

import hashlib
import re
from itertools import combinations

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
USER = re.compile(r"""(?i:user_?name|user|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}""", re.ASCII)
BLOB = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ENDPOINT = re.compile(r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+""", re.ASCII)
KINDS = ["assign", "access", "hex", "user", "blob", "endpoint"]
REACH = 200


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(out)


def all_spans(text):
    text, base = text or "", base_spans(text)
    weak = [(m.start(), 3, m.end(), "user") for m in USER.finditer(text)]
    weak += [(m.start(), 4, m.end(), "blob") for m in BLOB.finditer(text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    weak += [(m.start(), 5, m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    ends = [w for w in weak if w[3] == "endpoint"]
    weak = [w for w in weak if w[3] != "blob" or not any(e[0] <= w[0] and w[2] <= e[2] for e in ends)]
    weak = [w for w in weak if not any(b[0] < w[2] and w[0] < b[2] for b in base)]
    parts = base + weak

    def near(x, *kinds):
        return any(p[3] in kinds and abs(p[0] - x[0]) <= REACH for p in parts)

    def complete(x):
        identifier, secret = near(x, "access", "user"), near(x, "assign", "hex", "blob")
        if x[3] == "user":
            return secret
        return identifier or near(x, "endpoint") if x[3] == "blob" else identifier and secret

    return sorted(base + [w for w in weak if complete(w)])


def listed(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def ascii_lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def shingles(text, n=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", ascii_lower(text or "")) if w]
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))}


def near_duplicates(docs):
    """{doc_id: (n_shingles, component_id)} from (doc_id, text) with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(parent, 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in parent}


def repeated_bytes(docs, least=200):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)} from (doc_id, text) with distinct ids."""
    seen, data = {}, {i: (t or "").encode() for i, t in docs}
    for d in data.values():
        for k in range(len(d) - least + 1):
            seen[d[k : k + least]] = seen.get(d[k : k + least], 0) + 1
    out = {}
    for i, d in data.items():
        gone = bytearray(len(d))
        for k in range(len(d) - least + 1):
            if seen[d[k : k + least]] > 1:
                gone[k : k + least] = b"\x01" * least
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (len(d), sum(gone), runs, sha(bytes(x for x, g in zip(d, gone) if not g)))
    return out
