"""Plain versions of the operators' results, one row at a time, to hold the Spark operators against."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def quality(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strong spans, sorted; kinds: assign 0, access 1, hex 2."""
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text) if len(m[1]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(spans)


_FIELD = r"[\"']?\x20*[:=]\x20*[\"']?"
WEAK = (  # kind, role, pattern of the field or part, fewest characters of its value
    (3, "identifier", "(?i:user_?name|login|client_?id|account_?id)" + _FIELD + "([A-Za-z0-9@+/_.=-]+)", 3),
    (4, "secret", "(?<![A-Za-z0-9+/])([A-Za-z0-9+/]{40})(?![A-Za-z0-9+/=])", 40),
    (5, "secret", ASSIGN, 6),
    (6, "endpoint", "(?i:endpoint|hostname|server_?url)" + _FIELD + "([A-Za-z0-9:/_.-]+)", 4),
    (7, "identifier", "(?i:user(?:_?id)?|uid|e_?mail|account(?:_?name)?|access_?key(?:_?id)?|key_?id)" + _FIELD + "([A-Za-z0-9@+/_.=-]+)", 3),
    (8, "secret", "(?i:secret_?(?:access_?)?key|private_?key|account_?key|auth_?key|pass_?phrase|pass|pwd)" + _FIELD + "([A-Za-z0-9+/_.=-]+)", 6),
    (9, "endpoint", "(?i:host|server|ur[il])" + _FIELD + "([A-Za-z0-9:/_.-]+)", 3))
SCHEME = r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,15}://"


def secrets(text: str | None) -> tuple[int, int, int, str, str]:
    """n_assign, n_access, n_hex, base_sha256, spans."""
    text = text or ""
    base = base_spans(text)
    strong = base + [(m.start(), 11, m.end()) for m in re.finditer(SCHEME + r"[^@\s/:?#\"'<>]*:([^@\s/?#\"'<>]+)@[A-Za-z0-9_.-]+", text)]
    parts = [(s, e, k, "identifier" if k == 1 else "secret") for s, k, e in strong]
    weak = []
    for kind, role, pattern, least in WEAK:
        for m in re.finditer(pattern, text):
            value = m[1]
            plain = not (re.search("[a-z][A-Z]", value) or (re.search("[0-9]", value) and re.search("[A-Za-z]", value)))
            if len(value) >= least and not (kind == 5 and len(value) >= 12) and not (role == "secret" and plain):
                weak.append((m.start(), m.end(), kind, role))
    for m in re.finditer(SCHEME + "([A-Za-z0-9_.-]+)", text):
        word = re.match(r"[^\s\"'<>]*", text[m.end():])[0]
        login = re.match(r"(:[^@\s/?#\"'<>]*)?@", text[m.end():])
        if not login and len(m[1]) >= 3 and re.search(r"[?&;#][A-Za-z0-9_.-]*(?i:password|passwd|secret|token|key|pass|pwd)=", word):
            weak.append((m.start(), m.end() + len(re.match("(:[0-9]+)?", word)[0]), 10, "endpoint"))
    found = list(strong)
    for s, e, k, role in weak:
        for s2, e2, _, role2 in parts + weak:
            if (role == "secret") != (role2 == "secret") and s2 - e <= 256 and s - e2 <= 256 and (s2 >= e or e2 <= s):
                found.append((s, k, e))
                break
    names = ("assign", "access", "hex", "login", "bare_key", "short_secret", "endpoint", "account", "key_field", "host", "url", "url_login")
    show = lambda xs: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in xs)
    count = Counter(k for _, k, _ in base)
    return count[0], count[1], count[2], sha(show(base)), show(sorted(found))


def top_k(vectors: dict[int, list[int]], query, k: int = 5) -> list[tuple[int, int, int, int]]:
    rows = []
    for q, a in vectors.items():
        if query(q):
            scores = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), v) for v, b in vectors.items() if v != q and len(a) == len(b)))[:k]
            rows += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scores)]
    return rows


def url(text: str | None, rules, default: str = "allow", no_host: str = "block") -> tuple:
    host = path = ""
    if text and "://" in text:
        rest = text.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for h, p, action in rules:
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0, "", ""), (len(h + p), h + p, action))
    return host, path, best and best[1], best[2] if best else (default if host else no_host)


def chat(turns: list[tuple[str | None, str | None]]) -> tuple:
    """n_turns, turns_sha256, loss_chars, loss_sha256 of the turns (role, text) in order."""
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def repeats(docs: list[tuple[int, bytes]], width: int = 100) -> dict[int, tuple]:
    """doc_id: (n_bytes, n_removed, n_spans, kept_sha256)."""
    seen, out = set(), {}
    for doc, data in sorted(docs):
        removed = bytearray(len(data))
        for p in range(len(data) - width + 1):
            w = data[p : p + width]
            if w in seen:
                removed[p : p + width] = b"\1" * width
            else:
                seen.add(w)
        spans = len(re.findall(rb"\x01+", bytes(removed)))
        out[doc] = len(data), sum(removed), spans, sha(bytes(b for b, r in zip(data, removed, strict=True) if not r))
    return out


def shingles(text: str | None) -> frozenset:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near(docs: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """doc_id: (n_shingles, component_id, kept)."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            root[d] = d = root[root[d]]
        return d

    where = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            where[g].append(d)
    for d, s in sets.items():
        shared = Counter(o for g in s for o in where[g] if o < d)
        for o, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[o]) - n):
                a, b = sorted((find(d), find(o)))
                root[b] = a
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def mix_key(doc_id: int | None, text: str | None) -> str:
    return f"{'null' if doc_id is None else doc_id}:{hashlib.md5((text or '').encode()).hexdigest()}"


def poisson(u: float, mean: float) -> int:
    p = c = math.exp(-mean)
    k = 0
    while u >= c:
        k += 1
        p *= mean / k
        if c + p == c:
            break
        c += p
    return k


def copies(seed: int, key: str, mean: float, chunk: float = 16.0) -> int:
    parts = max(1, math.ceil(mean / chunk))
    draw = lambda i: int(hashlib.md5(f"{seed}:{i}:{key}".encode()).hexdigest()[:13], 16) / 2**52
    return sum(poisson(draw(i), mean / parts) for i in range(1, parts + 1))


def archive(pages: list[tuple[int, str | None]]) -> list[tuple]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to."""
    first, rows = {}, []
    for p, html in sorted(pages, key=lambda x: x[0]):
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        of = first.setdefault(data, p)
        rows.append((p, len(data), digest, "response" if of == p else "revisit", None if of == p else of))
    return rows


def viterbi(text: str, scores: dict[str, tuple[int, float]], byte_ids, unknown: float) -> list[int]:
    """Best path over the whole text (spaces as markers) with the operator's tie rule."""
    text = " " + text if text else ""
    n, longest = len(text), max(map(len, scores))
    best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
    for i in range(n):
        for j in range(i + 1, min(n, i + longest) + 1):
            piece = scores.get(text[i:j].replace("▁", "\0").replace(" ", "▁"))
            if piece and best[i] + piece[1] > best[j]:
                best[j], back[j] = best[i] + piece[1], (i, [piece[0]])
        if best[i] + unknown > best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + unknown, (i, [byte_ids[b] for b in text[i].encode()])
    out, j = [], n
    while j:
        i, ids = back[j]
        out[:0] = ids
        j = i
    return out
