"""Small documents with the awkward cases, and plain forms of the contracts."""

from __future__ import annotations

import hashlib
import random
import re

SCHEMA = "doc_id long, text string, lang string, key long, n long, same string"


def documents(seed: int = 1, n: int = 40) -> list[tuple]:
    """Nulls, empty texts, ties, repeats within and across documents, one long text, odd characters; columns that clash
    with the operators' own."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "the of and to in blé zu ñu çoi Ärg".split() for b in ("", "la", "ré", "st")]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, base = say(40), say(120)
    texts: list[str | None] = [None, "", " ", "\n\n", "one", "Two words", "a b c d", "<|endoftext|> x\n <|endoftext|>y", "x" * 250, "ab" * 300, "the the " * 60, "tab\tand\r\nbreak   nbsp　wide", "a\x00b \x00\x00 c"]
    texts += [base, base, base.upper(), base + " end", " ".join(w for i, w in enumerate(base.split()) if i % 40)]
    texts += [say(20) + " " + passage + " " + say(15) for _ in range(6)]
    texts += [say(9000)]
    texts += [say(rng.randint(3, 90)) + ".\n" + say(12) for _ in range(n - len(texts))]
    return [(i, t, "en" if i % 2 else None, 5, None, "s") for i, t in enumerate(texts)]


def removed_bytes(docs: list[tuple], size: int = 100) -> dict:
    seen, out = set(), {}
    for i, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            w = b[p : p + size]
            if w in seen:
                gone[p : p + size] = b"\1" * size
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def removed_words(docs: list[tuple], size: int = 13) -> dict:
    first, out = {}, {}
    for i, text in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if first.setdefault(tuple(w[p : p + size]), i) < i:
                gone[p : p + size] = [True] * size
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def near_duplicates(docs: list[tuple]) -> dict:
    sets = {}
    for i, text in docs:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(_FOLD))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = {i: min(x, y) if c in (x, y) else c for i, c in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


def contamination(docs: list[tuple], items: list[tuple], size: int = 10) -> dict:
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(_FOLD))
    windows = []
    for name, text in items:
        w = words(text)
        n = min(size, len(w))
        windows += [(str(name), w[p : p + n]) for p in range(len(w) - n + 1)] if w else []
    out = {}
    for i, text in docs:
        w = words(text)
        hit, names = set(), set()
        for name, x in windows:
            for p in range(len(w) - len(x) + 1):
                if w[p : p + len(x)] == x:
                    hit |= set(range(p, p + len(x)))
                    names.add(name)
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))
    return out
