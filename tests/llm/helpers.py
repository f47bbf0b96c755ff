"""Brute-force versions of the operators' contracts, over plain Python lists."""

import hashlib
import re
import zlib

import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text, lower=True):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER) if lower else text or "")


def alnum_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(tok, text):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 1]


def dedup(docs, window=20):
    """{doc_id: (n_words, n_removed, sha256)} of documents with distinct ids."""
    first, out = {}, {}
    order = sorted(docs, key=lambda d: -(2**63) if d[0] is None else d[0])
    for i, text in order:
        w = space_words(text, lower=False)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in first:
                gone[s : s + window] = [True] * window
            first.setdefault(k, (i, s))
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def simhash(text, shingle=3):
    w = space_words(text)
    if not w:
        return 0
    runs = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def jaccard(a, b, n=5):
    p, q = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set() for w in (space_words(a), space_words(b)))
    return len(p & q) / (len(p | q) or 1)


def groups(prints, radius=2, also=()):
    """{doc_id: smallest doc_id reachable} of {doc_id: fingerprint} and other links."""
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    for i, j in also:
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    return {i: find(i) for i in ids}


def similar(texts, least=0.8, n=5):
    """Pairs of {doc_id: text} with a Jaccard similarity of at least that, by way of the shingles they share."""
    of, has = {}, {}
    for i, t in texts.items():
        w = space_words(t)
        of[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
        for s in of[i]:
            has.setdefault(s, []).append(i)
    common = {}
    for ids in has.values():
        for k, i in enumerate(ids):
            for j in ids[k + 1 :]:
                common[i, j] = common.get((i, j), 0) + 1
    return [(i, j) for (i, j), c in common.items() if c >= least * (len(of[i]) + len(of[j]) - c)]
