"""Plain versions of what the operators compute, for small inputs."""

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def crc(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def shingles(text, width=4):
    w = words(text)
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def components(sets, percent=85):
    """Document to the smallest document reachable by links, by comparing all pairs."""
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def keys(text):
    return [lower(line).strip(" \t\n\x0b\x0c\r") for line in (text or "").split("\n")]


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, **more):
    """A documents table of (id, text) pairs with a column that clashes with inner names."""
    rows = [(i, t, more.get("lang", "en"), f"s{k % 3}", len(t or ""), "x") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS + ", key string")
