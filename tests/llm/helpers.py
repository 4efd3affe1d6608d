"""Plain Python forms of the definitions, for comparison."""

import re

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    return spark.createDataFrame([(*r, None)[:5] if len(r) < 5 else r for r in rows], DOCUMENTS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, n=5):
    found = WORD.findall(lower(text or ""))
    if len(found) < n:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)}


def groups(sets, percent):
    """{id: least id reachable} over links with 100 * intersection >= percent * union."""
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
