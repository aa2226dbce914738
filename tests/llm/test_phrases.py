import random
import re
from collections import Counter

import numpy as np
import pytest

from veilframe.llm import phrases


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n-\r]", low)]


def brute(rows, least, top):
    f, total = Counter(), Counter()
    for text, lang in rows:
        for w in pieces(text):
            total[lang or "und"] += len(w)
            f.update((lang or "und", *w[i : i + n]) for n in range(1, 6) for i in range(len(w) - n + 1))
    f = {k: c for k, c in f.items() if c >= least}
    out = {}
    for (lang, *w), a in f.items():
        n = total[lang]
        cuts = [(1000 * a * n // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        inside = any(x[0] == lang and len(x) > len(w) + 1 and c >= a and any(list(x[i : i + len(w)]) == w for i in range(1, len(x))) for x, c in f.items())
        if cuts and not inside:
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]], n))
    return {(lang, i + 1, p.decode(), -a, left, right, n, -s) for lang, found in out.items() for i, (s, a, p, left, right, n) in enumerate(sorted(found)[:top])}


def rows_of(seed):
    rng = random.Random(seed)
    words = ["Ab", "bC", "é", "Éa", "x" * 50, "ß", "漢字", "a", "b"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ".", ",", "\n", "\x0b", " ! "]) for _ in range(rng.randrange(60)))
    rows = [(text(), rng.choice(["en", "en", "fr", None])) for _ in range(60)]
    return [*rows, *[rows[0]] * 30, (None, "en"), ("", None), (" . ", "xx"), ("solo", "yy")]


@pytest.mark.parametrize("bits", [phrases.BITS, 9])
def test_against_brute_force(spark, bits):
    """With 9 bits nearly all fingerprints collide, and everything is counted by text."""
    rows = rows_of(bits)
    docs = spark.createDataFrame([(i, *r, 5, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, n int, phrase string")
    got = phrases.collocations(docs, least=4, top=25, bits=bits)
    assert {tuple(r) for r in got.collect()} == brute(rows, 4, 25)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert phrases.collocations(docs).collect() == []
    assert phrases.collocations(docs.drop("lang")).collect() == []


def test_long_texts_in_slices(spark, monkeypatch):
    """Runs of any length, cut inside texts and around long words, give the same n-grams."""
    monkeypatch.setattr(phrases, "SLICE", 40)
    texts = [t or "" for t, _ in rows_of(3)] + ["w" * 300 + " tail of it", "one " * 200]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    grams, lang = phrases.Grams(5), np.zeros(len(raw), np.uint64)
    for n in range(1, 6):
        got, seen = Counter(), {}
        for words in grams.runs(data, offsets):
            at = grams.places(words, n)
            fp, fp2 = grams.of(words, n, at, lang)
            for i, x in zip(at.tolist(), zip(fp.tolist(), fp2.tolist(), strict=True), strict=True):
                phrase = b" ".join(phrases._LOWER[data[words.start[k] : words.end[k]]].tobytes() for k in range(i, i + n)).decode()
                got[phrase] += 1
                assert seen.setdefault(phrase, x) == x
        assert len(set(seen.values())) == len(seen)
        assert got == Counter(" ".join(w[i : i + n]) for t in texts for w in pieces(t) for i in range(len(w) - n + 1))


def test_twin_of_scores_beyond_64_bits(spark):
    f = spark.createDataFrame([(10**13, 10**14, 10**13, 10**13)], "a long, n long, l long, r long")
    big = lambda c: f"cast({c} as decimal(19,0))"
    got = f.selectExpr(f"cast(1000 as decimal(4,0)) * {big('a')} * {big('n')} div ({big('l')} * {big('r')}) as s").first()["s"]
    assert got == 1000 * 10**13 * 10**14 // 10**26
