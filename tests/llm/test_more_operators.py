"""Operators 11 to 13: plain Python and SQL beside them, held-out rows, and small cases of nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import oracle
import pytest

from pairscope.llm import catalog as corpus
from pairscope.llm import fill_middle, hard_negatives, language_id

SF = "/root/testdata/sf0.01"
rng = random.Random(5)


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_fill_middle"])
def test_equals_sql(spark, name):
    assert oracle.differences(spark, oracle.connect(SF), corpus.queries()[name], corpus.oracle_sql()[name], SF) == []


# fill-in-middle


def lines(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def words(text):
    return re.findall(r"[^ \t-\r]*[ \t-\r]+|[^ \t-\r]+", text)


def arranged(doc_id, text, units):
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    u = units(text)
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return "plain", len(u), None, None, text
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 50 else f"<P>{p}<S>{s}<M>{m}"
    return "spm" if h4 % 100 < 50 else "psm", len(u), len(p), len(m), out


TEXTS = [None, "", "\n", "\n\n\n", "a", "a\n", "é\nü\n中文\n", "a <P> b\nc", "<S", "<\n<P\n<S\n>\n", "no end", "x\n" * 999, "long ü " * 5000 + "\nend", "\r\n\x0b\n", "😀\n" * 40 + "😀"]
TEXTS += ["".join(rng.choice("ab <>PSM\n é😀") for _ in range(rng.randint(0, 200))) for _ in range(60)]


@pytest.mark.parametrize("unit, units, size", [("line", lines, 1 << 16), ("line", lines, 7), ("word", words, 64), ("char", list, 16), ("char", list, 1)])
def test_fill_middle(spark, unit, units, size):
    """Chunks of a few bytes as well, so that ends of lines, characters and texts fall on their edges."""
    rows = [(k, t, "n", 3) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "n", 3), (None, "one\ntwo\nthree", "n", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    out = fill_middle.rearranged(docs, unit, size=size).withColumn("again", fill_middle.restored(fill_middle.F.col("form"), fill_middle.F.col("output")))
    got = sorted((str(r["doc_id"]), r["form"], r["n"], r["prefix_chars"], r["middle_chars"], r["output"], r["again"]) for r in out.collect())
    want = []
    for i, t, *_ in rows:
        form, n, p, m, o = arranged(i, t or "", units)
        want.append((str(i), form, n, p, m, o, t or ""))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {r[1] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.rearranged(docs.where("false")).count() == 0


def test_fill_middle_of_a_very_long_text(spark):
    text = "".join(f"line {k} é\n" for k in range(200_000))  # more chunks than are counted at once
    r = fill_middle.rearranged(spark.createDataFrame([(5, text)], "doc_id long, text string")).first()
    assert (r["form"], r["n"], r["prefix_chars"], r["middle_chars"], r["output"]) == arranged(5, text, lines)


def test_rates(spark):
    docs = spark.createDataFrame([(k, "a\nb\nc") for k in range(400)], "doc_id long, text string")
    forms = Counter(r["form"] for r in fill_middle.rearranged(docs, rate=50, spm_rate=20).collect())
    assert 140 < forms["plain"] < 260 and forms["psm"] > 2 * forms["spm"] > 0


# hard negatives


def mined(rows, every, k=3, positives=5):
    ok = [(i, x, [math.floor(256 * c) for c in v]) for i, x, v in rows if i is not None and x is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, x, v in ok:
        if i % every:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), j, y) for j, y, w in ok]
        scored.sort(key=lambda r: r[:2])
        for s, j, _ in [r for r in scored if r[2] == x and r[1] != i][:positives]:
            fits = [r for r in scored if r[2] != x and -50 * s <= -100 * r[0] <= -95 * s][:k]
            out += [(i, j, n + 1, r[1], -s, -r[0]) for n, r in enumerate(fits)]
    return sorted(out)


def vectors(n, dim, labels):
    rows = [(k, rng.randrange(labels), [rng.choice([rng.gauss(0, 0.4), 0.25, -0.25]) for _ in range(dim)]) for k in range(n)]
    rows += [(n + k, k % 2, [0.25] * dim) for k in range(30)]  # ties
    rows += [(1000, 1, None), (1001, None, [0.1] * dim), (None, 1, [0.1] * dim), (1002, 1, [float("nan")] * dim), (1003, 1, [None] * dim), (1004, 1, [float("inf")] * dim), (1005, 2, []), (1010, 0, [0.5, 0.5])]
    return rows + [rows[20], rows[20], rows[3], rows[3]]  # repeated anchors and rows


@pytest.mark.parametrize("size, strip, held", [(4096, 64, 1 << 20), (16, 3, 1)])
def test_hard_negatives(spark, monkeypatch, size, strip, held):
    monkeypatch.setattr(hard_negatives, "STRIP", strip)
    monkeypatch.setattr(hard_negatives, "MOST", held)
    rows = vectors(300, 8, 3)
    table = spark.createDataFrame([(i, x, v, "s", 1) for i, x, v in rows], "id long, label int, v array<double>, own string, score int").repartition(4)
    got = hard_negatives.mined(table, lambda i: i % 10 == 0, size=size)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted(tuple(r) for r in got.collect())
    assert found == mined(rows, 10) and len(found) > 100
    assert hard_negatives.mined(table.where("false"), lambda i: i % 10 == 0).count() == 0


def test_inexact_scores_are_an_error(spark):
    table = spark.createDataFrame([(0, 1, [1e9, 1e9]), (1, 1, [1e9, 1e9])], "id long, label int, v array<double>")
    with pytest.raises(Exception, match="not exact"):
        hard_negatives.mined(table, lambda i: i % 10 == 0).collect()


# language ID

SAID = {"aa": "the cat sat on the mat with a hat", "bb": "der hund und die katze sind über dem haus", "cc": "le chien et la souris près de l'été"}


def said(lang, n):
    w = SAID[lang].split()
    return " ".join(rng.choice(w) + rng.choice(["", "", w[0][:2]]) for _ in range(n))


def grams(word, n):
    return [f" {word} "[k : k + n] for k in range(len(word) + 3 - n)] if n > 1 else list(word)


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def find(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_predictions(rows):
    """Everything is known: samples and tables are larger than the texts."""
    learned = [(lang, find(t)) for i, t, lang in rows if i is not None and lang is not None and t is not None and not held(i)]
    langs = sorted({lang for lang, w in learned if w})
    counts = {n: {x: Counter() for x in langs} for n in range(6)}
    for lang, w in learned:
        for word in w:
            counts[0][lang][word] += 1
            for n in range(1, 6):
                counts[n][lang].update(grams(word, n))
    entries = {n: set().union(*counts[n].values()) for n in counts}
    log = lambda n, x, e: math.log((counts[n][x][e] + 0.5) / (sum(counts[n][x].values()) + len(entries[n]) / 2))
    out = []
    for i, t, _ in rows:
        total = dict.fromkeys(langs, 0.0)
        for word in find(t):
            for n in (0, 5, 4, 3, 2, 1):
                known = [e for e in ([word] if n == 0 else grams(word, n)) if e in entries[n]]
                if known:
                    for x in langs:
                        total[x] += sum(log(n, x, e) for e in known) / len(known)
                    break
        best = max(langs, key=lambda x: (total[x], [-ord(c) for c in x])) if find(t) else "und"
        out.append((str(i), i is not None and held(i), best, f"{1 / sum(math.exp(v - total[best]) for v in total.values()):.6f}" if find(t) else "0.000000"))
    return sorted(out)


def test_language_id(spark, monkeypatch):
    rows = [(k, said(lang, rng.randint(1, 30)), lang) for k in range(150) for lang in [rng.choice(list(SAID))]]
    rows += [(200, None, "aa"), (201, "", "bb"), (202, "12 34 !", "aa"), (203, "the der le", None), (None, "the cat", "bb"), (204, "²Ⅷ", "cc"), (205, "Ωmega ΑΒΓ", None), (206, "THE HUND!", "aa")]
    rows += [rows[5], rows[5], (5, "le chien", "cc")]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, held_out string").repartition(3)
    got = lambda: sorted((str(r["doc_id"]), r["held_out"], r["lang_pred"], f"{r['score']:.6f}") for r in language_id.predict(docs, language_id.train(docs)).collect())
    want = plain_predictions(rows)
    assert got() == want
    monkeypatch.setattr(language_id, "PIECE", 20)  # texts in pieces, little remembered
    monkeypatch.setattr(language_id, "MEMORY", 5)
    assert got() == want
    nothing = docs.where("false")
    assert language_id.predict(nothing, language_id.train(docs)).count() == 0
    assert {(r["lang_pred"], r["score"]) for r in language_id.predict(docs, language_id.train(nothing)).collect()} == {("und", 0.0)}


def test_language_bounds(spark):
    """The model is bounded by its parameters, and a sample of ids bounds what is learned from."""
    docs = spark.createDataFrame([(k, f"{said('aa', 20)} only{k}x", "aa") for k in range(100)] + [(k, said("bb", 20), "bb") for k in range(100, 130)], "doc_id long, text string, lang string")
    model = language_id.train(docs, sample=10, words=5, grams=7)
    assert all(len(e) <= 2 * (5 if n == 0 else 7) for n, e in model.place.items()) and model.langs == ["aa", "bb"]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    right = corpus.queries()["op11_language_id"](spark, SF).where("held_out").join(docs, "doc_id").selectExpr("avg(cast(lang = lang_pred as int)) as a").first()["a"]
    assert right > 0.98
