"""Small cases of every operator against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import dataclasses
import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import oracle
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from pairscope.llm import byte_bpe, decontaminate, exact_dedup, licenses, pseudonyms, quality, repeats, simhash, substring_dedup, suffix_dedup, token_files
from pairscope.llm import catalog as corpus
from pairscope.llm.store import as_table

SF = "/root/testdata/sf0.01"
rng = random.Random(11)
SENTENCE = "the quick brown fox jumps over the lazy dog and runs far away from the old grey house near the river bank "


def noise(n):
    return "".join(rng.choice("abcdefgh é.\n") for _ in range(n))


LINE = SENTENCE * 3
TEXTS = [LINE + noise(60), noise(50) + LINE, "x" * 400, None, "", "  \n", "word", LINE + noise(60), "One short text", "one short text", noise(3000)]
TEXTS += [noise(rng.randint(0, 90)) + SENTENCE * 2 + noise(rng.randint(0, 90)) for _ in range(25)]
ROWS = [(k, t) for k, t in enumerate(TEXTS)] + [(2, TEXTS[2]), (2, TEXTS[2]), (None, TEXTS[0]), (77, TEXTS[0])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, 0.5, "k") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, keep_id string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def plain(df, *columns):
    return sorted([tuple(oracle.plain(r[c]) for c in columns) for r in df.collect()])


def listed(rows):
    return sorted(tuple(oracle.plain(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", ["op2_license_scan", "op3_exact_dedup"])
def test_equals_sql(spark, name):
    assert oracle.differences(spark, oracle.connect(SF), corpus.queries()[name], corpus.oracle_sql()[name], SF) == []


def test_exact_dedup(docs, none):
    groups = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(-1 if i is None else i)
    want = [(i, max(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS]
    for budget in (exact_dedup.BUDGET, 1500):  # the second needs several levels
        got = exact_dedup.groups_of_equal(docs, budget=budget)
        assert plain(got, "doc_id", "keep_id", "group_size", "text_sha256") == listed(want)
        assert got.where("kept").count() == len(groups)
        left = exact_dedup.dedup(docs, budget=budget)
        assert left.columns == docs.columns
        assert plain(left, "doc_id") == listed([(max(g),) for g in groups.values()])
    assert exact_dedup.groups_of_equal(none).count() == exact_dedup.dedup(none).count() == 0


def test_depth_of_exact_dedup(spark, monkeypatch):
    """Buckets that do not fit are dealt again each for itself: the number of levels does not grow with the rows."""
    levels = []
    write = exact_dedup.as_table
    monkeypatch.setattr(exact_dedup, "as_table", lambda df, name: levels.append(name) or write(df, name))
    for n in (200, 800, 3200):
        texts = [f"text {k} " + "x" * (k % 50) for k in range(n)]
        levels.clear()
        kept = exact_dedup.dedup(spark.createDataFrame(list(enumerate(texts + texts[:9])), "doc_id long, text string"), budget=5000)
        assert kept.count() == n and kept.where(f"doc_id >= {n}").count() == 9
        assert len(levels) <= 4


def test_superseded_winners_are_let_go(monkeypatch):
    """Ever larger ids of three texts: the last ones stay with their own columns, and few rows are held meanwhile."""
    monkeypatch.setattr(exact_dedup, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(exact_dedup, "SPARE", 4)
    taken = []
    table = SimpleNamespace(from_batches=lambda held: taken.append(sum(b.num_rows for b in held)) or pa.Table.from_batches(held))
    monkeypatch.setattr(exact_dedup, "pa", SimpleNamespace(**(vars(pa) | {"Table": table})))
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": ["abc"[k % 3]], "more": [f"m{k}"], "row": [k], "hash": [k % 3]}) for k in range(300)]
    out = pa.Table.from_batches(exact_dedup._keep(["doc_id", "text", "more"], "text", "doc_id", 1 << 20)(iter(batches))).to_pylist()
    assert sorted((r["doc_id"], r["text"], r["more"]) for r in out if r["kept"]) == [(297, "a", "m297"), (298, "b", "m298"), (299, "c", "m299")]
    assert len(taken) > 10 and max(taken) <= 2 * 3 + 4 + 1


def test_a_text_of_many_tasks_is_merged_before_it_meets(spark, monkeypatch):
    """One text in every one of 60 tasks: the square root of them arrives, and the results are the same."""
    rows = [(k, "the same text" if k % 3 else f"text {k}") for k in range(600)] + [(7, None), (8, ""), (9, None)] + [(10, "the same text")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(60, "doc_id")
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = listed([(i, max(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows])
    arrived, levels = [], exact_dedup._levels
    monkeypatch.setattr(exact_dedup, "_levels", lambda standing, text, *a: arrived.append(standing.groupBy("hash").count().agg({"count": "max"}).first()[0]) or levels(standing, text, *a))
    for hot in (1000, 5):
        got = exact_dedup.groups_of_equal(docs, hot=hot)
        assert plain(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
        assert got.where("kept").count() == len(groups)
        left = exact_dedup.dedup(docs, hot=hot)
        assert plain(left, "doc_id") == listed([(max(g),) for g in groups.values()])
    assert min(arrived[:2]) >= 40 and max(arrived[2:]) <= 8


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, none):
    fps = [fingerprint(t) for _, t in ROWS]
    label = list(range(len(fps)))
    for _ in fps:
        for a in range(len(fps)):
            for b in range(len(fps)):
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
    least = {c: min(i for (i, _), d in zip(ROWS, label) if d == c and i is not None) for c in set(label)}
    want = [(i, f"{f:016x}", least[c]) for (i, _), f, c in zip(ROWS, fps, label)]
    assert plain(simhash.near_copies(docs), "doc_id", "fingerprint", "component_id") == listed(want)
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == len(set(label))
    assert simhash.near_copies(none).count() == simhash.one_of_each(none).count() == 0


def test_simhash_of_a_very_long_text():
    """More shingles than are counted at a time."""
    say = random.Random(3)
    text = " ".join(f"W{say.randrange(5000)}" for _ in range(30_000))
    words, ones = text.lower().split(), [0] * 64
    for k in range(len(words) - 2):
        h = xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * ones[b] > len(words) - 2)


def test_substring_dedup(docs, none):
    window = 12
    words = [(t or "").encode().split() for _, t in ROWS]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    want = []
    for (i, _), w in zip(ROWS, words):
        gone = {k + j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(window)}
        want.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).hex()))
    got = [(r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).hex()) for r in substring_dedup.without_repeats(docs, window, 4).collect()]
    assert listed(got) == listed(want)
    assert substring_dedup.without_repeats(none).count() == 0


@pytest.mark.parametrize("most", [suffix_dedup.MOST, 3])  # the second halves the runs of common anchors
def test_suffix_dedup(docs, none, most):
    window = 40
    data = [(t or "").encode() for _, t in ROWS]
    seen = Counter(d[k : k + window] for d in data for k in range(len(d) - window + 1))
    want = []
    for (i, _), d in zip(ROWS, data):
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - window + 1):
            if seen[d[k : k + window]] > 1:
                gone[k : k + window] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want.append((i, len(d), int(gone.sum()), spans, np.frombuffer(d, np.uint8)[~gone].tobytes().hex()))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]).hex()) for r in suffix_dedup.without_repeats(docs, window, 12, most).collect()]
    assert listed(got) == listed(want)
    assert suffix_dedup.without_repeats(none).count() == 0


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup])
def test_lists_of_equal_rows_hold_one_row_s_spans(spark, operator, monkeypatch):
    rows = [(7, SENTENCE * 20)] * 60 + [(k, SENTENCE * 20 + f"{k} ends here") for k in range(3)]
    seen, gather = [], repeats.with_lists

    def with_lists(docs, lists, names, how):
        out = gather(docs, lists, names, how)
        seen.append((out[1].selectExpr("sum(size(found))").first()[0], lists.select("k1", "k2", *names).distinct().count()))
        return out

    for module in (operator, repeats):
        monkeypatch.setattr(module, "with_lists", with_lists)
    got = operator.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 63 and all(r["n_removed"] > 0 for r in got) and {r["n_removed"] for r in got if r["doc_id"] == 7} == {len((SENTENCE * 20).split()) if operator is substring_dedup else len(SENTENCE * 20)}
    assert seen and all(n == own for n, own in seen)


def test_paths_of_the_graph(spark):
    """Compaction against a graph built in plain Python."""
    window = 5
    say = random.Random(3)
    parts = [" ".join(say.choice("abcdefghijklmnopqrstuvwxyz") + str(say.randint(0, 40)) for _ in range(n)) for n in (30, 12, 50, 8, 21, 40)]
    texts = [parts[0] + " x " + parts[1], parts[1] + " " + parts[0], parts[2], "y " + parts[2] + " z", parts[3] + " " + parts[4], parts[4], parts[0] + " " + parts[2]]
    texts += [" ".join(parts[5].split()[:25]), " ".join(parts[5].split()[10:]), parts[5].split()[0] + " " + " ".join(parts[5].split()[10:33]), "q q q q q q q q q q q q", "r s r s r s r s r s r s"]
    count = Counter(tuple(w[k : k + window]) for w in map(str.split, texts) for k in range(len(w) - window + 1))
    edges = {e for e, c in count.items() if c > 1}
    into, out = Counter(e[1:] for e in edges), Counter(e[:-1] for e in edges)
    linked = {v for v in into if into[v] == out[v] == 1}
    after = {e[:-1]: e for e in edges}
    want, seen = [], set()
    for e in edges:
        if e[:-1] not in linked:
            n, seen_, x = 1, {e}, e
            while x[1:] in linked:
                x = after[x[1:]]
                seen_.add(x)
                n += 1
            want.append(n)
            seen |= seen_
    rings = len(edges) - len(seen)  # edges on rings without a branch
    got = [r["n_edges"] for r in substring_dedup.paths(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), window, 2).collect()]
    assert sum(got) == len(edges) and rings == 3
    for n in want:
        got.remove(n)
    assert sum(got) == rings


def test_spans_are_compared_with_their_source(spark, monkeypatch):
    """Words of one hash: what hashes say is equal is not, and the comparison sees it."""
    docs = spark.createDataFrame([(1, "a1 b1 c1 d1 e1 f1"), (2, "a2 b2 c2 d2 e2 f2"), (3, "a1 b1 c1 d1 e1 f1")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup.without_repeats(docs, 4, 2, seed=5).collect()) == [(1, 6), (2, 0), (3, 6)]

    def blind(data, offsets, seed=0):
        data = data.copy()
        data[(data >= 49) & (data <= 50)] = 48
        return repeats.word_codes(data, offsets, seed)

    how = repeats.Windows(blind, 4, 2, visits=True)
    monkeypatch.setattr(substring_dedup, "word_codes", blind)
    keyed = repeats.keyed(docs)
    with pytest.raises(Exception, match="another seed"):
        repeats.without_spans(keyed, *repeats.repeated_pieces(keyed, how, substring_dedup._resolve(how)), 4, repeats.WORDS)


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup])
def test_sources_are_asked_in_bounded_stretches(spark, operator, monkeypatch):
    """However many documents quote stretches of one text, nothing grows in one place but what they ask, and that is merged."""
    say = random.Random(8)
    source = [f"w{say.randint(0, 10**6)}" for _ in range(1200)]
    for n in (100, 400):
        quotes = []
        for k in range(n):
            lo = say.randint(0, 1100)
            quotes.append(f"own{k} " + " ".join(source[lo : lo + say.randint(60, 90)]) + f" own{k}")
        seen = {}
        done = repeats.differing
        monkeypatch.setattr(repeats, "differing", lambda t: seen.update(most=max(len(r["found"]) for r in lists[-1].collect()), stretches=t.selectExpr("max(size(stretches))").first()[0], bad=done(t)) or 0)
        lists, gather = [], repeats.with_lists
        monkeypatch.setattr(repeats, "with_lists", lambda *a: (lambda out: lists.append(as_table(out[1], "seen")) or out)(gather(*a)))
        rows = [(-1, " ".join(source))] + list(enumerate(quotes))
        got = {r["doc_id"]: r["n_removed"] for r in operator.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
        monkeypatch.undo()
        form = repeats.WORDS if operator is substring_dedup else repeats.BYTES
        assert seen["bad"] == 0 and seen["stretches"] <= -(-len(form.opened(rows[0][1].encode())) // form.stretch) and len(got) == n + 1 and min(got.values()) > 0
        # of the source its own runs, of a quote its own
        assert seen["most"] <= len(source)


@pytest.mark.parametrize("stretch", [1, 7, 64])
def test_stretches_of_any_size(docs, stretch, monkeypatch):
    monkeypatch.setattr(substring_dedup, "WORDS", dataclasses.replace(repeats.WORDS, stretch=stretch))
    monkeypatch.setattr(suffix_dedup, "BYTES", dataclasses.replace(repeats.BYTES, stretch=stretch * 8))
    monkeypatch.setattr(repeats, "BLOCK", 64)  # and texts in blocks
    test_substring_dedup(docs, docs.where("false"))
    test_suffix_dedup(docs, docs.where("false"), 2000)


def test_suffix_dedup_of_the_tables(spark):
    """The query against brute force on whole documents at its own window."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    data = [(r["text"] or "").encode() for r in rows]
    seen = Counter(d[k : k + 200] for d in data for k in range(len(d) - 199))
    want = []
    for r, d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - 199):
            if seen[d[k : k + 200]] > 1:
                gone[k : k + 200] = True
        want.append((r["doc_id"], len(d), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    got = corpus.queries()["op9_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and sum(w[2] > 0 for w in want) > 20


def test_interval_expansion_states_common_prefixes():
    for t in range(40):
        strings = [bytes(rng.choice(b"ab" + b"cdef" * (t % 3)) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 12))]
        strings += strings[:2] if t % 4 == 0 else []
        n = rng.randint(1, 9)
        seen = Counter(s[k : k + n] for s in strings for k in range(len(s) - n + 1))
        want = [x for s in strings for x in [*(k + n <= len(s) and seen[s[k : k + n]] > 1 for k in range(len(s))), False]]
        assert suffix_dedup.shared_starts(strings, n).tolist() == want


def edits(item, text):
    row = np.zeros(len(text) + 1, int)
    signs, step = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    for k, c in enumerate(item):
        new = np.empty_like(row)
        new[0] = k + 1
        new[1:] = np.minimum(row[:-1] + (signs != c), row[1:] + 1)
        row = np.minimum.accumulate(new - step) + step
    return int(row.min())


def test_decontamination(spark, docs, none):
    items = [(k, "".join(rng.choice("abcde fg") for _ in range(rng.choice([3, 5, 13, 20, 60, 90, 140])))) for k in range(20)] + [(20, None), (21, ""), (22, "!?")]
    texts = []
    for k in range(80):
        own = list(rng.choice(items[:20])[1])
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(own))
            own[at : at + rng.randint(0, 1)] = rng.choice(["x", "", "yz"])
            own = own or ["q"]
        texts.append((k, noise(rng.randint(0, 60)) + ("".join(own) if k % 2 else "") + noise(rng.randint(0, 60))))
    texts += [(200, None), (201, ""), (1, texts[1][1])]
    q, rate = 6, 0.1

    def own(t):  # stated here again, on its own
        return b" " + b" ".join(re.findall(rb"[0-9a-z\x80-\xff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode())) + b" "

    want = []
    for i, t in texts:
        for k, x in items:
            x = own(x)
            if len(x) > 2 and (d := edits(x, own(t))) <= math.floor(rate * (len(x) - 2)):
                want.append((i, k, d))
    index = decontaminate.Index.of(items, q, rate)
    assert len(index) > 1 and all((g.bound >= 1).all() for g in index)
    table, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK, 300):
        assert plain(decontaminate.find_leaks(table, bench, q, rate, block), "doc_id", "item_id", "edits") == listed(want)
    assert len(want) > 10
    held = {i for i, *_ in want}
    assert plain(decontaminate.without_leaks(table, bench, q, rate, 300), "doc_id") == listed([(i,) for i, _ in texts if i not in held])
    assert all(g.place.dtype == np.int32 and len(g.marked(g.gram)) == len(g.gram) for g in index)  # no q-gram of an item is passed over
    far = [(1, "filler words that say nothing " * 40_000 + (items[10][1] + " ") * 2), (2, "filler words that say nothing " * 40_000)]  # over 1 MB, the item at the end
    long_item = spark.createDataFrame([(7, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    far = [(i, t + (" one two three four fife six seven eight nine ten eleven." if i == 1 else "")) for i, t in far]
    assert plain(decontaminate.find_leaks(spark.createDataFrame(far, "doc_id long, text string"), long_item), "doc_id", "item_id", "edits") == listed([(1, 7, 1)])
    assert decontaminate.find_leaks(none, bench).count() == decontaminate.find_leaks(docs, bench.where("false")).count() == 0


def test_licenses(spark, none):
    rows = [(1, "Released under the MIT License."), (2, "x\nLicensed under CC BY-NC 4.0.\ny"), (3, None), (4, ""), (5, "the mit license"), (6, "UNDER the\tMIT license under the mit-license cc by nc cc by nc"), (None, "Apache License, Version 2.0"), (6, "all rights reserved")]
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    see = lambda *k: tuple(got[k][c] for c in ("n_base", "first_word", "last_word", "base_labels", "labels", "score"))
    assert see(1, 5) == (1, 1, 1, "mit", "mit", 1.0)
    assert see(2, 9) == (1, 3, 3, "cc-by-nc", "cc-by-nc", 1.0)
    assert see(3, 0) == see(4, 0) == (0, None, None, "", "", 0.0)
    assert see(5, 3) == (0, None, None, "", "", 0.0)
    assert see(6, 14) == (4, 0, 11, "cc-by-nc,mit", "cc-by-nc,mit", 1.0)
    assert see(None, 5) == (1, 0, 0, "apache-2", "apache-2", 1.0)
    assert see(6, 3) == (0, None, None, "", "rights-reserved", 1.0)
    assert licenses.scan(none).count() == 0


STANDARD = {
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "apache-2": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def test_licenses_in_standard_text(spark):
    texts = [(label, text) for label, text in STANDARD.items()] + licenses.TEMPLATES
    rows = []
    for k, (_, text) in enumerate(texts):
        for width in (80, 30):
            for sign in ("", " * "):
                rows.append((k, "def main():\n\n" + "\n".join(sign + x for x in textwrap.wrap("Notice of the file. " + text, width)) + "\n\nimport os"))
    rows += [(900, "all the rights\nof man are reserved"), (901, "\n".join(textwrap.wrap((STANDARD["isc"] + " x " * 30) * 3, 80)))]
    rows += [(902, "a copy\n" + STANDARD["isc"] + "\nfor any purpose"), (903, "redistribution and use in source\n" * 200)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] < 900:
            label = texts[r["doc_id"]][0]
            assert label in r["labels"].split(",") and r["score"] >= 0.9 and (r["n_blocks"] >= 1 or r["n_base"]), r
    see = {r["doc_id"]: (r["labels"], r["n_blocks"]) for r in got}
    assert see[900] == ("", 0) and see[901] == ("isc", 3) and see[902] == ("isc", 1) and see[903] == ("", 0)


def test_licenses_against_plain_python(spark):
    """Blocks and windows across their ends, each looked at on its own; templates and threshold as parameters, one a long text."""
    say = random.Random(8)
    long_text = " ".join(f"w{say.randint(0, 90)}" for _ in range(120))
    known = [("short", "alpha beta gamma"), ("twice", "alpha beta alpha beta delta epsilon zeta"), ("long", long_text)]
    pool = "alpha beta gamma delta epsilon zeta other word more".split()
    rows = []
    for k in range(120):
        out = [say.choice(pool) + say.choice([" ", " ", " ", "\n", ". ", ", ", "\n\n"]) for _ in range(say.randint(0, 30))]
        if k % 3 == 0:
            own = long_text.split()
            for _ in range(say.randint(0, 16)):
                own[say.randrange(len(own))] = say.choice(["Xx", "x-y", ""])
            out += textwrap.fill(" ".join(own), say.choice([30, 79, 2000])) + "\n"
            out += [say.choice(pool) + " " for _ in range(5)]
        rows.append((k, "".join(out)))
    threshold = 0.9
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    want = []
    for i, t in rows:
        blocks = [word(b) for b in re.split(r"[\n\r]+|[.!?][ \t]", t)]
        all_ = [(w, n) for n, b in enumerate(blocks) for w in b]
        labels, score = set(), 0.0
        for label, x in known:
            mine, span = set(x.split()), len(x.split())
            pieces = [set(b) for b in blocks]
            pieces += [{w for w, _ in all_[k : k + span]} for k in range(max(1, len(all_) - span + 1)) if all_[k : k + span] and all_[k][1] < all_[min(len(all_), k + span) - 1][1]]
            best = max((len(mine & p) / len(mine) for p in pieces), default=0)
            if best >= threshold - 1e-9:
                labels.add(label)
                score = max(score, best)
        want.append((i, ",".join(sorted(labels)), score))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan(docs, known, threshold)
    assert plain(got, "doc_id", "labels", "score") == listed(want)
    assert {x for _, x, _ in want} > {"", "short", "long"}
    assert same_as_sql(docs, known) == len(rows)


def same_as_sql(docs, known):
    """All columns, places across ends included; the number of rows."""
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    cur = con.execute(licenses.sql(known))
    want, got = oracle.rows([d[0] for d in cur.description], cur.fetchall()), licenses.scan(docs, known)
    assert oracle.rows(got.columns, got.collect()) == want
    return len(want)


def test_whole_licenses(spark):
    """Each text wrapped, in comments, with other words in it and in one line is found; half of it is not; SQL says the same."""
    say, rows, wanted = random.Random(4), [], {}
    for label, text in licenses.TEXTS:
        words = text.split()
        changed = [w if k % 40 else "foo" for k, w in enumerate(words)]
        forms = ["\n".join(textwrap.wrap(text, 72)), "\n".join(" * " + x for x in textwrap.wrap(text, 60)), " ".join(words), text + "\n\n" + text, "Copyright 2001 A. B.\n\n" + "\n".join(textwrap.wrap(" ".join(changed), 72))]
        for f in forms:
            wanted[len(rows)] = label
            rows.append((len(rows), "# notice\n" + f + "\n\nimport os\n" + noise(say.randint(0, 80))))
        rows.append((len(rows), " ".join(words[: len(words) // 2])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in licenses.scan(docs).collect():
        found = set(r["labels"].split(","))
        if r["doc_id"] in wanted:
            assert wanted[r["doc_id"]] in found and r["score"] >= 0.9, r
        else:
            assert not found & {label for label, _ in licenses.TEXTS}, r
    assert same_as_sql(docs, licenses.TEMPLATES) == len(rows)


def test_reach_follows_the_template(spark):
    """Only the words of a long template gather its length around them."""
    from pyspark.sql import functions as F

    text = "a. near b c d e f g. " * 3 + "far h i j k l m n. o p q"
    row = spark.createDataFrame([(text,)], "text string").select(licenses._stretches(F.col("text"), {"near": 2, "far": 9}).alias("s")).first()
    assert sorted({(s["reach"], len(s["own"])) for s in row["s"]}) == [(2, 3), (9, 17)]


def feistel(x, a, b, kind, key=pseudonyms.TEST_KEY):
    digest = lambda k, v: int(hashlib.sha256(f"{key}|{kind}|{k}|{v}".encode()).hexdigest()[:12], 16)
    left, right = divmod(x, b)
    for k in range(1, pseudonyms.ROUNDS + 1):
        if k % 2 == 0:
            left = (left + digest(k, right)) % a
        else:
            right = (right + digest(k, left)) % b
    return left * b + right


def luhn(digits):
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10


def test_pseudonyms(spark, none):
    rows = [(1, "card 4041894974608795, 4041 8949 7460 8795; bad 4041894974608796"), (2, "ip 42.144.35.254. not 300.1.1.1 nor 1.2.3"), (3, "+1 (988) 555-2485 and 988-555-2485"), (4, "2001-02-28 2001-02-30"), (5, None), (6, ""), (7, "a bosbt.42@mail8.example.com b"), (None, "666-12-3456 123-45-6789"), (4, "2001-02-28 2001-02-30")]
    got = [(r["doc_id"], r["text"], len(r["found__"])) for r in pseudonyms.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), pseudonyms.TEST_KEY).collect()]
    text = {i: t for i, t, _ in got}
    body = f"{feistel(404189497460879, 10**7, 10**8, 'card'):015d}"
    card = body + str(next(c for c in range(10) if luhn(body + str(c)) == 0))
    assert text[1] == f"card {card}, {card[:4]} {card[4:8]} {card[8:12]} {card[12:]}; bad 4041894974608796"
    ip = feistel(((42 * 256 + 144) * 256 + 35) * 256 + 254, 65536, 65536, "ip")
    assert text[2] == f"ip {'.'.join(str(ip >> k & 255) for k in (24, 16, 8, 0))}. not 300.1.1.1 nor 1.2.3"
    phone = f"{feistel(9885552485, 10**5, 10**5, 'phone'):010d}"
    assert text[3] == f"+1 ({phone[:3]}) {phone[3:6]}-{phone[6:]} and {phone[:3]}-{phone[3:6]}-{phone[6:]}"
    day = np.datetime64("1900-01-01") + feistel(int((np.datetime64("2001-02-28") - np.datetime64("1900-01-01")).astype(int)), 17, 4297, "date")
    assert text[4] == f"{day} 2001-02-30"
    assert text[5] is None and text[6] == "" and "bosbt" not in text[7] and text[7].endswith("@mail8.example.com b")
    area, group, serial = 123, 45, 6789
    y = feistel(((area - 1) * 99 + group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn")
    a = y // (99 * 9999) + 1
    assert text[None][12:] == f"{a + (a >= 666):03d}-{y % (99 * 9999) // 9999 + 1:02d}-{y % 9999 + 1:04d}"
    mail = "bosbt.42@mail8.example.com"
    assert text[7] == f"a u{hashlib.sha256(f'{pseudonyms.TEST_KEY}|email|{mail}'.encode()).hexdigest()[:14]}@mail8.example.com b"
    assert text[None].startswith("666-12-3456 ") and re.fullmatch(r"\d{3}-\d\d-\d{4}", text[None][12:]) and "123-45" not in text[None]
    assert sorted(n for *_, n in got) == [0, 0, 1, 1, 1, 1, 1, 2, 2]
    assert pseudonyms.pseudonymize(none, "k").columns[:-1] == none.columns


ALONE = [
    ("phone", "+45 12 34 56 78"), ("phone", "+49 30 123 456"), ("phone", "+33 6 12 34 56 78"), ("phone", "+33.6.12.34.56.78"), ("phone", "+55 11 9 123-45-67"), ("phone", "+44 (0)20 794 609 58"), ("phone", "+49 89 123 45-0"),
    ("phone", "+45 12345678"), ("phone", "+4512345678"), ("phone", "+1 988 555 2485"), ("phone", "(988) 555-2485"), ("phone", "988.555.2485"), ("card", "4041894974608795"), ("card", "4041 8949 7460 8795"), ("card", "4041-8949-7460-8795"),
    ("ssn", "123-45-6789"), ("ip", "1.2.3.4"), ("date", "2001-02-28"), ("date", "2001/02/28"), ("date", "1.2.2001"), ("date", "2/1/2001"), ("email", "a@b.cd"),
    ("phone", "0041 44 668 18 00"), ("phone", "0044-20-7946-0958"), ("iban", "DE89370400440532013000"), ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB29NWBK60161331926819"), ("date", "10.2.2001"), ("date", "2.10.2001"), ("date", "12/5/1999"), ("date", "25/3/1999"),
]


def test_each_form_alone_in_a_text(spark):
    rows = [(k, f"call {v} now") for k, (_, v) in enumerate(ALONE)] + [(k + 100, f"call {v} now, 2.5 at 1234") for k, (_, v) in enumerate(ALONE)]
    rows += [(200, "+45 12 34 56 78 2 items"), (201, "+3.14159265 and +2.5 100 200 300 and +12 345")]
    got = {r["doc_id"]: (r["text"], [tuple(f) for f in r["found__"]]) for r in pseudonyms.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), pseudonyms.TEST_KEY).collect()}
    for k, (kind, v) in enumerate(ALONE):
        text, found = got[k]
        assert [f[0] for f in found] == [kind] and v not in text and text == f"call {found[0][1]} now", v
        assert got[k + 100] == (f"call {found[0][1]} now, 2.5 at 1234", found), v
    tail = f"{feistel(2345678, 10**3, 10**4, 'phone'):07d}"
    assert got[0][0] == f"call +45 1{tail[0]} {tail[1:3]} {tail[3:5]} {tail[5:]} now"
    assert got[200][0] == got[0][0].removeprefix("call ").removesuffix(" now") + " 2 items"
    assert got[201] == (rows[-1][1], [])


def test_dates_stay_in_their_written_form(spark):
    """Of each form all its dates: widths of day and month, order and validity stay, and different dates stay different."""
    first = np.datetime64("1900-01-01")
    days = [str(first + k) for k in range(0, 73049, 3)]
    forms = {"d.m": "{d}.{m}.{y}", "dd.mm": "{d:02d}.{m:02d}.{y}", "dd.m": "{d:02d}.{m}.{y}", "d.mm": "{d}.{m:02d}.{y}", "m/d": "{m}/{d}/{y}"}
    rows = sorted({(name, f.format(d=int(x[8:]), m=int(x[5:7]), y=x[:4])) for name, f in forms.items() for x in days})
    made = spark.createDataFrame([(f"{k}", v) for k, v in rows], "doc_id string, text string").withColumn("new", pseudonyms._date(pseudonyms.F.col("text"), "k")).collect()
    seen = {}
    for r in made:
        a, b = (re.split(r"[./]", r[c]) for c in ("text", "new"))
        assert [len(x) for x in a] == [len(x) for x in b], r
        day, month = (0, 1) if "." in r["text"] else (1, 0)
        np.datetime64(f"{b[2]}-{int(b[month]):02d}-{int(b[day]):02d}")  # is a date
        assert 1900 <= int(b[2]) < 2100
        seen.setdefault((len(a[0]), len(a[1]), r["text"].count(".")), {}).setdefault(r["new"], set()).add(r["text"])
    assert all(len(old) == 1 for form in seen.values() for old in form.values()) and len(seen) >= 8


def test_iban(spark):
    def valid(s):
        s = s.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1

    texts = ["pay DE89 3704 0044 0532 0130 00, or GB29NWBK60161331926819.", "DE88370400440532013000", "DE89370400440532013000"]
    got = {r["doc_id"]: (r["text"], [f["pseudonym"] for f in r["found__"]]) for r in pseudonyms.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pseudonyms.TEST_KEY).collect()}
    one, two = got[0][1]
    assert got[0][0] == f"pay {one}, or {two}." and valid(one) and valid(two) and one[:2] == "DE" and two[:2] + two[4:8] == "GBNWBK" and "3704 0044" not in one
    body = f"{feistel(370400440532013000, 10**9, 10**9, 'iban'):018d}"
    assert one.replace(" ", "")[4:] == body and got[2][0] == one.replace(" ", "")
    assert got[1] == (texts[1], [])  # a wrong sum stays


def test_permutation_is_one_to_one(spark):
    from pyspark.sql import functions as F

    y = spark.range(17 * 4297).select(pseudonyms.permuted(F.col("id"), 17, 4297, "k", "date").alias("y"))
    assert tuple(y.agg(F.countDistinct("y"), F.min("y"), F.max("y")).first()) == (73049, 0, 73048)


def test_quality_on_held_out_rows(spark, none):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert np.mean(good.values[:, None] > bad.values[None, :]) > 0.9
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
    assert all(held) and ((got.predicted == 1) == (got.score >= 0.3)).all()
    assert quality.classify(none, labels).count() == quality.keep_good(none, labels).count() == 0


def bag(text):
    """The features of a text, one by one."""
    whole = " " + re.sub("[A-Z]", lambda m: m[0].lower(), text or "") + " "
    space, mask = " \t\n\v\f\r", (1 << 64) - 1
    mix = lambda h: (h * 0x9E3779B97F4A7C15 & mask) >> 46
    out = Counter([quality.END_OF_TEXT])
    for n in quality.GRAMS:
        for p in range(len(whole) - 1):
            g = whole[p : p + n]
            if len(g) == n and not any(c in space for c in g[1:-1]):
                h = ord(g[0]) + 1
                for c in g[1:]:
                    h = h * 0x100000001B3 + ord(c) + 1 & mask
                out[mix(h)] += 1
    for word in re.findall(r"[^ \t\n\v\f\r]+", whole):
        out[mix(sum((ord(c) + 1) * 0x100000001B3**k for k, c in enumerate(word)) & mask)] += 1
    return out


def test_quality_against_plain_python(spark):
    """Features, every step of the training, and scores; nulls, empty, repeated, long and non-ASCII texts."""
    say = random.Random(5)
    words = "Good fine text über Straße 数据 清洗 нет spam buy now !!! click 😀 win".split()
    rows = [(k, " ".join(say.choice(words[:9] if k % 2 else words[7:]) for _ in range(say.randint(1, 30)))) for k in range(60)]
    rows += [(60, None), (61, ""), (62, " \n\t "), (63, "Straße " * 400_000), (1, rows[1][1]), (2, "another text of the same id"), (None, "no id")]
    labels = [(k, k % 2, 0) for k in range(64)] + [(1, 0, 1), (None, 1, 0), (5, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known = {}
    for i, q, _ in labels:
        if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5:
            known[i] = min(q, known.get(i, 1))
    bags = {}
    for i, t in rows:
        if i in known:
            c = bag(t)
            ids = sorted(c)
            mine = (np.array(ids, "<i4").tobytes(), np.array([c[k] for k in ids], "<f4").tobytes())
            bags[i] = min(bags.get(i, mine), mine)
    want = quality.fit([(known[i], np.frombuffer(bags[i][0], np.int32), np.frombuffer(bags[i][1], np.float32)) for i in sorted(known)])
    model = quality.train(docs, marks)
    assert np.array_equal(model.vectors, want.vectors) and np.array_equal(model.output, want.output)
    # the training itself, with plain numbers
    few = [(known[i], *(np.frombuffer(b, k) for b, k in zip(bags[i], (np.int32, np.float32)))) for i in sorted(known)[:7]]
    got, rng_ = quality.fit(few, dim=3, epochs=2, rate=0.4, seed=9), np.random.default_rng(9)
    vectors, output, step = ((rng_.random((quality.BUCKETS, 3)) - 0.5) / 3).astype(np.float32).astype(float), [[0.0] * 3, [0.0] * 3], 0
    for _ in range(2):
        for k in rng_.permutation(7):
            label, ids, counts = few[k]
            share = [float(c) / float(counts.sum()) for c in counts]
            hidden = [sum(s * vectors[i][d] for s, i in zip(share, ids)) for d in range(3)]
            odds = [math.exp(sum(o[d] * hidden[d] for d in range(3))) for o in output]
            error = [o / sum(odds) - (c == label) for c, o in enumerate(odds)]
            back = [sum(error[c] * output[c][d] for c in range(2)) for d in range(3)]
            rate = 0.4 * (1 - step / 14)
            for s, i in zip(share, ids):
                for d in range(3):
                    vectors[i][d] -= rate * min(len(ids), 64) * s * back[d]
            for c in range(2):
                for d in range(3):
                    output[c][d] -= rate * error[c] * hidden[d]
            step += 1
    assert np.allclose(got.vectors, vectors, atol=1e-4) and np.allclose(got.output, output, atol=1e-4)
    table = model.table().astype(float)
    scores = Counter()
    for r in quality.classify(docs, marks).collect():
        scores[r["doc_id"], round(r["score"], 4)] += 1
    for i, t in rows:
        c = bag(t) if i != 63 else None
        if c:
            x = 1 / (1 + math.exp(-sum(table[k] * n for k, n in c.items()) / sum(c.values())))
            assert any(scores[i, round(x + e, 4)] for e in (0, 1e-4, -1e-4)), (i, t, x)
    assert sum(scores.values()) == len(rows)


def test_quality_without_labels(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.classify(docs, empty).collect()} == {0.5}
    assert quality.keep_good(docs, empty).columns == docs.columns


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rare = "".join(map(chr, (0x0CDC, 0xB8E0, 0x558, 0x58B, 0x88F, 0xC5C, 0x2028, 0x85, 0x1F600, 0x301)))
    extra = [(900, "a <|endoftext|> b"), (901, rare), (902, " ".join(rare) + " ' 's 'S"), (None, None), (None, "no id"), (7, "one id, two texts"), (7, None), (7, TEXTS[7]), (903, noise(50_000))]
    table = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(ROWS)] + extra, "doc_id long, text string")
    folder = f"file://{tmp_path}/ids"
    manifest = token_files.write_token_files(table, folder, path, parts=3)
    got = token_files.read_token_files(spark, folder, manifest, token_files._digests, "doc_id long, start long, n_tokens long, ids_crc32 long")
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()))
    want = {}
    for r in table.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    ids = [i for _, i, *_ in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))  # null first
    assert [s for s, *_ in got] == [0, *np.cumsum([n for _, _, n, _ in got]).tolist()][:-1]
    assert {i: sorted((n, c) for _, j, n, c in got if j == i) for i in set(ids)} == {i: sorted(x) for i, x in want.items()}
    assert token_files.write_token_files(none, folder, path) == []


def test_byte_bpe(docs, none, monkeypatch):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rare = "".join(map(chr, (0x0CDC, 0xB8E0, 0x558, 0x58B, 0x88F, 0xC5C, 0x2028, 0x85, 0x1F600, 0x301)))
    more = [(900, rare), (901, " ".join(rare)), (902, "".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) + rng.choice(" a1'.\n") for _ in range(9000))), (903, noise(60_000))]
    docs = docs.unionByName(docs.sparkSession.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    want = []
    for i, t in ROWS + more:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert plain(byte_bpe.with_digests(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == listed(want)
    monkeypatch.setattr(byte_bpe, "BLOCK", 500)  # many blocks that share words
    coded = byte_bpe.with_ids(docs, path)
    texts = ROWS + more
    assert sorted((r["doc_id"] or -1, list(r["ids"])) for r in coded.collect()) == sorted((i or -1, library.encode_ordinary(t or "")) for i, t in texts)
    assert sorted((r["doc_id"] or -1, bytes(r["decoded"])) for r in byte_bpe.decoded(coded, path).collect()) == sorted((i or -1, (t or "").encode()) for i, t in texts)
    assert byte_bpe.with_digests(none, path).count() == 0


NAMES = "row stand n sha hash kept bucket fp__ id c0 c1 matches values found__ score label k1 k2 found anchor n_tokens ids_sha256 row__ stand__ n__ sha__ hash__ kept__ m__ r__ keep_id group first Row".split()


def test_other_columns_of_any_name(spark):
    """Columns named as the operators name their own survive as they came, and disturb nothing."""
    from pyspark.sql import functions as F

    rows = [(k, t) for k, t in enumerate([SENTENCE * 8, SENTENCE * 8, "a b " + SENTENCE * 8, "call +45 12 34 56 78", None, "", noise(200)])]
    plain_ = spark.createDataFrame(rows, "doc_id long, text string")
    case = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        docs = plain_.select("*", *(F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in NAMES)).repartition(2)
        bench, labels = spark.createDataFrame([(1, "call 45 12 34 56 78")], "item_id long, text string"), spark.createDataFrame([(1, 1, 0), (3, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
        kept = {
            "dedup": (exact_dedup.dedup, set()),
            "near": (simhash.one_of_each, set()),
            "clean": (lambda d: decontaminate.without_leaks(d, bench), set()),
            "good": (lambda d: quality.keep_good(d, labels), set()),
            "pseudonyms": (lambda d: pseudonyms.pseudonymize(d, "k"), {"found__"}),
            "bpe": (lambda d: byte_bpe.with_digests(d, path), {"n_tokens", "ids_sha256"}),
        }
        for what, (f, own) in kept.items():
            got, want = f(docs), sorted(r["doc_id"] for r in f(plain_).collect())
            assert [c for c in got.columns if c in docs.columns and c not in own] == [c for c in docs.columns if c not in own], what
            assert len(set(got.columns)) == len(got.columns)
            found = got.collect()
            assert sorted(r["doc_id"] for r in found) == want, what
            assert all(r[n] == f"{n}{r['doc_id']}" for r in found for n in NAMES if n not in own), what
        for f in (exact_dedup.groups_of_equal, simhash.near_copies, substring_dedup.without_repeats, suffix_dedup.without_repeats, licenses.scan, lambda d: quality.classify(d, labels), lambda d: decontaminate.find_leaks(d, bench)):
            assert sorted(map(str, f(docs).collect())) == sorted(map(str, f(plain_).collect()))
    finally:
        spark.conf.set("spark.sql.caseSensitive", case)


def test_pipeline_defined_cases(spark, tmp_path):
    """Nulls, empty and repeated rows, extra columns, no rows: each stage keeps columns and rows as its operator says."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    good = {f"d{k}": " ".join(rng.choice(SENTENCE.split()) for _ in range(40)) for k in range(6)}
    rows = [(k, t) for k, t in enumerate(good.values())] + [(10, good["d0"]), (0, good["d0"]), (11, None), (12, ""), (None, good["d1"]), (13, "leaked " + SENTENCE * 2)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.where("false").write.parquet(f"{tmp_path}/b/documents.parquet")
    for name in "ab":
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")  # every score is 0.5: all stay
        spark.createDataFrame([(1, SENTENCE.strip()), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        now = stage(spark, now, f"{tmp_path}/a")
        assert now.columns == docs.columns, name
    left = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in now.collect())
    # d0 stays as row 10, d1 as row 1 (null is smallest), one of the two empty texts as the larger id 12
    assert left == [1, 2, 3, 4, 5, 10, 12]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/a").select("doc_id").collect()) == left
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    accepted = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in accepted}
    last = {t: i for i, t in sorted(rows.items())}
    rows = {i: t for t, i in last.items()}
    fps, label = {i: fingerprint(t) for i, t in rows.items()}, {i: i for i in rows}
    for _ in range(5):
        for a in rows:
            for b in rows:
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
    left = {i for i in rows if label[i] == i}
    leaked = {r["doc_id"] for r in decontaminate.find_leaks(docs, bench).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == left - leaked
