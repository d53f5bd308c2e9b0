"""Operator 10 without Spark: the replay beside plain merging, and how its work grows."""

import hashlib
import itertools
import random
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa

from pairscope.llm import byte_bpe


def plain_merges(word, ranks):
    parts = [bytes([b]) for b in word]
    while found := [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


def test_byte_bpe_applies_a_merge_to_all_its_positions_at_once():
    """Finding: 1018 CPU seconds a GB. The lines that Python runs grow with the different merges, not with the words."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coder = byte_bpe.MergeReplay(ranks)
    syllables = [b"an", b"er", b"sch", b"ion", b"the", "né".encode(), b"ing", b"oua", b"st", b"ble"]
    words = [b" " + b"".join(w) for n in (2, 3, 4) for w in itertools.product(syllables, repeat=n)]

    def lines(some):
        ran, former = [0], sys.gettrace()

        def trace(frame, event, _):
            ran[0] += event == "line"
            return trace

        sys.settrace(trace)
        try:
            coder.replay(some)
        finally:
            sys.settrace(former)
        return ran[0]

    few, all_ = lines(words[::10]), lines(words)  # 1,110 and 11,100 words
    assert all_ < 3 * few and all_ < 5 * len(words)
    flat, sizes = coder.replay(words)
    want = [plain_merges(w, ranks) for w in words]
    assert flat.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


def test_byte_bpe_of_any_order_of_ranks():
    """Vocabularies that are no lists of merges: a merge may make a pair of lower rank than its own, pairs may overlap."""
    made_of = random.Random(5)
    for trial in range(60):
        letters = b"ab" if trial % 2 else b"abcd"
        made = {bytes(made_of.choice(letters) for _ in range(made_of.randint(2, 6))) for _ in range(made_of.randint(1, 50))}
        every = [bytes([b]) for b in range(256)] + sorted(made)
        made_of.shuffle(every)
        ranks = {b: i for i, b in enumerate(every)}
        words = list({bytes(made_of.choice(letters) for _ in range(made_of.randint(1, 30))) for _ in range(100)})
        flat, sizes = byte_bpe.MergeReplay(ranks).replay(words)
        want = [plain_merges(w, ranks) for w in words]
        assert flat.tolist() == sum(want, []) and sizes.tolist() == list(map(len, want))


def test_byte_bpe_digests_of_texts_longer_than_a_step(monkeypatch):
    pieces, ids = byte_bpe.Pieces([b"%d," % i for i in range(300)]), np.random.default_rng(4).integers(0, 300, 50)
    ends = np.array([0, 0, 1, 7, 7, 30, 50, 50])
    want = [hashlib.sha256(",".join(map(str, ids[a:b])).encode()).hexdigest() for a, b in zip(ends, ends[1:])]
    for step in (1, 3, 7, 1000):
        monkeypatch.setattr(byte_bpe, "STEP", step)
        assert pieces.digests(ids, ends, left_out=1) == want
    assert byte_bpe.Pieces([b"a"]).digests(np.zeros(0, np.int64), np.zeros(3, np.int64)) == [hashlib.sha256().hexdigest()] * 2


def test_byte_bpe_new_words_wait_for_a_bounded_number(monkeypatch):
    coder = byte_bpe.MergeReplay({bytes([b]): b for b in range(256)})
    texts = pa.array([f"w{k} " * 3 if k < 20 else "w1 w2 " * 3 for k in range(40)])
    monkeypatch.setattr(byte_bpe, "BLOCK", 40)
    monkeypatch.setattr(byte_bpe, "NEW", 5)
    waited, learn = [], coder.learn
    monkeypatch.setattr(coder, "learn", lambda: (waited.append(coder.unlearnt()), learn()))
    rows = [(lo, hi, len(bounds) - 1) for read in byte_bpe.pooled(coder, texts) for lo, hi, _, bounds in read]
    assert max(waited) < 20 and len(waited) < len(rows) and rows[-1][1] == 40 and all(hi - lo == n for lo, hi, n in rows)
