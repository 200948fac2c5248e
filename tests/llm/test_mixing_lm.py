"""The fit of the language model."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tidemark.llm import mixing_lm
from tidemark.llm.words import Hasher, Words, text_buffers


def test_fit_sees_all_training_documents(spark, monkeypatch):
    made, init = [], mixing_lm.Mixer.__init__
    monkeypatch.setattr(mixing_lm.Mixer, "__init__", lambda self: (init(self), made.append(self))[0])
    rows = [(i, "one") for i in range(1200)]
    learnt = sum(zlib.crc32(str(i).encode()) % 10 != 0 for i in range(1200))
    mixing_lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    # A word and the end of the document, the codes of which are one and two decisions long.
    assert made[0].seen.sum() == 3 * learnt and made[1].seen.sum() == 0


def counted(documents):
    """The words of documents, a vocabulary of the repeated ones, and the tables after all documents."""
    data, offsets = text_buffers(pa.array(documents))
    words = Words(Hasher(), data, offsets, 0, len(documents), True)
    t, n = np.unique(mixing_lm.tokens(words)[0], return_counts=True)
    vocab = mixing_lm.Vocabulary(t[n > 1], n[n > 1], int(n[n == 1].sum()))
    every = np.ones(len(documents), bool)
    tables = [np.zeros((n, 2), np.uint32) for n in [len(vocab.code.length), *mixing_lm.SIZES[1:]]]
    for k, _, _, bit, slots, _ in mixing_lm.decided(words, every, vocab)[3]:
        for j, s in enumerate(slots):
            np.add.at(tables[3 * k + j], (s, bit), 1)
    return words, vocab, tables


def test_own_counts_are_left_out(monkeypatch):
    words, vocab, tables = counted(["a b a c", "b a b a x1 x1 yy", "", "a b zz"] + ["q w"] * 300)
    known = [(np.where((t <= mixing_lm.MANY).all(axis=1), np.uint8(mixing_lm.FEW), mixing_lm.levels(mixing_lm.logs(t))), mixing_lm.few(t)) for t in tables]
    at = np.arange(1 << 16)
    level_of = mixing_lm.levels(mixing_lm.logs(np.stack([at & 255, at >> 8], 1)))
    for d in range(4):
        chosen = np.arange(len(words.first) - 1) == d
        got = [(k, *x, gate, bit) for k, x, gate, bit in mixing_lm.without_own(words, chosen, vocab, known, level_of)]
        own = [np.zeros_like(t) for t in tables]
        for k, _, _, bit, slots, _ in mixing_lm.decided(words, chosen, vocab)[3]:
            for j, s in enumerate(slots):
                np.add.at(own[3 * k + j], (s, bit), 1)
        wanted = []
        for k, _, _, bit, slots, gate in mixing_lm.decided(words, chosen, vocab)[3]:
            x = []
            for j, s in enumerate(slots):
                n, less = tables[3 * k + j][s], own[3 * k + j][s]
                x.append(mixing_lm.levels(mixing_lm.logs(np.where((n <= mixing_lm.MANY).all(axis=1)[:, None], n - less, n))))
            wanted.append((k, *x, gate, bit))
        assert len(got) == len(wanted) and all(np.array_equal(a, b) for g, w in zip(got, wanted) for a, b in zip(g, w))
    # One long document by tables gives what sorting gives.
    words, vocab, tables = counted(["a b a c yy a b"])
    known = [(np.full(len(t), mixing_lm.FEW, np.uint8), mixing_lm.few(t)) for t in tables]
    runs = []
    for longest in (1 << 30, 1):
        monkeypatch.setattr(mixing_lm, "LONG", longest)
        runs.append([(k, *x, gate, bit) for k, x, gate, bit in mixing_lm.without_own(words, np.ones(1, bool), vocab, known, level_of)])
    assert all(np.array_equal(a, b) for g, w in zip(*runs) for a, b in zip(g, w))


def test_words_beyond_the_vocabulary_count(spark, monkeypatch):
    """The vocabulary only chooses how words are coded: rare ones are spelt, and the base score counts them exactly."""
    monkeypatch.setattr(mixing_lm, "WORDS", 2)
    rows = [(i, f"aa bb cc w{i % 40} {'u%d' % i if i % 2 else ''}") for i in range(200)]
    words = {i: [*x.split(), None] for i, x in rows}
    learnt = {i for i in words if zlib.crc32(str(i).encode()) % 10}
    n = Counter(w for i in learnt for w in words[i])
    total = sum(n.values())
    for r in mixing_lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        base = sum(math.log10((n[w] + 0.1) / (total + 0.1 * (len(n) + 1))) for w in words[r.doc_id])
        assert abs(r.base_score - base) < 1e-6 and r.n_known == sum(n[w] > 0 for w in words[r.doc_id]) and r.train_tokens == total
        assert r.n_tokens == len(words[r.doc_id]) and -1000 < r.score < -0.1 * (r.n_tokens - 4)


def test_few_counts_are_sent_without_the_empty_slots():
    few = np.zeros(1000, np.uint32)
    few[[3, 999]] = 7, 200
    large, full, none = few.astype(np.int64) << 40, np.arange(1000), np.zeros(1000, np.uint32)
    for n, size in ((few, 6), (large, 20), (full, 2000), (none, 0)):
        at, counts = mixing_lm.sparse(n)
        total = np.ones(1000, np.int64)
        mixing_lm.add_sparse(total, at, counts)
        assert len(at or b"") + len(counts) == size and np.array_equal(total, n.astype(np.int64) + 1)


def test_decisions_go_depth_by_depth(monkeypatch):
    """All decisions of one depth are worked on together, with one gate for all; sums are those of one token after the other."""
    words, vocab, tables = counted(["a b a c", "b a b a x1 x1 yy", "", "a b zz"] + ["q w"] * 30)
    t, d, symbols, _ = mixing_lm.decided(words, np.ones(34, bool), vocab)
    asked = np.concatenate([t, np.array([0, 1 << 63, (1 << 64) - 1], np.uint64)])
    at = np.searchsorted(vocab.hash, asked).clip(max=len(vocab.hash) - 1)
    assert np.array_equal(vocab.symbols(asked), np.where(vocab.hash[at] == asked, at, len(vocab.hash)))
    every = [(words, np.arange(34) % 2 == 0), (words, np.arange(34) % 2 == 1)]
    assert all(np.array_equal(a, b.ravel()) for a, b in zip(mixing_lm.counted_decisions(every, vocab), tables))
    # Codes, read off one token at a time.
    code, found = vocab.code, Counter()
    for s in symbols:
        for i in range(code.length[s]):
            found[divmod(int(code.steps[code.start[s] + i]), 2)] += 1
    assert all(n == tables[0][node, bit] for (node, bit), n in found.items()) and sum(found.values()) == tables[0].sum()
    odds = [mixing_lm.logs(x) for x in tables]
    mixers = [mixing_lm.Mixer(), mixing_lm.Mixer()]
    rng = np.random.default_rng(1)
    for m in mixers:
        m.weights += rng.normal(0, 0.3, m.weights.shape).astype(np.float32)
    log10s = [m.log10s() for m in mixers]
    wanted = np.zeros(34)
    for k, doc, depth, bit, slots, gate in mixing_lm.decided(words, np.ones(34, bool), vocab)[3]:
        assert np.ndim(gate) == 0 and gate == (depth if k else min(depth // 2, mixing_lm.DEPTHS - 1)) and len(doc) == len(bit)
        x = [odds[3 * k + j][s] for j, s in enumerate(slots)]
        gates = mixers[k].gates(np.full(len(doc), gate), x)
        cell = np.rint((mixers[k].odds(x, gates) + 12) * mixing_lm.FINE).astype(int)
        np.add.at(wanted, doc, log10s[k][gates, cell, bit])
    for piece in (3, 16_000):
        monkeypatch.setattr(mixing_lm, "PIECE", piece)
        got = mixing_lm.summed_scores(mixing_lm.decided(words, np.ones(34, bool), vocab)[3], odds, mixers, [x.ravel() for x in log10s], 34)
        assert np.allclose(got, wanted, rtol=1e-12) and (got < 0).all()


def test_equal_spelt_bytes_are_worked_on_once(monkeypatch):
    """Copies of a spelt word cost no more slots; counts, levels and scores are those of all bytes one by one."""
    worked, slot = [], mixing_lm.slot
    monkeypatch.setattr(mixing_lm, "slot", lambda context, place: (worked.append(len(context)), slot(context, place))[1])
    data, offsets = text_buffers(pa.array(["abcdefghijkl"] * 40))
    words = Words(Hasher(), data, offsets, 0, 40, True)
    every = np.ones(40, bool)
    vocab = mixing_lm.Vocabulary(np.array([mixing_lm.END]), np.array([40]), 40)
    tables = mixing_lm.counted_decisions([(words, every)], vocab)
    assert sum(worked) < 40 * 30 and [int(t.sum()) for t in tables[3:]] == [40 * 13 * 8] * 3
    # Documents with equal and other spelt words, in groups of any size.
    words, vocab, tables = counted(["a b x1 x1 yy", "x1y a x1 b", "", "yy a zzzzzz zzz b", "b été a"] + ["q w"] * 30)
    every = np.ones(len(words.first) - 1, bool)
    odds = [mixing_lm.logs(x) for x in tables]
    mixers = [mixing_lm.Mixer(), mixing_lm.Mixer()]
    log10s = [m.log10s().ravel().astype(np.float64) for m in mixers]
    at = np.arange(1 << 16)
    level_of = mixing_lm.levels(mixing_lm.logs(np.stack([at & 255, at >> 8], 1)))
    wanted = mixing_lm.summed_scores(mixing_lm.decided(words, every, vocab)[3], odds, mixers, log10s, len(every))
    for many in (0, 2, mixing_lm.MANY):  # up to 0: no slot is without its own counts
        known = [(np.where((t <= many).all(axis=1), np.uint8(mixing_lm.FEW), mixing_lm.levels(mixing_lm.logs(t))), mixing_lm.few(t)) for t in tables]
        cells = np.zeros((2, mixing_lm.DEPTHS, mixing_lm.WIDE ** 3 * 2), np.int64)
        for k, x, gate, bit in mixing_lm.without_own(words, every, vocab, known, level_of):
            np.add.at(cells[k, gate], np.ravel_multi_index((*x, bit), (*[mixing_lm.WIDE] * 3, 2)), 1)
        for size, piece in ((1, 16_000), (1 << 20, 16_000), (1 << 20, 3)):
            monkeypatch.setattr(mixing_lm, "SPELT", size)
            monkeypatch.setattr(mixing_lm, "PIECE", piece)
            assert np.array_equal(mixing_lm.counted_levels([(words, every)] * 2, vocab, known, level_of), 2 * cells.reshape(2, -1))
            assert all(np.array_equal(a, b.ravel()) for a, b in zip(mixing_lm.counted_decisions([(words, every)], vocab), tables))
    # A long document is not gathered with the others.
    alone = counted(["a b x1 x1 yy x1y"])[0]
    runs = []
    for longest in (1 << 30, 1):
        monkeypatch.setattr(mixing_lm, "LONG", longest)
        runs.append(mixing_lm.counted_levels([(words, every), (alone, np.ones(1, bool)), (words, every)], vocab, known, level_of))
    assert np.array_equal(*runs) and runs[0][1].sum() > 2 * cells[1].sum()
    _, _, _, coded, spelt = mixing_lm.read(words, every, vocab)
    got = mixing_lm.summed_scores(coded, odds, mixers, log10s, len(every))
    for owner, byte in spelt:
        got += np.bincount(owner, weights=mixing_lm.spelt_scores(byte, odds[3:], mixers[1], log10s[1]), minlength=len(every))
    assert np.allclose(got, wanted, rtol=1e-12)


def test_scores_do_not_depend_on_how_many_bytes_are_gathered(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"one two w{i % 7} q{i}x{i % 3}" if i % 11 else None) for i in range(120)], "doc_id long, text string").coalesce(1)
    runs = []
    for size in (8, 1 << 20):
        monkeypatch.setattr(mixing_lm, "SPELT", size)
        monkeypatch.setattr(mixing_lm, "WORDS", 2)
        runs.append({r.doc_id: r.score for r in mixing_lm.score(rows).collect()})
    assert len(runs[0]) == 120 and all(abs(x - runs[1][i]) < 1e-9 for i, x in runs[0].items())
