"""The array code of the text operators, against plain Python."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracklore.llm import bpe, hnsw, jaccard, packing, quality_model, substring, toxicity
from tracklore.llm import textkernel as tk

TEXT = st.lists(st.text(alphabet="ab \n\tAé ß'", max_size=60), max_size=8)


def split_words(text):
    return text.encode().split()


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_words_and_windows(texts):
    data, offsets = tk.text_bytes(pa.array(texts, pa.string()))
    w = tk.words(data, offsets)
    got = [[bytes(data[a:b]) for a, b in zip(w.starts[x:y], w.ends[x:y])] for x, y in zip(w.of[:-1], w.of[1:])]
    assert got == [split_words(t) for t in texts]
    h, text, place = w.grams(3)
    seen = {}
    for x, k, p in zip(h.tolist(), text.tolist(), place.tolist()):
        gram = tuple(got[k][p : p + 3])
        assert seen.setdefault(x, gram) == gram
    assert len(seen) == len({tuple(g[i : i + 3]) for g in got for i in range(len(g) - 2)})


@settings(max_examples=60, deadline=None)
@given(TEXT)
def test_shingle_sets(texts):
    data, offsets = tk.text_bytes(pa.array(texts, pa.string()))
    text, h = jaccard.shingles(data, offsets, 2)
    lower = [[w.lower() for w in split_words(t)] for t in texts]
    want = [len({tuple(w[i : i + 2]) for i in range(len(w) - 1)} or ({tuple(w)} if w else set())) for w in lower]
    assert np.bincount(text, minlength=len(texts)).tolist() == want


def test_ids_are_those_of_the_tokenizer():
    rnd = random.Random(1)
    pieces = ["a", "the", "'s", "'ll", "'", " ", "  ", "\n", "\t", " ", "　", "é", "ß", "1", "²", "!", "中", "😀", "\x1c", "aaaa", "_"]
    texts = ["".join(rnd.choices(pieces, k=rnd.randint(0, 40))) for _ in range(3000)] + ["", "a" * 5000, " " * 300 + "x", "x \n", "<|endoftext|>"]
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    own = bpe.Encoder(bpe.load_ranks(P.path("byte_bpe_50k.json")))
    ids, off = own.encode(pa.array(texts))
    for text, a, b, e in zip(texts, off[:-1], off[1:], t.encode_batch(texts, add_special_tokens=False)):
        assert ids[a:b].tolist() == e.ids
        assert own.decode(ids[a:b]) == text.encode()
    assert bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")) == own.tokens


def test_rank_queue_gives_the_least_rank():
    rnd = random.Random(2)
    q, want = bpe.RankQueue(50_000), {}
    for k in range(400):
        r = rnd.randrange(50_000)
        q.push(r, np.array([k]))
        want.setdefault(r, []).append(k)
    got = []
    while (top := q.pop()) is not None:
        got.append((top[0], sorted(top[1].tolist())))
    assert got == sorted((r, sorted(v)) for r, v in want.items())


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_takes_the_tightest_open_bin(seed):
    rnd = random.Random(seed)
    lengths = sorted((rnd.randint(1, 64) for _ in range(400)), reverse=True)
    left, want = [], []
    for n in lengths:
        fits = [(room, b) for b, room in enumerate(left) if room >= n]
        if fits:
            least = min(fits)[0]
            want.append(least)
            left[next(b for room, b in fits if room == least)] -= n
        else:
            want.append(64)
            left.append(64 - n)
    got = packing.best_fit(lengths, 64)
    assert [64 - o for _, o in got] == want
    used = {}
    for (b, o), n in zip(got, lengths):
        assert o == used.get(b, 0)
        used[b] = o + n
    assert max(used.values()) <= 64 and len(used) == len(left)


def test_winnowed_grams_meet_in_equal_runs():
    rnd = random.Random(4)
    shared = [f"w{rnd.randrange(30)}" for _ in range(50)]
    for _ in range(20):
        texts = [" ".join([f"x{rnd.random()}" for _ in range(rnd.randint(0, 40))] + shared + [f"y{rnd.random()}" for _ in range(rnd.randint(0, 40))]) for _ in range(2)]
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2]), "text": pa.array(texts)})
        found = [set(), set()]
        for b in substring._marks(25, 50, 4)(iter([batch])):
            for h, d in zip(b.column("h").to_pylist(), b.column("doc").to_pylist()):
                for x, y in zip(np.frombuffer(h, np.uint64), np.frombuffer(d, np.int64)):
                    found[y - 1].add(int(x))
        assert found[0] & found[1]


def test_graph_finds_what_brute_force_finds():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(120, 24))
    v = np.concatenate([centres, centres[rng.integers(0, 120, 1500)] + rng.normal(scale=0.03, size=(1500, 24)), np.tile(centres[:1], (40, 1)) + rng.normal(scale=0.01, size=(40, 24))])
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    graph = hnsw.Graph.load(v, hnsw.Graph(v, np.arange(len(v))).dump())
    truth = v @ v.T >= 0.98
    np.fill_diagonal(truth, False)
    width, audit = graph.width_for(v, np.arange(len(v)), 0.98)
    assert audit[1] > 0 and audit[0] >= 0.98 * audit[1] and audit[2] >= 0.95 * audit[3] == 0.95 * 64
    x, y, crowd = graph.within(v, np.arange(len(v)), 0.98, width)
    assert truth[x, y][x != y].all()
    sparse = ~np.isin(np.arange(len(v)), crowd)
    assert (x != y).sum() >= 0.99 * truth[sparse].sum()


def test_audit_sees_a_graph_that_finds_nothing():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 16))
    v[1::2] = v[::2] + rng.normal(scale=0.01, size=(1500, 16))
    v = hnsw.unit(v.ravel(), 16).astype(np.float32)
    graph = hnsw.Graph(v, np.arange(len(v)))
    wide, audit = graph.width_for(v, np.arange(len(v)), 0.98)
    assert wide < len(v) and audit[1] >= 60
    graph.beam = lambda q, s, l, w, own=None: (np.full((len(q), w), -1, np.int32), np.full((len(q), w), -np.inf, np.float32))
    width, audit = graph.width_for(v, np.arange(len(v)), 0.98)
    assert width >= len(v)


def test_unit_vectors_of_extreme_components():
    v = hnsw.unit(np.array([1e300, 1e300, 1e-310, 1e-310, 3.0, 4.0]), 2)
    assert np.allclose(v, [[0.5**0.5] * 2, [0.5**0.5] * 2, [0.6, 0.8]])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=6), min_size=1, max_size=6), st.text(alphabet="abc", max_size=7), st.integers(0, 2))
def test_automaton_meets_the_trie_like_edit_distance(terms, word, edits):
    trie = toxicity.Trie(terms)
    assert trie.fuzzy([word, "zz"], np.array([edits, edits])).tolist() == [any(distance(t, x) <= edits for t in terms) for x in (word, "zz")]
    assert trie.exact(word) == any(word.startswith(t) for t in terms)


def test_context_tells_quotation_from_abuse():
    words = 'he said "moron" to them'.split()
    assert toxicity.context(words, 2, [0, 0, 1, 0, 0], frozenset(["said"]))[0]
    assert not toxicity.context("you moron you".split(), 1, [0, 1, 0], frozenset(["said"]))[0]


def test_isotonic_means():
    got = quality_model.isotonic(np.array([1.0, 3.0, 2.0, 4.0]), np.ones(4))
    assert got.tolist() == [1.0, 2.5, 2.5, 4.0]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab é!|\n", max_size=50), max_size=6))
def test_statistics_are_finite_and_of_each_text_alone(texts):
    data, offsets = tk.text_bytes(pa.array(texts, pa.string()))
    every = quality_model.statistics(data, offsets)
    assert np.isfinite(every).all()
    for k, t in enumerate(texts):
        d, o = tk.text_bytes(pa.array([t], pa.string()))
        assert np.allclose(quality_model.statistics(d, o)[0], every[k])


def test_digest_of_ids_is_little_endian():
    assert hashlib.sha256(np.array([1], "<u4").tobytes()).hexdigest() == hashlib.sha256(b"\x01\0\0\0").hexdigest()
