"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, and scores that tell quotation from abuse."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklore.llm import textkernel as tk
from tracklore.llm.common import cut, empty_safe

#: Labelled rows that the lexicon and the weights are learnt from, at most, in order of their hash.
FIT_ROWS = 20_000
#: Lengths of the stems tried as terms; a term needs so many toxic documents and this share of all it is in.
STEMS, SUPPORT, PRECISION = range(3, 10), 8, 0.85
#: Words on either side that make up a context, and the share of harmless texts among those where a word of a context reports.
WINDOW, REPORTS = 6, 0.9
QUOTES = frozenset("\"'“”„«»‘’`")
FEATURES = ["exact", "fuzzy", "quoted", "dense", "any_exact", "any_fuzzy"]


#: What stands between words, as where the terms are learnt.
BETWEEN = regex.compile(r"[^\p{L}\p{N}]+")


def edits_of(size):
    """Edits that a word or term of so many characters may have."""
    return np.where(size < 5, 0, np.where(size < 9, 1, 2))


class Trie:
    """Terms by character; a term ends at a node, and what follows it in a word is an ending."""

    def __init__(self, terms: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.end: list[bool] = [False]
        for term in terms:
            node = 0
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.end.append(False)
                node = self.next[node][c]
            self.end[node] = True
        longest = max(map(len, terms), default=1)
        #: Characters of a word that its automaton holds: those of the longest term and more than two edits; later ones are its ending.
        self.width = longest + 5
        if self.width > 62:
            raise ValueError(f"terms of {longest} characters don't fit an automaton")

    def exact(self, word: str) -> bool:
        """Whether a term starts the word."""
        node = 0
        for c in word:
            node = self.next[node].get(c, -1)
            if node < 0:
                return False
            if self.end[node]:
                return True
        return False

    def fuzzy(self, words: list[str], edits: np.ndarray, starts: bool = False) -> np.ndarray:
        """Whether a term is within edits of each whole word, or if starts within those, and the term's own, of a start of
        the word: all words' automata walk the trie at once.

        A word's automaton holds one integer for each number of edits: bit k of the d-th stands for the word's first k
        characters met with d edits. A word leaves a branch where no state is left.
        """
        n = len(words)
        width = self.width
        letters = np.array(words, f"U{width}").view(np.uint32).reshape(n, width)
        size = np.array([min(len(w), width) for w in words], np.uint64)
        one = np.uint64(1)
        full, goal = (np.uint64(2) << size) - one, one << size
        bit = one << np.arange(width, dtype=np.uint64)
        places = {c: ((letters == ord(c)) * bit).sum(1, dtype=np.uint64) for c in {c for node in self.next for c in node}}
        out = np.zeros(n, bool)
        for e in np.unique(edits).tolist():
            rows = np.flatnonzero(edits == e)
            todo = [(0, 1, rows, [np.full(len(rows), (2 << d) - 1, np.uint64) & full[rows] for d in range(e + 1)])]
            while todo:
                node, depth, rows, states = todo.pop()
                for c, child in self.next[node].items():
                    here, below, under, new = places[c][rows], np.uint64(0), np.uint64(0), []
                    for s in states:
                        under = ((s & here) << one | below | below << one | under << one) & full[rows]
                        new.append(under)
                        below = s
                    if self.end[child]:
                        out[rows[(under & goal[rows]) != 0]] = True
                        if starts:
                            out[rows[new[min(e, int(edits_of(depth)))] != 0]] = True
                    live = (under != 0) & ~out[rows]
                    if live.any() and self.next[child]:
                        todo.append((child, depth + 1, rows[live], [x[live] for x in new]))
        return out


def core(word: str) -> str:
    """A word in lower case without what stands around its letters and digits."""
    word = word.lower()
    if word.isalnum():
        return word
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


def parts(word: str) -> list[str]:
    """What is met with the terms: the core of a word and, where it is more than letters and digits, its parts as learnt."""
    own = core(word)
    return [own] if own.isalnum() or not own else [own, *filter(None, BETWEEN.split(own))]


class Matcher:
    """The lexicon, and what this worker knows of the words it has met: 0 no term, 1 a term, 2 a misspelt one."""

    def __init__(self, terms: list[str]):
        self.trie = Trie(terms)
        self.shortest = min(map(len, terms), default=1 << 30)
        self.hashes, self.kinds = np.zeros(0, np.uint64), np.zeros(0, np.uint8)

    def kinds_of(self, words: list[str]) -> np.ndarray:
        pieces = [parts(w) for w in words]
        of = np.repeat(np.arange(len(words)), [len(x) for x in pieces])
        pieces = [x for own in pieces for x in own]
        size = np.array([len(x) for x in pieces], int)
        found = np.array([len(x) >= 3 and self.trie.exact(x) for x in pieces], np.uint8)
        edits = edits_of(size)
        near = np.flatnonzero((found == 0) & (edits > 0) & (size + edits >= self.shortest))
        if len(near):
            found[near[self.trie.fuzzy([pieces[k][: self.trie.width] for k in near.tolist()], edits[near], starts=True)]] = 2
        out = np.zeros(len(words), np.uint8)
        out[of[found == 2]] = 2
        out[of[found == 1]] = 1
        return out

    def of(self, w: tk.Words) -> np.ndarray:
        """The kind of each word; each distinct word is matched once."""
        h, first, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, h)
        old = np.zeros(len(h), bool)
        if len(self.hashes):
            at = np.minimum(at, len(self.hashes) - 1)
            old = self.hashes[at] == h
        found = np.zeros(len(h), np.uint8)
        found[old] = self.kinds[at[old]]
        new = np.flatnonzero(~old)
        if len(new):
            raw = w.data.tobytes()
            spans = zip(w.starts[first[new]].tolist(), w.ends[first[new]].tolist(), strict=True)
            found[new] = self.kinds_of([raw[a:b].decode("utf-8", "replace") for a, b in spans])
            keys = np.concatenate((self.hashes, h[new])) if len(self.hashes) < 2_000_000 else h[new]
            kinds = np.concatenate((self.kinds, found[new])) if len(self.hashes) < 2_000_000 else found[new]
            order = np.argsort(keys, kind="stable")
            self.hashes, self.kinds = keys[order], kinds[order]
        return found[which]


def context(words: list[str], k: int, kinds: list[int], reporting: frozenset[str]) -> tuple[bool, int]:
    """Of the term at place k: whether its window quotes it, and how many other terms the window holds."""
    a, b = max(0, k - WINDOW), k + WINDOW + 1
    around = words[a:b]
    marked = words[k][0] in QUOTES and words[k].rstrip(".,;:!?")[-1:] in QUOTES
    opened = any(w[0] in QUOTES for w in words[a : k + 1]) and any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in words[k:b])
    reported = any(core(w) in reporting for w in around)
    return marked or opened and reported, sum(1 for x in kinds[a:b] if x) - 1


def _contexts(terms: list[str]):
    """(word, toxic) of each word that stands in the context of a term, once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in empty_safe(batches):
            toxic = batch.column("toxic").to_pylist()
            found, said = [], []
            for a, _, data, offsets in tk.slices(batch.column("text"), 1 << 19):
                w = tk.words(data, offsets)
                hits = np.flatnonzero(matcher.of(w))
                raw = data.tobytes()
                for text in np.unique(np.searchsorted(w.of, hits, "right") - 1).tolist():
                    lo, hi = int(w.of[text]), int(w.of[text + 1])
                    own = hits[(hits >= lo) & (hits < hi)]
                    near = np.unique(np.clip(own[:, None] + np.arange(-WINDOW, WINDOW + 1), lo, hi - 1))
                    words = {core(raw[w.starts[k] : w.ends[k]].decode("utf-8", "replace")) for k in np.setdiff1d(near, own).tolist()} - {""}
                    found += words
                    said += [toxic[a + text]] * len(words)
            yield pa.RecordBatch.from_pydict({"word": pa.array(found, pa.string()), "toxic": pa.array(said, pa.int32())})

    return run


def learn_reporting(labelled: DataFrame, terms: list[str]) -> frozenset[str]:
    """Words that report speech: those in contexts of terms that stand nearly only in harmless texts, in any language."""
    near = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_contexts(terms), "word string, toxic int")
    near = near.groupBy("word").agg(F.sum(1 - F.col("toxic")).alias("good"), F.count("*").alias("n"))
    return frozenset(r["word"] for r in near.where((F.col("good") >= SUPPORT) & (F.col("good") >= REPORTS * F.col("n"))).collect())


def _features(terms: list[str], reporting: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in empty_safe(batches):
            rows = []
            for a, b, data, offsets in tk.slices(batch.column("text"), 1 << 19):
                w = tk.words(data, offsets)
                kinds = matcher.of(w)
                out = np.zeros((b - a, len(FEATURES)))
                hits = np.flatnonzero(kinds)
                raw = data.tobytes()
                for text in np.unique(np.searchsorted(w.of, hits, "right") - 1).tolist():
                    lo, hi = int(w.of[text]), int(w.of[text + 1])
                    own = kinds[lo:hi].tolist()
                    tokens = [raw[x:y].decode("utf-8", "replace") for x, y in zip(w.starts[lo:hi].tolist(), w.ends[lo:hi].tolist(), strict=True)]
                    for k in np.flatnonzero(kinds[lo:hi]).tolist():
                        quoted, near = context(tokens, k, own, reporting)
                        out[text, 2 if quoted else own[k] - 1] += 1
                        out[text, 3] += not quoted and near > 0
                out[:, 4], out[:, 5] = out[:, 0] > 0, out[:, 1] > 0
                out[:, :4] = np.log1p(out[:, :4])
                rows.append(out)
            flat = np.concatenate(rows)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "features": pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), flat.shape[1]).cast(pa.list_(pa.float64()))})

    return run


def learn_terms(labelled: DataFrame) -> list[str]:
    """Terms that mark toxic texts among labelled rows (text, toxic): the shortest stems that are precise enough,
    each made as long as nearly all of its documents allow.

    Counts of documents by stem are grouped by Spark; what reaches the driver is bounded by the labelled rows and SUPPORT.
    """
    word = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word")
    words = labelled.select("toxic", word).where(F.length("word") >= 3).groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    stems = words.select(F.explode(F.array_distinct(F.array(*[F.substring("word", 1, n) for n in STEMS]))).alias("stem"), "bad", "good")
    stems = stems.groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    base = labelled.agg(F.avg("toxic")).first()[0] or 0.0
    least = max(PRECISION, min(0.98, 3 * base))
    found = stems.where((F.col("bad") >= SUPPORT) & (F.col("bad") >= least * (F.col("bad") + F.col("good")))).collect()
    terms: list[str] = []
    for r in sorted(found, key=lambda r: (len(r["stem"]), -r["bad"], r["stem"])):
        if not any(r["stem"].startswith(t) for t in terms):
            terms.append(r["stem"])
    support = {r["stem"]: r["bad"] for r in found}
    terms = [max((s for s in support if s.startswith(t) and support[s] >= 0.95 * support[t]), key=len) for t in terms]
    return sorted(set(terms))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the constant last, by Newton steps on a few features."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, held_out_of: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted, features) of each row of docs (doc_id, text); labels are (doc_id, toxic).

    Rows whose crc32(doc_id as text) mod held_out_of is held_out are never learnt from. The lexicon comes from stems of
    words in at most FIT_ROWS labelled rows, one a doc_id (of several texts the least), and so do the words that report speech. Every word of every whole text is met with it: a word that a term starts is
    a hit, one within an automaton's few edits of a term, or starting so, a misspelt hit; parts of a word between other
    characters than letters and digits are met too, and no word is too long; a window of WINDOW words on either side tells quoted
    hits from abuse. A logistic model on the counts gives the score. Null and empty texts have no hits and are scored
    so; a null doc_id is not held out and stays null; rows that repeat get equal results; null labels are not learnt
    from, and of a doc_id labelled again the greater label counts, once; with no labels of both kinds the score is the share of toxic ones, or 0. Other columns are ignored.
    """
    key = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(held_out_of)) == held_out
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~key)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    labelled = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    labelled = cut(labelled)
    terms = learn_terms(labelled)
    reporting = learn_reporting(labelled, terms)
    schema = "doc_id long, features array<double>"
    fit = labelled.select("doc_id", "text").mapInArrow(_features(terms, reporting), schema).select("doc_id", F.col("features").alias("x"))  # FIT_ROWS rows at most
    fit = fit.join(F.broadcast(known), "doc_id").select("x", "toxic").toPandas()
    y = fit["toxic"].to_numpy(float)
    if len(set(y)) == 2:
        w = fit_logistic(np.stack(fit["x"]), y)
    else:
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6) if len(y) else 1e-6
        w = np.append(np.zeros(len(FEATURES)), np.log(share / (1 - share)))
    margin = F.lit(float(w[-1]))
    for k in range(len(FEATURES)):
        margin = margin + F.lit(float(w[k])) * F.col("features")[k]
    out = docs.mapInArrow(_features(terms, reporting), schema).withColumn("score", 1 / (1 + F.exp(-margin)))
    return out.select("doc_id", F.coalesce(key, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "features")
