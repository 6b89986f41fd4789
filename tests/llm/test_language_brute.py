"""Fused language evidence against plain Python on a small table: texts, declared languages, suffixes and hosts, with gaps."""

import collections
import math
import random

import numpy as np

from tracklore.llm import language as L
from tracklore.llm.language import language_id

EN = "the and of to in that was with for his she her not but had at on they from this have were which you one all their there been".split()
DE = "der die und das von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei".split()
FR = "le de un et est pas que dans ce il qui ne sur se plus par je avec tout faire son mettre autre on mais nous comme ou si leur".split()


def cells(text):
    low = [c + 32 if 65 <= c <= 90 else c for c in text.encode()]
    low = [32, 32] + [c if c >= 128 or 97 <= c <= 122 else 32 for c in low]
    for x, y, z in zip(low, low[1:], low[2:]):
        if (x, y, z) != (32, 32, 32):
            yield ((z | y << 8 | x << 16) * 0x9E3779B1 & 0xFFFFFFFF) >> 18


def softmax(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def brute(rows, labelled):
    names = sorted({x for x, t in labelled if x and t is not None})
    counts = {x: collections.Counter(c for y, t in labelled if y == x and t for c in cells(t)) for x in names}
    of = {x: sum(c.values()) + 0.5 * L.CELLS for x, c in counts.items()}
    seen = []
    for id_, text, declared, host, suffix in rows:
        own = list(cells(text or ""))
        lik = [sum(float(np.float32(math.log((counts[x][c] + 0.5) / of[x]))) for c in own) for x in names]
        seen.append((id_, len(own), lik, softmax([v * L.TEMPER for v in lik]), *((v or "").lower() for v in (declared, host, suffix))))
    k = range(len(names))
    total = lambda rows: [sum(r[3][i] for r in rows) for i in k]
    every = [x + 1 for x in total(seen)]
    every = [x / sum(every) for x in every]

    def loglik(value, at):
        values = {r[at] for r in seen if r[at]}
        if not value:
            return [0.0] * len(names)
        sums = {v: total([r for r in seen if r[at] == v]) for v in values}
        return [math.log((sums[value][i] + L.FLAT) / (sum(s[i] for s in sums.values()) + L.FLAT * (len(values) + 1))) for i in k]

    out = []
    for id_, n, lik, post, declared, host, suffix in seen:
        near = total([r for r in seen if r[6] == suffix])
        parent = [(near[i] + L.SUFFIX * every[i]) / (sum(near) + L.SUFFIX) for i in k]
        mine = total([r for r in seen if r[5] == host and r[6] == suffix])
        prior = [math.log(max(mine[i] - post[i], 0.0) + L.HOST * parent[i]) for i in k]
        fused = softmax([lik[i] * L.TEMPER + prior[i] + a + b for i, a, b in zip(k, loglik(declared, 4), loglik(suffix, 6))])
        best, text = max(k, key=lambda i: fused[i]), max(k, key=lambda i: lik[i])
        accepted = n > 0 and lik[text] > n * -math.log(L.CELLS) and fused[best] >= L.CERTAIN and best == text
        out.append((id_, names[best], fused[best], names[text] if n else None, accepted))
    return out


def test_brute_force(spark):
    rng = random.Random(1)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    labelled = [(x, say(w, 60)) for x, w in (("en", EN), ("de", DE), ("fr", FR)) for _ in range(8)] + [(None, "x y"), ("de", None)]
    rows = []
    for k in range(90):
        words = rng.choice([EN, DE, FR])
        rows.append((k, say(words, rng.choice([1, 2, 30])), rng.choice(["en", "de", "FR", None, "xx", ""]), rng.choice(["a.com", "b.de", "c.fr", None]), rng.choice(["com", "de", None])))
    rows += [(90, None, "de", "b.de", "de"), (91, "", None, None, None), (92, " 12 .. ", "en", "a.com", "com"), (93, "qzx" * 40, "en", "a.com", "com"), (94, "The" + " the" * 60_000, None, "a.com", "com")]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string")
    got = {r.id: r for r in language_id(df, spark.createDataFrame(labelled, "lang string, text string")).collect()}
    want = brute(rows, labelled)
    assert len(got) == len(rows) and 40 < sum(w[4] for w in want) < len(rows) - 5
    for id_, lang, probability, text_lang, accepted in want:
        r = got[id_]
        assert abs(r.probability - probability) < 1e-6 and r.text_lang == text_lang
        assert r.lang == lang or probability < 0.5 + 1e-6
        assert r.accepted == accepted or abs(probability - L.CERTAIN) < 1e-6


def test_many_languages_and_values(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = lambda k: " ".join(letters[(k * 7 + j * (k // 26 + 1)) % 26] * 2 + letters[k % 26] + letters[k // 26] for j in range(40))
    labelled = [(f"l{k}", own(k)) for k in range(101)]
    rows = [(k, own(k), f"l{k}", f"h{k}", f"s{k}") for k in range(101)] + [(1000 + k, own(k % 101), f"d{k}", "h", f"s{k}") for k in range(600)]
    df = spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string")
    got = {r.id: r for r in language_id(df, spark.createDataFrame(labelled, "lang string, text string")).collect()}
    assert all(got[k].text_lang == f"l{k}" for k in range(101)) and len(got) == 701
