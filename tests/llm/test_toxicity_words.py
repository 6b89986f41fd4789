"""Words that the lexicon meets: misspelt starts of inflected words, parts of joined words, and words of any length."""

import numpy as np
import pytest

from tracklore.llm.toxicity import Matcher, Trie, edits_of

TERMS = ["moronic", "blitherin", "fool", "scum", "idiot"]


@pytest.mark.parametrize(
    ("word", "kind"),
    [("moronically", 1), ("moronixally", 2), ("mornoically", 0), ("morronically", 2), ("blithernilgness", 2), ("blothirinlesslyness", 2), ("blothironlesslyness", 0), ("blithering", 1), ("you-moronic", 1), ("such/morinic", 2), ("mor*nic", 2), ("fool" + "!" * 500, 1), ("!" * 300 + "moroniccc", 1),
     ("moronic" + "x" * 300, 1), ("moroniq" + "x" * 300, 2), ("\u00e9" * 250, 0), ("...", 0), ("scim", 0), ("scimitar", 0), ("pleasantness", 0), ("idi", 0)],
)
def test_kinds(word, kind):
    assert Matcher(TERMS).kinds_of([word, "plain"]).tolist() == [kind, 0]


def test_automaton_against_distances():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abc"), n)) for n in rng.integers(5, 16, 400)]
    terms = ["".join(rng.choice(list("abc"), n)) for n in rng.integers(5, 10, 6)]

    def rows(term, word):
        last = list(range(len(word) + 1))
        for i, c in enumerate(term, 1):
            now = [i]
            for j, x in enumerate(word, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (c != x)))
            last = now
        return last

    edits = edits_of(np.array([len(w) for w in words]))
    want = [any(rows(t, w)[-1] <= e or min(rows(t, w)) <= min(e, edits_of(len(t))) for t in terms) for w, e in zip(words, edits.tolist(), strict=True)]
    got = Trie(terms).fuzzy(words, edits, starts=True)
    assert got.tolist() == want and 0 < sum(want) < len(want)
