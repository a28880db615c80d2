"""Driver memory of the quality classifier, expressions of the toxicity voters."""

import random
import re
import tracemalloc

import pytest

pytest.importorskip("trackwise.llm")
from trackwise.llm import quality, toxicity  # noqa: E402


def test_quality_keeps_no_tokens():
    """A sample of many tokens but few words is held as numbers: the words themselves would take more than 40 MB."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(("alpha", "bravo", "charlie", "delta")) + str(rng.randrange(50)) for _ in range(20_000)) for _ in range(40)]
    tracemalloc.start()
    quality.fit_model(texts, [n % 2 for n in range(40)], 20, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000


PLAIN = [re.compile(r"\b[A-ZÄÖÜÉÈÀÑ]{4,}\b"), re.compile(r"[!?]{2,}"), re.compile(r"([^\W\d_])\1\1\1")]


class _Counted:
    """An expression that counts the characters it looks through."""

    def __init__(self, of):
        self.of, self.chars = of, 0

    def search(self, text):
        self.chars += len(text)
        return self.of.search(text)

    def findall(self, text):
        self.chars += len(text)
        return self.of.findall(text)


def test_toxicity_patterns_are_the_plain_ones():
    rng = random.Random(6)
    voters = toxicity.Voters({})
    for _ in range(20_000):
        text = "".join(rng.choice("aAbBÄäİΣσς!?_1 .éÉ'-ǅ") * rng.choice((1, 1, 2, 4, 5)) for _ in range(rng.randint(0, 8)))
        plain = [len(e.findall(text)) for e in PLAIN]
        assert toxicity.patterns(text, toxicity.words_of(text))[:3] == plain
        mask = voters.mask(text, {})
        assert [mask >> (len(toxicity.LEXICONS) + toxicity.MINED + i) & 1 for i in range(3)] == [int(n > 0) for n in plain]


def test_toxicity_looks_for_drawn_out_letters_in_words(monkeypatch):
    """Repeated letters are looked for once in each word, in the text only if a word has them."""
    counted = _Counted(toxicity.LONG)
    monkeypatch.setattr(toxicity, "LONG", counted)
    text = "one two three " * 1000
    model = toxicity.ToxicityModel({"=one": 1.0}, toxicity.np.zeros(4), 0.0, toxicity.Voters({}), None)
    model.voters.mask(text, {})
    model.score(text, {})
    assert counted.chars < 100
    assert model.voters.mask("sooo NOOO looong", {}) >> 14 & 1 == 0 and model.voters.mask("one looooong", {}) >> 14 & 1 == 1
