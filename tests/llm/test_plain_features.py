"""Features and statistics against plain loops over characters and words."""

import math
import random
import unicodedata
from collections import Counter

import pytest

from barline.llm import quality, toxicity

PIECES = ["you", "You", "idiot", "IDIOT!", "st*pid", "1d1ot", "tú", "der", "Haus", "École", "ÉTÉ", "naïve", "x", "the", "and", "42",
          "a1b", "stup1d", "l0ser", "?", "!!", "#$%", "|", "\n", "\n\n", "\t", " ", "  ", "日本", "ß", "×", "Þing", "_", "per-son", " ", "\r\n",
          "trash", "your", "clown,", "(fool)", "😀", "\x00", "\x0b", "hello", "world."]


def texts(n=400):
    rng = random.Random(11)
    yield from ("", " ", "\n", "you", "idiot", "é", "É" * 50, "you " * 30 + "idiot", "\x85a b")
    for _ in range(n):
        yield rng.choice(("", " ", " ", "\n")).join(rng.choice(PIECES) for _ in range(rng.randrange(1, 60)))


def letter(c):
    """What a word of the feature set is made of: word characters but digits and the underscore."""
    return (c.isalnum()) and not unicodedata.category(c) == "Nd"


def letter_runs(text):
    out, run = [], ""
    for c in text + " ":
        if letter(c):
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def test_toxicity_features_equal_plain_loops():
    fixed, second = frozenset(toxicity.INSULTS), frozenset(toxicity.SECOND_PERSON)
    lexicon = {"haus": 1.5, "hello": 2.25, "idiot": 3.0}
    for text in texts():
        got = toxicity.features(text, lexicon, fixed, second)
        words = letter_runs(text.lower())
        n, size = max(1, len(words)), max(1, len(text.encode()))
        hits = [i for i, w in enumerate(words) if w in lexicon or w in fixed]
        odds = [lexicon.get(words[i], 0.0) for i in hits]
        near = sum(any(abs(i - j) <= toxicity.NEAR and w in second for j, w in enumerate(words)) for i in hits)
        want = [len(hits) / n, math.log1p(len(hits)), sum(words[i] in fixed for i in hits) / n, sum(odds) / n, sum(odds),
                max(odds, default=0.0), len({words[i] for i in hits}), near / n, near]
        assert got[:9] == pytest.approx(want, abs=1e-12), text
        assert got[11:13] == pytest.approx([math.log1p(len(words)), len(text.encode()) / n], abs=1e-12)
        capitals = sum("A" <= c <= "Z" or ("À" <= c <= "Þ" and c != "×") for c in text)
        kinds = [capitals, sum("0" <= c <= "9" for c in text), text.count("!"), text.count("?"),
                 sum(c in "\"#$%&'()*+,-./:;<=>@[\\]^_`{|}~" for c in text), sum(c in " \t\r\n" for c in text)]
        assert got[13:] == pytest.approx([k / size for k in kinds], abs=1e-12), text


def test_masked_words_are_found_and_uncovered():
    fixed, second = frozenset(toxicity.INSULTS), frozenset(toxicity.SECOND_PERSON)
    for text, masked, uncovered in (("st1pid", 1, 0), ("stup1d", 1, 1), ("an id1ot and tr@sh", 2, 2), ("l0ser", 1, 1),
                                    ("a1 1a 42", 0, 0), ("", 0, 0), ("cl*own", 1, 1), ("B2B", 1, 0)):
        got = toxicity.features(text, {}, fixed, second)
        words = max(1, len(letter_runs(text.lower())))
        assert (got[9], got[10]) == (masked / words, uncovered), text


def test_quality_statistics_equal_plain_loops():
    for text in texts():
        got = quality.statistics(text)
        data = list(text.encode())
        size = max(1, len(data))
        classes = [sum(bytes([b]) in [bytes([x]) for x in kind] for b in data) / size for kind in quality.CLASSES]
        words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
        n, m = max(1, len(words)), max(1, len(lines))
        want = [*classes, -sum(c / size * math.log(c / size) for c in Counter(data).values()), math.log1p(len(data)),
                math.log1p(len(words)), len(data) / n, len(set(words)) / n, sum(w in quality.STOP_WORDS for w in words) / n,
                math.log1p(len(lines)), len(set(lines)) / m, n / m, max((len(w) for w in words), default=0)]
        assert got == pytest.approx(want, abs=1e-9), text


def test_lexicon_equals_plain_counts(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        label = i % 3 == 0
        words = [rng.choice(["red", "green", "blue", "Été", "x1y"]) for _ in range(6)]
        words += ["bad"] * (label and rng.random() < 0.8) + ["worse"] * (label and rng.random() < 0.3) + ["fine"] * (not label)
        rng.shuffle(words)
        rows.append((i, int(label), rng.choice((" ", ", ", "-")).join(words)))
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "id long, label int, body string"), 10)
    ones = sum(r[1] for r in rows)
    zeros = len(rows) - ones
    seen = {1: Counter(), 0: Counter()}
    for _, label, body in rows:
        seen[label].update(set(letter_runs(body.lower())))
    want = {}
    for w in set(seen[0]) | set(seen[1]):
        p, n = seen[1][w], seen[0][w]
        odds = math.log((p + 0.5) / (ones + 1)) - math.log((n + 0.5) / (zeros + 1))
        total, parts = ones + zeros, ((p, ones), (n, zeros))
        ratio = 2 * sum(a * math.log(a / ((p + n) * c / total)) for a, c in parts if a)
        if p >= 5 and odds > 1 and ratio > 20:
            want[w] = odds
    assert set(want) == {"bad", "worse"} and got == pytest.approx(want)
