"""Sentiment with rules on the order of words, against a plain walk over the words."""

import math
import random
import re
from collections import Counter

import pytest

from reviewgraph.operators import sentiment as T

LEXICON = {"good": 1.9, "great": 3.1, "bad": -2.5, "awful": -2.0, "fine": 0.8, ":)": 2.0, "flat": 0.0}
NAMES = ["neg", "neu", "pos", "compound"]
TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|[:;=8][-o*']?[()\[\]dDpP/:}{@|]"
                   r"|[()\[\]dDpP/:}{@|][-o*']?[:;=8]")


def rounded(x, digits):
    return math.copysign(math.floor(abs(x) * 10 ** digits + 0.5) / 10 ** digits, x)


def walk(text):
    """One text, word after word."""
    rules = {}
    for word, effect, size in T.RULES:
        rules.setdefault(word, {})[effect] = size
    raw = TOKEN.findall(text or "")
    words = [w.lower() for w in raw]
    caps = [len(w) > 1 and w.isalpha() and w.isupper() for w in raw]
    mixed = 0 < sum(caps) < len(raw)
    contrast = next((i for i, w in enumerate(words) if "contrasts" in rules.get(w, {})), None)
    values = []
    for i, w in enumerate(words):
        v = LEXICON.get(w, 0.0)
        if not v:
            continue
        sign = math.copysign(1, v)
        x = v + (sign * 0.733 if mixed and caps[i] else 0.0)
        for back, share in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if i >= back:
                j = i - back
                own = rules.get(words[j], {})
                if "boosts" in own and not LEXICON.get(words[j]):
                    b = own["boosts"] * sign
                    if mixed and caps[j]:
                        b += math.copysign(0.733, b)
                    x += b * share
                if "negates" in own:
                    x *= -0.74
        if contrast is not None and i != contrast:
            x *= 0.5 if i < contrast else 1.5
        values.append(math.floor(x * 1e6 + 0.5))
    marks = Counter(text or "")
    more = min(marks["!"], 4) * 0.292 + (
        0.0 if marks["?"] <= 1 else marks["?"] * 0.18 if marks["?"] <= 3 else 0.96)
    total = sum(values) / 1e6
    total += more * ((total > 0) - (total < 0))
    up = sum(v + 10 ** 6 for v in values if v > 0) / 1e6
    down = sum(10 ** 6 - v for v in values if v < 0) / 1e6
    flat = len(words) - sum(v != 0 for v in values)
    up, down = up + more * (up > down), down + more * (down > up)
    whole = up + down + flat
    shares = [rounded(x / whole, 3) if whole else 0.0 for x in (down, flat, up)]
    return (*shares, rounded(total / math.sqrt(total * total + 15), 4))


def scores(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    lexicon = spark.createDataFrame(list(LEXICON.items()), "word string, valence double")
    rules = spark.createDataFrame(T.RULES, "word string, effect string, size double")
    out = T.ordered_sentiment(rows, lexicon, rules).collect()
    assert len(out) == len(texts)
    return {texts[r["id"]]: tuple(r[c] for c in NAMES) for r in out}


def test_rules_raise_lower_and_turn(spark):
    got = scores(spark, ["good", "very good", "slightly good", "not good", "GOOD food", "good!!",
                         "not very good", "good but bad", "bad but good", "very tasty and good"])
    c = {t: s[3] for t, s in got.items()}
    assert c["very good"] > c["very tasty and good"] > c["good"] > c["slightly good"] > 0
    assert c["not good"] < 0 and c["not very good"] < c["not good"]
    assert c["GOOD food"] > c["good!!"] > c["good"]
    assert c["bad but good"] > 0 > c["good but bad"]


def test_any_text_matches_a_walk_over_its_words(spark):
    rng = random.Random(7)
    parts = ["good", "GREAT", "bad", "AWFUL", "fine", ":)", "flat", "not", "never", "isn't", "very",
             "VERY", "slightly", "but", "table", "The", "!", "?", "??", "word", "so", "NOT"]
    texts = {" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(400)}
    texts = [*sorted(texts), "", "123", "GOOD", "good " * 3000]
    got = scores(spark, texts)
    for text in texts:
        assert got[text] == pytest.approx(walk(text), abs=1e-9), text


def test_missing_texts_have_no_words(spark):
    lexicon = spark.createDataFrame([("good", 1.0)], "word string, valence double")
    rules = spark.createDataFrame(T.RULES, "word string, effect string, size double")
    rows = spark.createDataFrame([(1, None), (2, "good")], "id int, text string")
    got = {r["id"]: r for r in T.ordered_sentiment(rows, lexicon, rules).collect()}
    assert (got[1]["n_words"], got[1]["compound"], got[1]["neu"]) == (0, 0.0, 0.0)
    assert got[2]["pos"] == 1.0
    assert T.ordered_sentiment(rows.limit(0), lexicon, rules).collect() == []


def test_a_lexicon_is_learned_from_labels(spark):
    rows = [(i, "nice place" if i % 2 else "dirty place") for i in range(20)] + [(99, "rare nice")]
    texts = spark.createDataFrame(rows, "doc_id int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id int, quality int")
    got = {r["word"]: r["valence"] for r in T.learned_lexicon(texts, labels, "doc_id", "quality")
           .collect()}
    assert got == {"nice": pytest.approx(math.log(21), abs=1e-4), "place": 0.0,
                   "dirty": pytest.approx(-math.log(21), abs=1e-4)}
