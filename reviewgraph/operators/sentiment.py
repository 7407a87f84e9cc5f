"""Review sentiment from a lexicon of word valences, compared with the stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewgraph.operators.validation import quartiles

# Fixed value: the constant that maps an unbounded valence sum into (-1, 1).
COMPOUND_ALPHA = 15
# What a token is, by default: a run of letters. TOKENS also finds words with apostrophes or
# hyphens and emoticons, for lexicons that list them.
LETTERS = r"\p{L}+"
TOKENS = r"\p{L}+(?:['’-]\p{L}+)*|[:;=8][-o*']?[()\[\]dDpP/:}{@|]|[()\[\]dDpP/:}{@|][-o*']?[:;=8]"


def words(text: Column, token: str = LETTERS) -> Column:
    """The tokens of a text in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({token})"), F.lit(1))


def _rounded(x: Column, digits: int) -> Column:
    unit = 10 ** digits
    return F.signum(x) * F.floor(F.abs(x) * unit + 0.5) / unit


def sentiment(reviews: DataFrame, lexicon: DataFrame, key: str = "id", text: str = "text",
              token: str = LETTERS) -> DataFrame:
    """Share of negative, neutral and positive weight and the compound score of every text.

    ``lexicon`` has ``word`` (in lower case) and ``valence``, ``token`` is the pattern of a word. A positive word weighs its valence plus one, a
    negative word its size plus one, any other word one. A lexicon of usual size is broadcast
    by Spark, so the words never leave the task that split them and each text crosses the
    network as one row of partial sums; with a larger one Spark joins on the word instead.
    """
    valences = lexicon.select("word", F.col("valence").cast("decimal(10,4)").alias("valence"))
    split = reviews.select(key, F.explode_outer(words(F.col(text), token)).alias("word"))
    found = split.join(valences, "word", "left")
    v = F.col("valence")
    zero = F.lit(0).cast("decimal(10,4)")
    sums = found.groupBy(key).agg(
        F.count("word").alias("n_words"),
        F.sum(F.coalesce(v, zero)).cast("double").alias("total"),
        F.sum(F.when(v > 0, v + 1).otherwise(zero)).cast("double").alias("up"),
        F.sum(F.when(v < 0, 1 - v).otherwise(zero)).cast("double").alias("down"),
        F.count(F.when(F.col("word").isNotNull() & (F.coalesce(v, zero) == 0), 1)).alias("flat"))
    weight = F.col("up") + F.col("down") + F.col("flat")

    def share(column: str) -> Column:
        return F.coalesce(_rounded(F.try_divide(F.col(column), weight), 3), F.lit(0.0))

    compound = F.col("total") / F.sqrt(F.col("total") * F.col("total") + COMPOUND_ALPHA)
    return sums.select(key, "n_words", share("down").alias("neg"), share("flat").alias("neu"),
                       share("up").alias("pos"), _rounded(compound, 4).alias("compound"))


# Fixed values of the published rules: what capitals add, how far back a word acts and with what
# weight, what a negation turns a valence into, the weights before and after a contrast, and what
# exclamation and question marks add.
CAPITALS = 0.733
REACH = {1: 1.0, 2: 0.95, 3: 0.9}
NEGATION = -0.74
BEFORE_CONTRAST, AFTER_CONTRAST = 0.5, 1.5
EXCLAMATION, MOST_EXCLAMATIONS = 0.292, 4
QUESTION, MOST_QUESTIONS, MANY_QUESTIONS = 0.18, 3, 0.96
# Sums are taken over whole millionths, so that their order cannot change a result.
MICRO = 1_000_000
# Words that act on others: their effect and, of boosters, how much.
RULES = (
    *((w, "negates", 0.0) for w in (
        "not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "nowhere", "without",
        "cannot", "can't", "don't", "doesn't", "didn't", "isn't", "aren't", "wasn't", "weren't",
        "won't", "wouldn't", "shouldn't", "couldn't", "hasn't", "haven't", "hadn't", "rarely",
        "seldom", "despite")),
    *((w, "boosts", 0.293) for w in (
        "absolutely", "amazingly", "awfully", "completely", "deeply", "enormously", "entirely",
        "especially", "exceptionally", "extremely", "greatly", "highly", "hugely", "incredibly",
        "intensely", "more", "most", "particularly", "purely", "quite", "really", "remarkably",
        "so", "thoroughly", "totally", "tremendously", "unbelievably", "utterly", "very")),
    *((w, "boosts", -0.293) for w in (
        "almost", "barely", "hardly", "kinda", "less", "little", "marginally", "occasionally",
        "partly", "scarcely", "slightly", "somewhat", "sorta")),
    ("but", "contrasts", 0.0))


def learned_lexicon(texts: DataFrame, labels: DataFrame, key: str, label: str,
                    least: int = 5) -> DataFrame:
    """``word, valence``: how much more often texts of label 1 have a word than those of label 0.

    The logarithm of the ratio of both shares of texts, smoothed, cut to four either way; words of
    fewer than ``least`` labelled texts are left out.
    """
    known = texts.join(labels.where(F.col(label).isin(0, 1)).select(key, label), key)
    found = known.select(key, label, F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    one, zero = (F.sum((F.col(label) == k).cast("long")) for k in (1, 0))
    ones, zeros = known.agg(*[F.coalesce(n, F.lit(0)) for n in (one, zero)]).first()
    counts = found.groupBy("word").agg(one.alias("one"), zero.alias("zero")).where(
        F.col("one") + F.col("zero") >= least)
    ratio = F.ln(((F.col("one") + 0.5) / (ones + 1)) / ((F.col("zero") + 0.5) / (zeros + 1)))
    return counts.select(
        "word", F.greatest(F.least(_rounded(ratio, 4), F.lit(4.0)), F.lit(-4.0)).alias("valence"))


def ordered_sentiment(reviews: DataFrame, lexicon: DataFrame, rules: DataFrame, key: str = "id",
                      text: str = "text", token: str = TOKENS) -> DataFrame:
    """As :func:`sentiment`, with the order of words, capitals and punctuation taken into account.

    ``rules`` has ``word``, ``effect`` (``negates``, ``boosts`` or ``contrasts``) and ``size``. A
    word with a valence is raised or lowered by boosters among the three words before it and
    turned round by negations there, the farther the less; it counts more in capitals, less
    before the first contrast of a text and more after it. Exclamation and question marks add to
    whichever side is larger. Only words that are in a table leave the task that split the text.
    """
    effect = rules.groupBy("word").agg(
        F.max(F.when(F.col("effect") == "boosts", F.col("size"))).alias("boost"),
        F.max(F.col("effect") == "negates").alias("negates"),
        F.max(F.col("effect") == "contrasts").alias("contrasts"))
    valences = lexicon.select("word", F.col("valence").cast("double").alias("valence")).where(
        "valence <> 0")
    marks = valences.join(effect, "word", "full")
    raw = F.regexp_extract_all(F.col(text), F.lit(f"({token})"), F.lit(1))
    split = reviews.select(key, F.posexplode_outer(raw).alias("pos", "raw")).withColumn(
        "word", F.lower("raw"))
    capital = F.coalesce(F.col("raw").rlike(r"^\p{Lu}{2,}$"), F.lit(False))
    known = F.col("valence").isNotNull() | F.col("negates").isNotNull()
    mark = F.struct("pos", "valence", "boost", "negates", "contrasts", capital.alias("capital"))
    gathered = split.join(marks, "word", "left").groupBy(key).agg(
        F.count("raw").alias("n_words"), F.sum(capital.cast("int")).alias("capitals"),
        F.array_sort(F.collect_list(F.when(known, mark))).alias("marks"))
    mixed = F.col("capitals").between(1, F.col("n_words") - 1)
    first = F.array_min(F.transform(F.filter("marks", lambda m: m["contrasts"]),
                                    lambda m: m["pos"]))

    def acted_on(m: Column, i: Column) -> Column:
        sign = F.signum(m["valence"])
        x = m["valence"] + F.when(mixed & m["capital"], sign * CAPITALS).otherwise(0.0)
        for back, share in REACH.items():
            # Of the marked words, the one so far back is among the last three.
            near = [F.get("marks", i - e) for e in REACH]
            at = [F.when(n["pos"] == m["pos"] - back, n) for n in near]
            own = F.coalesce(*at)
            boost = own["boost"] * sign
            boost = boost + F.when(mixed & own["capital"], F.signum(boost) * CAPITALS).otherwise(0.0)
            x = x + F.when(own["valence"].isNull() & own["boost"].isNotNull(), boost * share
                           ).otherwise(0.0)
            x = x * F.when(F.coalesce(own["negates"], F.lit(False)), NEGATION).otherwise(1.0)
        return x * F.when(m["pos"] < first, BEFORE_CONTRAST).when(
            m["pos"] > first, AFTER_CONTRAST).otherwise(1.0)

    whole = F.transform("marks", lambda m, i: F.when(m["valence"].isNotNull(), F.floor(
        acted_on(m, i) * MICRO + 0.5)))
    sums = gathered.select(key, "n_words", F.filter(whole, lambda x: x.isNotNull()).alias("x"))

    def total(f) -> Column:
        return F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + f(x))

    def side(sign: int) -> Column:
        return total(lambda x: F.when(F.signum(x) == sign, x * sign + MICRO).otherwise(0)) / MICRO

    marks_of = reviews.select(key, *[
        (F.length(F.col(text)) - F.length(F.replace(F.col(text), F.lit(c), F.lit("")))).alias(n)
        for c, n in (("!", "_calls"), ("?", "_asks"))])
    asked = F.when(F.col("_asks") <= 1, 0.0).when(
        F.col("_asks") <= MOST_QUESTIONS, F.col("_asks") * QUESTION).otherwise(MANY_QUESTIONS)
    emphasis = marks_of.groupBy(key).agg(F.max(
        F.least(F.col("_calls"), F.lit(MOST_EXCLAMATIONS)) * EXCLAMATION + asked).alias("more"))
    summed = sums.select(
        key, "n_words", (total(lambda x: x) / MICRO).alias("total"), side(1).alias("up"),
        side(-1).alias("down"), (F.col("n_words") - total(lambda x: F.when(x != 0, 1).otherwise(0)))
        .alias("flat")).join(emphasis, key)
    more = F.coalesce("more", F.lit(0.0))
    louder = summed.select(
        key, "n_words", "flat", (F.col("total") + F.signum("total") * more).alias("total"),
        (F.col("up") + F.when(F.col("up") > F.col("down"), more).otherwise(0.0)).alias("up"),
        (F.col("down") + F.when(F.col("down") > F.col("up"), more).otherwise(0.0)).alias("down"))
    weight = F.col("up") + F.col("down") + F.col("flat")

    def share(column: str) -> Column:
        return F.coalesce(_rounded(F.try_divide(F.col(column), weight), 3), F.lit(0.0))

    compound = F.col("total") / F.sqrt(F.col("total") * F.col("total") + COMPOUND_ALPHA)
    return louder.select(key, "n_words", share("down").alias("neg"), share("flat").alias("neu"),
                         share("up").alias("pos"), _rounded(compound, 4).alias("compound"))


def sentiment_by_stars(scored: DataFrame, stars: str = "stars") -> DataFrame:
    """Box-plot numbers of each share per star value. ``scored`` carries the stars."""
    shares = ("neg", "neu", "pos")
    long = scored.select(stars, F.explode(F.array(
        *[F.struct(F.lit(s).alias("share"), F.col(s).alias("value")) for s in shares])).alias("x"))
    return quartiles(long.select(stars, "x.*"), "value", by=(stars, "share"))
