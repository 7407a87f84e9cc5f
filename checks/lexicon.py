"""Word valences for the invented prose of the test documents."""

# Words that occur in the test documents, with a valence between -4 and 4.
LEXICON = {
    "idiot": -2.3, "clown": -1.6, "stupid": -2.4, "hate": -2.7, "damn": -1.7,
    "thing": 0.8, "shing": 1.1, "hand": 1.5, "reation": 1.9, "heat": -0.6, "onheed": -1.2,
    "sich": 0.4, "heit": 1.3, "nicht": -1.0, "pour": 0.5, "avec": 0.9, "mente": 0.7,
    "para": 0.3, "queci": -0.8,
}

# Words with apostrophes and hyphens and emoticons, beside plain ones.
TOKEN_LEXICON = {**LEXICON, "isn't": -0.5, "well-made": 2.1, ":)": 2.0, ":(": -2.0, ":-d": 2.3}

# Words of the invented prose that stand for boosters, negations and a contrast.
PROSE_RULES = (("the", "boosts", 0.293), ("thou", "boosts", -0.293), ("on", "negates", 0.0),
               ("er", "negates", 0.0), ("and", "contrasts", 0.0), ("reor", "boosts", 0.293))
