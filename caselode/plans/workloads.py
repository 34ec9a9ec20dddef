"""Inputs of the registered queries that no table holds: fixed values."""

TITLES = [("1", "Abc 中文"), ("2", "中文 abc"), ("3", ""), ("4", None), ("5", "Plain title"), ("6", "一"), ("7", "鿿 last of the block"), ("8", "、 punctuation only")]
LEXICON = [("the", "v", "the-verb"), ("the", "n", "the-noun"), ("la", "v", "el"), ("der", "v", "die"), ("of", "n", "off")]
LONG = "this is a " + "very " * 4521 + "long sentence"
#: id, query, type, clauses, tokens that rank it
QUERIES = [
    ("q1", "quiet phone call", "free-text", 3, 3),
    ("q2", "good grades exchange scandal", "free-text", 4, 4),
    ("q3", '"fertility treatment" AND damages', "boolean with phrasal", 2, 3),
    ("c1", 'quiet AND "phone call"', "boolean with phrasal", 2, 3),
    ("c2", 'prostitute AND "forced sex" AND payment', "boolean with phrasal", 3, 4),
    ("c3", "“fertile treatment” AND damage", "boolean", 5, 5),
    ("c6", "“good grade” AND exchange AND scandal", "boolean", 6, 6),
    ("free", "testing and to see if it regards it as a boolean query", "free-text", 12, 12),
    ("free1", "a", "free-text", 1, 1),
    ("free2", LONG, "free-text", 4526, 4526),
    ("bool", "court AND world", "boolean", 2, 2),
    ("phrase", '"any police officer"', "phrasal", 1, 3),
    ("phrase1", '"a"', "phrasal", 1, 1),
    ("phrase2", " AND ".join(['"hi" AND "hi hello" AND "hi hello hey"'] * 8), "boolean with phrasal", 24, 48),
    ("phrase3", '"this is a query that shouldn\'t work" AND AND AND "is it ok if this is working"', "invalid", 0, 0),
    ("mixed", '"the court" AND "based on"', "boolean with phrasal", 2, 4),
    ("mixed1", 'a AND "a"', "boolean with phrasal", 2, 2),
    ("mixed2", f'and AND And AND aNd AND anD AND ANd AND AnD AND aND AND "{LONG}"', "boolean with phrasal", 8, 4533),
    ("bad", "the AND AND hi", "invalid", 0, 0),
    ("bad1", "AND hi", "invalid", 0, 0),
    ("bad2", "hi AND", "invalid", 0, 0),
    ("none", "", "free-text", 0, 0),
]
PLAIN = [("q1", "quiet phone call"), ("q2", "good grades exchange scandal"), ("q3", "fertility treatment damages"), ("q4", "fraud fraud IVF ivf")]
THESAURUS = [("big", "a", 1, "large"), ("big", "a", 1, "big"), ("big", "a", 2, "great"), ("big", "a", 3, "large"), ("big", "a", 4, "phone_call"), ("big", "a", 5, "AND"), ("big", "a", 6, "huge"), ("big", "a", 7, "vast"), ("run", "v", 1, "race"), ("run", "n", 1, "streak")]
UNKNOWN = [("t1", "big run phone"), ("t2", "big big unknown fraud")]
WORDS = [("big", "a"), ("run", "v"), ("unknown", "n")]
RANKED = ["the", "the", "la", "der", "tion", "absent-word"]
AND_QUERY, PHRASE_QUERY, MIXED_QUERY = "the AND of", '"of the"', '"of the" AND in AND "to the"'
ARRIVALS = [(1, "a", "1.t", 0), (2, "a", "1.c", 0), (2, "a", "1.c", 3), (3, "a", "2.c", 0), (4, "a", "1.c", 0), (4, "b", "1.c", 1)]
STEMS = [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("rational", "ration"), ("digitizer", "digit"), ("triplicate", "triplic"), ("formalize", "formal"), ("hopeful", "hope"), ("goodness", "good"), ("adjustable", "adjust"), ("adoption", "adopt"), ("controller", "control"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll")]
COURTS = [("UK Supreme Court", 10.0), ("SG High Court", 8.5), ("SG Magistrates Court", 1.0), ("", 1.0)]
LOOKUPS = ["the", "la", "absent-word"]
#: File name, query; of words that the documents hold.
SEARCHED = [("one", "the la tion der"), ("two", '"of the" AND in AND "to the"'), ("three", "the AND AND of"), ("four", "absent-word"), ("five", "und AND die")]
