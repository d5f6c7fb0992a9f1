"""Small side tables that a user supplies; here made of words the test texts use."""

STOP_TABLE = ["the", "of", "and", "de", "la", "der", "die", "that", "un", "des"]

LEMMAS = [
    ("ered", "er"),
    ("erin", "er"),
    ("erst", "er"),
    ("eres", "er"),
    ("erer", "er"),
    ("thing", "th"),
    ("thed", "th"),
    ("thes", "th"),
    ("inging", "ing"),
    ("una", "un"),
]

#: Exceptions to the rules of nouns.
IRREGULAR = [("ther", "th"), ("erst", "er"), ("thens", "the"), ("eres", "nowhere")]

LEXICON = [
    ("ther", "fear"),
    ("ther", "negative"),
    ("thing", "trust"),
    ("thing", "positive"),
    ("erer", "anger"),
    ("erer", "negative"),
    ("eren", "anticipation"),
    ("sich", "trust"),
    ("sich", "anticipation"),
    ("avec", "joy"),
    ("avec", "positive"),
    ("nicht", "sadness"),
    ("nicht", "negative"),
    ("pour", "joy"),
    ("pour", "surprise"),
    ("attion", "surprise"),
    ("thon", "disgust"),
    ("thon", "negative"),
    ("thed", "disgust"),
    ("auf", "joy"),
    ("del", "fear"),
    ("las", "anticipation"),
    ("las", "positive"),
    ("orre", "anger"),
    ("thatin", "sadness"),
]

COMMUNITIES = ["signup", "error"]
SOURCES = ["error", "purchase", "signup", "view"]
