"""Results depend on these being exactly as they are."""

# The English stop words of Spark ML.
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()

# Stop words added to the English list.
CUSTOM_STOPWORDS = [
    "nan", ".", ",", ":", "...", '!"', '?"', "'", '"', " - ", " — ", ',"', '."', "!", ";", "’", "s", "one",
    "get", "it", "di", "para",
    ".'\"", "[", "]", "—", ".'", "ok", "okay", "yeah", "ya", "stuff", " 000 ", "“", "”", " ’", "im", "el",
    "les", "le",
    "t", "was", "wa", "?", "like", "go", "'s", "i", " I ", " ? ", "s", " t ", "ve", "re", "guy", "de", "la",
    "que", "en", "u", "los", "would", "dont", "the",
    "0", "00", "000", "à", "a", "e", "w", "es", "por", "also", "one", "two", "three",
    "se", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11", "12", "13", "14", "15", "16",
    "17", "18", "19", "20",
    "क", "ह", "nan",
]

# Suffixes of nouns and the endings that take their place.
NOUN_RULES = [
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"),
    ("men", "man"), ("ies", "y"),
]

# Affects, emotions first.
EMOTIONS = ["fear", "anger", "anticipation", "trust", "surprise", "sadness", "disgust", "joy"]
POLARITIES = ["positive", "negative"]
AFFECTS = EMOTIONS + POLARITIES
# The one affect that is missing, not zero, where a post has no hit for it.
MISSING_WHEN_ABSENT = "anticipation"

# Separators of the per-author document.
FIELD_SEPARATOR = " </s> "
POST_SEPARATOR = "<s> "

# Placeholder author, encoder length.
PLACEHOLDER_AUTHOR = "[deleted]"
ENCODER_TOKENS = 4096

# Share bands (low, high], lowest share allowed in the other class.
SHARE_BANDS = {
    1: (1e-1, 1.0),
    2: (1e-2, 1e-1),
    3: (1e-3, 1e-2),
    4: (1e-4, 1e-3),
    5: (1e-5, 1e-4),
    6: (1e-6, 1e-5),
}
OTHER_SHARE_FLOOR = 1e-6

# How many words each pass takes from a band.
BAND_PICKS = {
    "a_top": {1: 4, 2: 4, 3: 4, 4: 0, 5: 4, 6: 4},
    "a_bottom": {1: 4, 2: 4, 3: 4, 4: 4, 5: 4, 6: 4},
    "b_top": {1: 4, 2: 4, 3: 4, 4: 4, 5: 4, 6: 4},
    "b_bottom": {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0},
}
ABSOLUTE_PICKS = 5
METRIC_PICKS = 5
TOP_WORDS_PER_CLASS = 15
TFIDF_PICKS = 20

# Axis scaling, histogram bins.
EXTENT_HIGH = 1.1
EXTENT_LOW = 15.0
HISTOGRAM_BINS = 250

# Classifier shape and training constants.
EMBEDDING_SIZE = 768
HIDDEN_LAYERS = [512, 256, 128, 64, 32, 16]
TEST_SIZE = 0.2
SPLIT_SEED = 42
BATCH_SIZE = 256
EPOCHS = 10
DROPOUT = 0.5
LEARNING_RATE = 1e-3
# Decay of the two moments, the least divisor, and weight decay.
ADAMW = (0.9, 0.999, 1e-8, 0.01)
