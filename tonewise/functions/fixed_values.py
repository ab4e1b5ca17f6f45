"""Constants and word lists the scores depend on."""

# Scalars of the scoring rules.
BOOST = 0.293
CAPS_BOOST = 0.733
NEGATION_FACTOR = -0.74
EXCLAMATION_STEP = 0.292
QUESTION_STEP = 0.18
QUESTION_MAX = 0.96
NORMALISER = 15

# Punctuation runs that may be stripped from one side of a token.
PUNCTUATION_RUNS = [
    ".", "!", "?", ",", ";", ":", "-", "'", "\"", "!!", "!!!",
    "??", "???", "?!?", "!?!", "?!?!", "!?!?",
]

# Negation words.
NEGATIONS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt",
    "ain't", "aren't", "can't", "couldn't", "daren't", "didn't", "doesn't",
    "dont", "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt", "neither",
    "don't", "hadn't", "hasn't", "haven't", "isn't", "mightn't", "mustn't",
    "neednt", "needn't", "never", "none", "nope", "nor", "not", "nothing", "nowhere",
    "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent",
    "oughtn't", "shan't", "shouldn't", "uh-uh", "wasn't", "weren't",
    "without", "wont", "wouldnt", "won't", "wouldn't", "rarely", "seldom", "despite",
]

# Degree words that raise (+BOOST) or lower (-BOOST) the next valence.
RAISING = [
    "absolutely", "amazingly", "awfully", "completely", "considerably", "decidedly", "deeply",
    "effing", "enormously", "entirely", "especially", "exceptionally", "extremely", "fabulously",
    "flipping", "flippin", "fricking", "frickin", "frigging", "friggin", "fully", "fucking",
    "greatly", "hella", "highly", "hugely", "incredibly", "intensely", "majorly", "more", "most",
    "particularly", "purely", "quite", "really", "remarkably", "so", "substantially",
    "thoroughly", "totally", "tremendously", "uber", "unbelievably", "unusually", "utterly",
    "very",
]
LOWERING = [
    "almost", "barely", "hardly", "just enough", "kind of", "kinda", "kindof", "kind-of", "less",
    "little", "marginally", "occasionally", "partly", "scarcely", "slightly", "somewhat",
    "sort of", "sorta", "sortof", "sort-of",
]

# Idioms and the valence each one sets.
IDIOMS = {
    "the shit": 3.0,
    "the bomb": 3.0,
    "bad ass": 1.5,
    "yeah right": -2.0,
    "cut the mustard": 2.0,
    "kiss of death": -1.5,
    "hand to mouth": -2.0,
}

# Class names by code.
SENTIMENT_NAMES = ["TERRIBLE", "NEGATIVE", "NEUTRAL", "POSITIVE", "SUPER_NICE"]

# Spark's English stop words.
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its",
    "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom",
    "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but",
    "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to",
    "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few",
    "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now", "i'll",
    "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd", "we'd",
    "they'd", "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've", "we've",
    "you've", "they've", "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't",
    "don't", "doesn't", "didn't", "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't",
    "couldn't", "cannot", "could", "here's", "how's", "let's", "ought", "that's", "there's",
    "what's", "when's", "where's", "who's", "why's", "would",
]
