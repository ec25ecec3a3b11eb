"""Fixed values.

Results are only right when these equal the published behaviour, so they are
stated plainly here and nowhere else.
"""

# --- whitespace: every character that Python's ``str.split()`` splits on -----
WHITESPACE = (
    r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# --- answer mining -----------------------------------------------------------
STOP_WORDS = (
    "and", "are", "but", "for", "from", "have", "that", "the", "this", "was", "were",
    "без", "был", "была", "были", "в", "все", "где", "для", "его", "ее", "и", "из",
    "к", "как", "когда", "кто", "на", "над", "о", "об", "по", "под", "при", "с",
    "что", "это",
)
WORD_PATTERN = r"[A-Za-zЀ-ӿ][A-Za-zЀ-ӿ\-]*"
CAPITALIZED_PATTERN = r"[A-ZА-ЯЁ][A-Za-zЀ-ӿ\-]*"
CAPITALS_PATTERN = r"[A-ZА-ЯЁ]{2,}"
QUOTED_PATTERN = r'["«](.{3,80}?)["»]'
# Dates and numbers: a day, a month name and a year; a year or a century; a quantity.
MONTH_NAME_PATTERN = r"[Ѐ-ӿ]{3,12}"
YEAR_WORD_PATTERN = r"(?:г\.?|год[ауе]?|век[ауе]?|вв?\.?)"
DECIMALS_PATTERN = r"(?:[,.]\d+)?"
UNIT_PATTERN = r"(?:%|km|m|cm|kg|g|mln|million|billion)"
SENTENCE_END = ".!?"
STRIP_CHARS = " \t\r\n,.;:!?()[]{}"
MIN_ANSWER_LENGTH = 2
MAX_ANSWER_LENGTH = 90
MIN_KEYWORD_LENGTH = 5
MAX_NAME_WORDS = 5
DEFAULT_MAX_ANSWERS = 5

# Candidate tiers, best first: (kind, score).
TIERS = (
    ("quoted", 4.0),
    ("date_or_number", 3.7),
    ("abbreviation", 3.4),
    ("proper_name", 3.0),
    ("keyword", 1.6),  # three words
    ("keyword", 1.4),  # two words
    ("keyword", 1.2),  # one word
)

# --- questions ---------------------------------------------------------------
DEFAULT_TEMPLATE = "generate question: context: {context} answer: {answer}"
BLANK = "_____"
SENTINEL_TOKEN = "<extra_id_0>"
MIN_QUESTION_LENGTH = 5
EMPTY_PROMPTS = ("context:", "answer:", "generate question:")
STRATEGIES = ("hybrid", "template", "model")
# kind -> (text before the fact, text before the answer when there is no fact)
QUESTION_TEXTS = {
    "date_or_number": ("Какая дата или число пропущено в факте: ", "Когда упоминается "),
    "proper_name": ("Кто или что пропущено в факте: ", "Кто или что такое "),
    "abbreviation": (None, "Что обозначает "),
    "other": ("Какое ключевое понятие пропущено в факте: ", "Что сказано о "),
}

# --- tables ------------------------------------------------------------------
RATING_COLUMNS = (
    "fluency_score_1_5", "relevance_score_1_5", "answerability_score_1_5",
    "pedagogical_value_score_1_5", "overall_score_1_5", "annotator_id", "notes",
)
METRIC_COLUMNS = (
    "sacrebleu", "rouge1", "rouge2", "rougeL", "rougeLsum", "meteor", "bertscore_f1",
)
REPORT_COLUMNS = (
    "id", "scenario", "model_name", "train_language", "eval_language",
    "sacrebleu", "rougeL", "meteor", "bertscore_f1", "best_val_loss",
)

# --- generation defaults -----------------------------------------------------
GENERATION_DEFAULTS = {
    "max_new_tokens": 64, "num_beams": 4, "do_sample": False,
    "temperature": 1.0, "top_p": 1.0,
}
DEFAULT_PATIENCE = 2
LABEL_PAD = -100

# --- stems: the public suffix rules of 1980 with their customary extensions ----
# (ending, what replaces it); the first ending that fits decides.
STEM_PLURALS = (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", ""))
STEM_REPAIRS = (("at", "ate"), ("bl", "ble"), ("iz", "ize"))
STEM_DOUBLE = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"), ("logi", "log"),
)
STEM_SINGLE = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
STEM_LAST = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism",
    "ate", "iti", "ous", "ive", "ize",
)
STEM_IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
