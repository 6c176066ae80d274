"""Fixed values. Word lists, patterns, thresholds and formats that results depend on; they have to be
exactly these for the same input to give the same output."""

# Words of the content heuristics (matched as substrings of the lowercased text).
FACTUAL_WORDS = ["who", "what", "when", "where", "why", "how", "is", "was", "are", "were",
                 "true", "false", "fact", "correct", "according to", "in reality"]
CREATIVE_WORDS = ["imagine", "create", "write a story", "pretend", "suppose", "what if",
                  "invent", "make up", "fictional", "story", "novel", "poem"]
INSTRUCTION_WORDS = ["tell me", "explain", "describe", "list", "show", "give me", "provide"]
TRIPLET_WORDS = ["is", "was", "are", "were", "has", "have", "had", "born in", "located in",
                 "capital of", "invented by", "wrote", "directed", "founded"]

# Words of the two example scores and of the example annotations.
PROMPT_SCORE_WORDS = ["who", "what", "when", "where", "why", "how", "is", "was", "true", "false"]
QA_SCORE_WORDS = ["who", "what", "when", "where", "which", "how many", "year"]
QA_INDICATOR_WORDS = ["who", "what", "when", "where", "which", "how many"]
QA_BONUS_WORDS = ["country", "capital", "president", "world cup", "olympic", "war", "independence"]
QA_VALID_TYPES = ["name", "numeric"]
KIND_INSTRUCTION_WORDS = ["tell me", "explain", "describe"]
FACTUAL_POTENTIAL_WORDS = ["fact", "true", "false", "correct", "when", "where", "who"]

# Column-name keywords; the first role that matches is used.
ROLE_WORDS = {
    "factual": ["fact", "truth", "veracity", "accurate", "correct", "label", "annotation", "claim"],
    "prompt": ["prompt", "text", "question", "statement", "input", "query"],
    "source": ["source", "reference", "url", "link", "citation"],
    "timestamp": ["time", "date"],
}

# Themes looked for among the most frequent answers.
THEME_WORDS = {
    "geographic": ["brazil", "germany", "italy", "france", "argentina", "netherlands", "uruguay"],
    "sport": ["cup", "world", "stadium", "olympic", "championship"],
}
COHERENCE_WORDS = {
    "geographic": (["brazil", "germany", "italy", "france", "argentina", "stadium", "country"], 0.6),
    "sport": (["cup", "world", "olympic", "championship", "tournament"], 0.4),
}
QUESTION_STOPWORDS = ["the", "and", "is", "are", "was", "were", "give", "me", "only",
                      "name", "what", "who", "when", "where", "which", "how"]

# Patterns.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CJK_PATTERN = r"[\x{4e00}-\x{9fff}]"
ACCENT_PATTERN = "[àâçéèêëîïôûùüÿñæœ]"
CAPITALISED_PATTERN = r"(?U)\b[A-Z][a-z]+\b"
DATE_PATTERN = r"(?U)\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}\b"
NUMBER_PATTERN = r"(?U)\b\d+\b"
WORD_PATTERN = r"(?U)\b\w\w+\b"

# Defaults of the balancing run and its gates.
TARGET_COVERAGE = 100
MIN_SIMILARITY = 0.82
MAX_SIMILARITY = 0.95
NOVEL_RATIO = 0.1
SEEDS_PER_CLASS = 50
MIN_COVERAGE_PERCENT = 90.0
MAX_CLASS_CV_PERCENT = 5.0
MAX_DUPLICATE_RATIO = 0.01
DEFAULT_LABEL_MEAN = 1500.0
DEFAULT_LABEL_STD = 200.0

# Labels of the run report, in order.
REPORT_LABELS = ["Coverage target", "Original rows", "Planned new", "Generated total",
                 "Coverage achieved", "Paraphrase mean cosine", "Duplicate ratio (internal)",
                 "Duplicate ratio (vs source)", "Class histogram CV%", "Class counts (orig)"]
