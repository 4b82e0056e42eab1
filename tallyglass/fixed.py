"""Word lists, patterns, weights and limits that results depend on."""

# Words that carry no search meaning.
STOPWORDS = """
a an the of in on at to for from by with and or not is are was were be been being
what which who whom whose how many much list show give find return me all each every
any that this these those there their its it as do does did than then per
""".split()

# Where a name changes word, and what a word is.
CAMEL_BOUNDARY = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
PLAIN_WORD = r"[A-Za-z0-9]+"
SPAN_WORD = r"[\w'.&/-]+"
QUOTED_SPAN = r"['\"‘’“”]([^'\"‘’“”]{2,60})['\"‘’“”]"

# Numbers in prose and the scales of their units.
NUMBER = r"(?<![\w.])[-−]?\$?(\d{1,3}(?:,\d{3})+|\d+)(\.\d+)?\s*(%|percent|k|K|thousand|m|M|million|bn|B|billion)?(?![\w])"
UNIT_MULTIPLIERS = {"k": 1e3, "K": 1e3, "thousand": 1e3, "m": 1e6, "M": 1e6, "million": 1e6, "bn": 1e9, "B": 1e9, "billion": 1e9}

# Column names that announce personal data; the first match wins.
PII_NAME_PATTERNS = {
    "EMAIL": r"e_?mail",
    "PHONE": r"phone|mobile|\bfax\b|\btel(ephone)?\b|cell_?(phone|no|number)",
    "SSN": r"\bssn\b|social_?security|national_?id|tax_?id",
    "CARD": r"card_?(number|no|num)|\bpan\b|credit_?card|cc_?num",
    "PERSON": r"(first|last|middle|full|given|family|sur)_?name|\bname_(first|last)\b|surname",
    "ADDRESS": r"address|street|postal|zip_?code|\bzip\b|postcode",
    "DOB": r"birth|\bdob\b",
    "IP": r"\bip_?(addr(ess)?)?\b",
    "IBAN": r"iban|account_?(number|no)|routing",
}
# Whole values that are personal data, in the order they are tried.
CARD_PATTERN = r"^\d[\d -]{11,22}\d$"
PII_VALUE_PATTERNS = {
    "EMAIL": r"^[\w.+-]+@[\w-]+(\.[\w-]+)+$",
    "SSN": r"^(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$",
    "IP": r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$",
    "IBAN": r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$",
    "PHONE": r"^\+?[\d\s().-]{7,20}$",
}
PHONE_SEPARATOR = r"[\s().+-]"
DATE_LIKE = r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}$"
HIGH_RISK_KINDS = ("EMAIL", "PHONE", "SSN", "CARD", "IBAN", "IP")

# Text that reads like an instruction to a model.
INSTRUCTION_PATTERNS = (
    r"\b(ignore|disregard|forget|override)\b.{0,40}\b(previous|prior|above|all|earlier|system|your)\b.{0,20}\b(instruction|prompt|rule|message|direction)s?",
    r"\b(you are now|act as|pretend (to be|you are)|from now on,? you)\b",
    r"\b(system prompt|developer message|jailbreak|DAN mode)\b",
    r"\b(new|updated|real) instructions?\b",
    r"\b(report|say|state|answer|respond|reply|write|output|claim)\b.{0,60}\b(instead|regardless|no matter)\b",
    r"\b(always|must)\b.{0,30}\b(say|report|answer|respond|output|include)\b",
    r"\b(include|insert|add|append|embed)\b.{0,40}\b(link|url|image|markdown)\b",
    r"https?://\S+\?\S*=",
    r"<\|?(system|im_start|im_end|assistant|user)\|?>|\[/?INST\]|###\s*(system|instruction)",
)
INSTRUCTION_PLACEHOLDER = "[instruction-like text removed]"
INSTRUCTION_MIN_LENGTH = 12

# Wording cues of a hard question.
DIFFICULTY_CUES = {
    "per_group": r"\b(each|per|every|by)\b",
    "compare": r"\b(than|compare|compared|versus|vs\.?|difference|more|less|fewer)\b",
    "negation": r"\b(not|never|no|without|except|excluding|neither|none)\b",
    "superlative": r"\b(most|least|highest|lowest|largest|smallest|top|best|worst|maximum|minimum)\b",
    "ratio": r"\b(ratio|percent|percentage|proportion|share|rate|average|mean)\b",
    "set_op": r"\b(both|either|also|and also|but not|as well as)\b",
    "time": r"\b(year|month|day|date|between|before|after|since|during)\b",
    "multi_answer": r"\b(list|all|which)\b",
}

# List prices, USD per million tokens (in, out).
MODEL_PRICES = {
    "gemini-3.8-flash": (0.75, 3.75),
    "gemini-3.7-flash": (0.75, 3.75),
    "gemini-3.6-flash": (0.75, 3.75),
    "gemini-2.5-flash-lite": (0.10, 0.40),
    "gemini-2.5-flash": (0.30, 2.50),
    "gemini-2.5-pro": (1.25, 10.00),
    "gemini-3.1-flash-lite": (0.25, 1.50),
    "gemini-3.5-flash-lite": (0.30, 2.50),
    "gemini-3.5-flash": (1.50, 9.00),
    "gemini-3.1-pro-preview": (2.00, 12.00),
}
DEFAULT_PRICE = (0.75, 3.75)
FREE_MODEL_PREFIX = "ollama/"
USD_PER_TIB = 6.25

# Result confidence.
START_CONFIDENCE = 90
CHART_START_CONFIDENCE = 95
WARN_BELOW = 70
REJECT_BELOW = 40

# Ids of evaluation items, which never enter the example memory.
EVALUATION_ID_PREFIXES = ("spider-dev-", "bird-minidev-", "chk_")

# Failure categories of labelled misses.
FAILURE_CATEGORIES = ("schema_linking", "join", "aggregation", "value_mismatch", "condition", "ordering_limit",
                      "output_shape", "ambiguous_question", "questionable_gold", "execution_error", "other")
