r"""Text measures: tokens, words, sentences, entities, fact density, intent.

Patterns follow Unicode rules for ``\w``, ``\b`` and ``\d`` (the ``(?U)`` flag) and spell
white space out, because the JVM's ``\s`` covers fewer characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.columns import count_matches, let

# White space, as the inside of a character class and as plain characters. One category test
# next to the Latin-1 bit set is several times faster than a list of ranges.
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
SPACE_CHARS = "".join(
    chr(code)
    for code in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680]
    + [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def unicode_pattern(pattern: str, ignore_case: bool = False) -> str:
    r"""``pattern`` with Unicode classes; ``\s`` and ``\S`` must stand outside brackets."""
    pattern = pattern.replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    return ("(?diU)" if ignore_case else "(?dU)") + pattern


# --- fixed values: token separators, weights and patterns the measures are defined by ---------
TOKEN_PATTERN = rf"""[^{SPACE},.:;!?()\[\]{{}}"']+"""
TOKENS_PER_WORD = 1.3
TOKENS_PER_TOOL = 120
WORD_BREAK = r"[^\p{L}\p{N}_]+"
ENTITY_PATTERN = (
    r"https?://\S+"
    r"|\b\d+(?:[.,/]\d+)*\s*(?:%|USD|EUR|GBP|k|M|B|ms|px|rem|em)?\b"
    r"|\b[A-Z]{2,}\b"
    r"|[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"
)
FACT_PATTERN = (
    r"\b\d[\d,]*\.?\d*\s*(?:seconds?|minutes?|hours?|days?|ms|GB|MB|KB|rows?|%|k|M)\b"
    r"|https?://\S+"
    r"|\b[a-z][a-z0-9]*(?:[_\-/][a-z0-9]+){1,5}\b"
    r"""|\b[a-z_]+\s*[:=]\s*[\w.\-/'"]{2,}"""
    r"|\b\d{2,}\b"
)
GOAL_PATTERN = (
    r"\b(?:i want|i need|i'm trying|goal is|task is|objective is|"
    r"please|i'd like|we need|we want|help me|create|build|write|"
    r"implement|generate|analyze|explain|summarize|compare)\b"
)
CONSTRAINT_PATTERN = (
    r"\b(?:must|should|don't|do not|avoid|never|always|required|"
    r"important|ensure|make sure|without|except|only|no\b)\b"
)
CONTEXT_PATTERN = (
    r"\b(?:i am|i'm|we are|we're|the project|the app|the system|"
    r"background|context|using|built with|based on|version|codebase)\b"
)
FORMAT_PATTERN = (
    r"\b(?:return|format|output|as json|as yaml|as table|step.by.step|"
    r"bullet|numbered|concise|detailed|code only)\b"
)
PERMANENT_PATTERN = (
    r"\b(?:must|should not|do not|don't|never|always|required|important|"
    r"ensure|make sure|constraint|requirement|rule|policy|"
    r"stack|framework|version|using|built with|based on|architecture|"
    r"the project|the system|the app|the service|the database|the api)\b"
)
INTENT_WEIGHTS = (
    (GOAL_PATTERN, 3.0),
    (CONSTRAINT_PATTERN, 2.5),
    (CONTEXT_PATTERN, 2.0),
    (FORMAT_PATTERN, 1.5),
)
JACCARD_STOP = ("the", "a", "an", "is", "are", "and", "or", "to", "of", "in", "i")
NOVELTY_STOP = (
    "i", "you", "the", "a", "an", "is", "are", "was", "were", "be",
    "to", "of", "in", "it", "that", "this", "and", "or", "but", "so",
    "ok", "okay", "yes", "no", "sure", "great", "thanks", "thank",
    "sounds", "good", "got", "noted", "understood",
)
# --- end of fixed values ------------------------------------------------------------------


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def token_words(text: Column) -> Column:
    """Words as the token estimate sees them; sums over parts of a text joined by spaces."""
    return count_matches(text, TOKEN_PATTERN)


def tokens_from_words(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n * F.lit(TOKENS_PER_WORD))).cast("long")


def token_count(text: Column) -> Column:
    return tokens_from_words(token_words(text))


def token_count_unfloored(text: Column) -> Column:
    """The browser variant: an empty text counts zero."""
    return F.ceil(token_words(text) * F.lit(TOKENS_PER_WORD)).cast("long")


def token_count_chinese(text: Column) -> Column:
    """One token per CJK ideograph plus one per other word."""
    han = r"[一-鿿]"
    others = F.regexp_replace(text, han, " ")
    return F.greatest(F.lit(1), count_matches(text, han) + token_words(others)).cast("long")


def space_words(text: Column) -> Column:
    return count_matches(text, f"[^{SPACE}]+")


def token_count_proxy(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(space_words(text) * 4 / 3)).cast("long")


def token_count_tools(n_tools: Column) -> Column:
    return (n_tools * F.lit(TOKENS_PER_TOOL)).cast("long")


def words(text: Column) -> Column:
    """Lower-cased letter, digit and underscore runs in order."""
    return F.array_remove(F.split(F.lower(text), WORD_BREAK), "")


def word_set(text: Column, stop: tuple[str, ...] = ()) -> Column:
    found = words(text)
    if not stop:
        return F.array_distinct(found)
    return F.array_except(found, F.array(*[F.lit(w) for w in stop]))


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by white space."""
    parts = F.split(strip(text), f"(?<=[.!?])[{SPACE}]+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentence_key(sentence: Column, size: int | None = None) -> Column:
    """Its letters, digits and underscores, or the first ``size`` of them: equal keys mark
    near-equal sentences."""
    key = F.regexp_replace(F.lower(sentence), WORD_BREAK, "")
    return key if size is None else F.substring(key, 1, size)


def entities(text: Column) -> Column:
    """Distinct URLs, quantities, acronyms and proper names of two or more words."""
    found = F.regexp_extract_all(text, F.lit(f"({unicode_pattern(ENTITY_PATTERN)})"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, strip), lambda e: F.length(e) > 1))


def fact_density(text: Column) -> Column:
    hits = count_matches(text, unicode_pattern(FACT_PATTERN, ignore_case=True))
    size = F.greatest(space_words(text), F.lit(1)) * F.lit(0.1)
    return F.least(F.lit(1.0), hits / F.greatest(size, F.lit(1.0)))


def intent_score(sentence: Column) -> Column:
    def score(n_words: Column) -> Column:
        hits = F.lit(0.0)
        for pattern, weight in INTENT_WEIGHTS:
            hits = hits + count_matches(sentence, unicode_pattern(pattern, True)) * F.lit(weight)
        bonus = F.when(n_words.between(8, 30), 1.0).when(n_words > 50, -1.0).otherwise(0.0)
        return F.when(n_words < 4, 0.0).otherwise(hits + bonus)

    return let(space_words(sentence), score)


def is_permanent(sentence: Column) -> Column:
    return sentence.rlike(unicode_pattern(PERMANENT_PATTERN, ignore_case=True))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two word sets; zero when either is empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / either)
