"""String functions: keyword matching, cleaning, word counts.

Word boundaries and whitespace are written as explicit Unicode classes instead
of ``\\b``/``\\s`` so that Spark (Java regex), DuckDB (RE2) and Python agree:
RE2's ``\\b``/``\\s`` are ASCII-only, Java's are ASCII-only without ``(?U)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of, regex_escape

# ---------------------------------------------------------------------------
# Keyword lists of the cohort definitions.
PSYCH_MEDICATIONS = [
    "prozac", "sertraline", "zoloft", "fluoxetine", "paroxetine", "citalopram", "escitalopram",
    "venlafaxine", "duloxetine", "bupropion", "amitriptyline", "nortriptyline", "trazodone",
    "olanzapine", "risperidone", "quetiapine", "aripiprazole", "haloperidol", "lithium",
    "diazepam", "lorazepam", "alprazolam", "clonazepam", "buspirone",
]
PAIN_MEDICATIONS = [
    "morphine", "oxycodone", "hydrocodone", "fentanyl", "codeine", "tramadol",
    "gabapentin", "pregabalin", "lidocaine", "methadone", "buprenorphine",
    "ibuprofen", "naproxen", "celecoxib", "diclofenac",
]
PAIN_CONDITION_KEYWORDS = [
    "chronic", "pain", "arthritis", "osteoarthritis", "rheumatoid",
    "fibromyalgia", "migraine", "neuropathy", "neuralgia",
    "sciatica", "back pain", "neck pain", "spinal", "fracture",
    "injury", "burn", "wound", "trauma", "sprain", "strain",
    "tendon", "ligament", "joint", "osteoporosis", "gout",
    "lupus", "paralysis", "amputation", "surgery", "postoperative", "whiplash",
]
PAIN_MED_KEYWORDS = [
    "opioid", "acetaminophen", "ibuprofen", "gabapentin", "morphine",
    "tramadol", "oxycodone", "hydrocodone", "meperidine", "fentanyl",
    "pregabalin", "naproxen",
]
NOTE_TEMPLATE_PHRASES = ["dictated by", "signed electronically"]
NOTE_CATEGORIES = ["Discharge summary", "Nursing", "Physician"]
ICU_UNIT_PATTERN = "ICU|CCU|MICU|SICU"
# ---------------------------------------------------------------------------

# Python's str.isspace() set, written out so every engine uses the same one.
WS_CLASS = (r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
WORD_CHAR = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def keyword_regex(words: Sequence[str], escape: bool = True) -> str:
    alts = "|".join(regex_escape(w.lower()) if escape else w.lower() for w in words)
    return f"(?:^|{NON_WORD})(?:{alts})(?:{NON_WORD}|$)"


def match_keywords(c, words: Sequence[str]) -> Column:
    """Whole-word match of any keyword in the lower-cased text (null -> False)."""
    return F.coalesce(F.lower(col_of(c)).rlike(keyword_regex(words)), F.lit(False))


def match_keywords_escaped(c, phrases: Sequence[str]) -> Column:
    """Same as :func:`match_keywords`; phrases may hold spaces/punctuation."""
    return match_keywords(c, phrases)


def flag_contains(c, pattern: str, case_insensitive: bool = False, upper: bool = False) -> Column:
    """Regex containment; ``upper`` upper-cases first; null -> False."""
    x = col_of(c)
    if upper:
        x = F.upper(x)
    pat = ("(?i)" + pattern) if case_insensitive else pattern
    return F.coalesce(x.rlike(pat), F.lit(False))


def clean_text(c) -> Column:
    """lower; collapse whitespace; ``_+`` -> space; drop ``[**``/``**]``; strip."""
    x = F.lower(col_of(c))
    x = F.regexp_replace(x, WS_CLASS + "+", " ")
    x = F.regexp_replace(x, "_+", " ")
    x = F.replace(x, F.lit("[**"), F.lit(""))
    x = F.replace(x, F.lit("**]"), F.lit(""))
    return F.regexp_replace(x, f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def words(c) -> Column:
    """Whitespace-separated words (Python ``str.split()``)."""
    return F.filter(F.split(col_of(c), WS_CLASS + "+"), lambda w: w != "")


def count_words(c) -> Column:
    return F.size(words(c)).cast("long")


def tokens(c) -> Column:
    """Word tokens of two or more letters/digits/underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(col_of(c)), F.lit(f"({TOKEN_PATTERN})"), 1)


def truncate_text(c, n: int = 10000) -> Column:
    return F.substring(col_of(c), 1, int(n))


def drop_templates(c, phrases: Sequence[str] = NOTE_TEMPLATE_PHRASES) -> Column:
    """True when the text contains none of the phrases (case-insensitive)."""
    pat = "|".join(regex_escape(p.lower()) for p in phrases)
    return ~F.coalesce(F.lower(col_of(c)).rlike(pat), F.lit(False))
