"""Code-set functions: normalisation, prefix matching, labels and buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col_of, regex_escape

# ---------------------------------------------------------------------------
# Must equal the published cohort definitions.
# ICD-9 prefixes per category (after dots are removed and leading zeros
# stripped).
MENTAL_HEALTH_CODES: dict[str, list[str]] = {
    "depression": ["2962", "2963", "311"],
    "bipolar": ["2964", "2965", "2966", "2967"],
    "anxiety": ["3000", "3002", "3003"],
    "ptsd": ["30981"],
    "psychotic": ["295", "297", "298"],
    "personality": ["301"],
    "substance_use": ["303", "304", "305"],
}
CHRONIC_PAIN_CODES: dict[str, list[str]] = {
    "chronic_pain_general": ["3382", "3384"],
    "back_pain": ["724"],
    "arthritis": ["714", "715"],
    "fibromyalgia": ["7291"],
    "migraine": ["346"],
    "headache": ["7840"],
    "diabetic_neuropathy": ["2506", "3572"],
}
# Insurance text -> group; first rule whose substring occurs (upper case) wins.
INSURANCE_RULES: list[tuple[str, list[str]]] = [
    ("Medicare", ["MEDICARE"]),
    ("Medicaid", ["MEDICAID"]),
    ("Private", ["PRIVATE", "COMMERCIAL", "HMO"]),
    ("Government", ["GOVERNMENT"]),
    ("Self Pay", ["SELF PAY"]),
]
INSURANCE_DEFAULT = "Other"
INSURANCE_MISSING = "UNKNOWN"
# Run tag -> model family; first rule whose substring occurs (lower case) wins.
MODEL_TAG_RULES: list[tuple[str, list[str]]] = [
    ("RF+XGB", ["tabular_rf_xgb"]),
    ("Logistic Regression", ["tabular_logreg"]),
    ("ClinicalBERT", ["clinicalbert"]),
    ("Transformer", ["transformer"]),
    ("GRU", ["gru"]),
    ("LSTM", ["lstm"]),
    ("TF-IDF", ["tfidf"]),
    ("Meta-Learner", ["stacker_multiclass"]),
]
MODEL_TAG_DEFAULT = "Other"
# Model-name clean-up: regex replacements applied in this order on the
# lower-cased name, then two literal replacements, then strip.
MODEL_NAME_RULES: list[tuple[str, str]] = [
    ("stacker_", "stack_"),
    ("clinicalbert_transformer", "Clinicalbert"),
    ("_multiclass", ""),
    ("gru", "GRU"),
    ("lstm", "LSTM"),
    ("tfidf", "TF-IDF"),
    ("transformer", "Transformer"),
    ("tabular_xgb", "XGBoost"),
    ("tabular_rf", "Random Forest"),
]
MODEL_NAME_LITERALS: list[tuple[str, str]] = [
    ("Clinicalbert", "ClinicalBERT "),
    ("stack_", "Stacked "),
]
# ---------------------------------------------------------------------------


def all_prefixes(codes: Mapping[str, Sequence[str]]) -> list[str]:
    return sorted({p for ps in codes.values() for p in ps})


def normalize_code(c) -> Column:
    """Remove dots, then strip leading zeros (``296.20`` -> ``29620``)."""
    return F.regexp_replace(F.replace(col_of(c), F.lit("."), F.lit("")), r"^0+", "")


def prefix_regex(prefixes: Sequence[str]) -> str:
    return "^(?:" + "|".join(regex_escape(p) for p in prefixes) + ")"


def match_code_prefix(c, prefixes: Sequence[str], normalize: bool = True) -> Column:
    """True when the (normalised) code starts with any of ``prefixes``."""
    code = normalize_code(c) if normalize else col_of(c)
    return F.coalesce(code.rlike(prefix_regex(prefixes)), F.lit(False))


def label_multiclass(mh, pain) -> Column:
    """2 both, 1 pain only, 0 mental health only, -1 neither."""
    mh, pain = col_of(mh), col_of(pain)
    return (F.when(mh & pain, 2).when(pain, 1).when(mh, 0).otherwise(-1)).cast("int")


def label_binary_exclusive(pain, mh) -> Column:
    """1 pain only, 0 mental health only, -1 both or neither."""
    mh, pain = col_of(mh), col_of(pain)
    return (F.when(pain & ~mh, 1).when(mh & ~pain, 0).otherwise(-1)).cast("int")


def flag_co_occurrence(a, b) -> Column:
    return col_of(a) & col_of(b)


def flag_threshold(c, n: float = 5) -> Column:
    return (col_of(c) >= F.lit(n)).cast("int")


def bucket_by_substring(c, rules: Sequence[tuple[str, Sequence[str]]] = INSURANCE_RULES,
                        default: str = INSURANCE_DEFAULT, missing: str | None = INSURANCE_MISSING,
                        upper: bool = True) -> Column:
    """Ordered substring rules; the first matching rule's label wins."""
    x = col_of(c)
    if missing is not None:
        x = F.coalesce(x, F.lit(missing))
    x = F.upper(x) if upper else F.lower(x)
    expr = None
    for label, subs in rules:
        cond = None
        for s in subs:
            t = s.upper() if upper else s.lower()
            one = x.contains(t)
            cond = one if cond is None else (cond | one)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def bucket_model_tag(c, rules=MODEL_TAG_RULES, default: str = MODEL_TAG_DEFAULT) -> Column:
    x = F.coalesce(col_of(c).cast("string"), F.lit("nan"))
    return bucket_by_substring(x, rules, default, missing=None, upper=False)


def significance_stars(p) -> Column:
    """``***`` p<.001, ``**`` p<.01, ``*`` p<.05, else the value to 2 decimals."""
    p = col_of(p)
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")
            .otherwise(F.format_string("%.2f", p)))


def lookup_map(c, mapping: Mapping, keep_miss: bool = False) -> Column:
    """Dictionary lookup as a literal map; a miss gives null or the input."""
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    m = F.create_map(*kv)
    x = col_of(c)
    hit = F.try_element_at(m, x)
    return F.coalesce(hit, x.cast("string")) if keep_miss else hit


def normalize_model_name(c, rules=MODEL_NAME_RULES, literals=MODEL_NAME_LITERALS) -> Column:
    x = F.lower(col_of(c).cast("string"))
    for pat, rep in rules:
        x = F.regexp_replace(x, pat, rep)
    for a, b in literals:
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.trim(x)


def encode_binary(c, mapping: Mapping, miss=None) -> Column:
    """Map values to codes (``{'M': 1, 'F': 0}``); unknown -> ``miss``."""
    x = col_of(c)
    expr = None
    for k, v in mapping.items():
        expr = F.when(x == F.lit(k), F.lit(v)) if expr is None else expr.when(x == F.lit(k), F.lit(v))
    return expr.otherwise(F.lit(miss))


def extract_run_number(c, default: int | None = None) -> Column:
    """Digits after ``iter`` or ``run`` (``stacker_iter12`` -> 12)."""
    s = F.regexp_extract(col_of(c).cast("string"), r"(?:iter|run)(\d+)", 1)
    n = F.when(s == "", F.lit(None)).otherwise(s).cast("long")
    return F.coalesce(n, F.lit(default)) if default is not None else n


def format_metric(c, digits: int = 4) -> Column:
    return F.format_string(f"%.{int(digits)}f", col_of(c).cast("double"))
