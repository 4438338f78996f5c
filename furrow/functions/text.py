"""Text columns: case/whitespace helpers, intent routing, parameter extraction,
vocabulary matching, sentence splitting and prompt assembly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Intent keywords (matched as substrings of the lower-cased text).
CROP_KEYWORDS = ["what crop", "which crop", "predict crop", "suggest crop", "recommend crop",
                 "best crop", "suitable crop", "crop recommendation"]
FERT_KEYWORDS = ["fertilizer", "fertiliser", "fertilisers", "fertilizers", "manure", "npk",
                 "urea", "dap", "recommend fertilizer", "which fertilizer"]
YIELD_KEYWORDS = ["yield", "production", "tonnes per hectare", "t/ha", "how much will i get",
                  "expected output", "harvest estimate", "crop output"]
PREDICT_WORD = "predict"

# Parameter patterns, tried in order (first hit wins), and defaults.
PARAM_PATTERNS = [
    ("N", [r"N\s*[=:]\s*([\d.]+)", r"nitrogen\s*[=:]\s*([\d.]+)"], 60.0),
    ("P", [r"P\s*[=:]\s*([\d.]+)", r"phosphorus\s*[=:]\s*([\d.]+)"], 40.0),
    ("K", [r"K\s*[=:]\s*([\d.]+)", r"potassium\s*[=:]\s*([\d.]+)"], 40.0),
    ("temperature", [r"temp\w*\s*[=:]\s*([\d.]+)", r"([\d.]+)\s*°?[cC]"], 25.0),
    ("humidity", [r"humid\w*\s*[=:]\s*([\d.]+)"], 65.0),
    ("ph", [r"ph\s*[=:]\s*([\d.]+)"], 6.5),
    ("rainfall", [r"rainfall\s*[=:]\s*([\d.]+)", r"rain\s*[=:]\s*([\d.]+)"], 100.0),
]
PARAM_FIELDS = [name for name, _, _ in PARAM_PATTERNS]

# Sentence boundary: whitespace after '.', '!' or '?'.
SENTENCE_SPLIT = r"(?<=[.!?])\s+"


def strip_ws(c: Column) -> Column:
    """Remove all leading/trailing whitespace (tabs and newlines too), like str.strip()."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def capitalize(c: Column) -> Column:
    """First character upper-cased, the rest lower-cased."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def preview(c: Column, n: int, ellipsis: str = "...") -> Column:
    """First n characters, with an ellipsis when the text is longer."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(ellipsis))).otherwise(c)


def _contains_any(lowered: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda k: F.contains(lowered, k))


def detect_intent(msg: Column) -> Column:
    """crop | fertilizer | yield | general, checked in that order."""
    low = F.lower(msg)
    has_predict = F.contains(low, F.lit(PREDICT_WORD))
    return (F.when(_contains_any(low, CROP_KEYWORDS), F.lit("crop"))
            .when(_contains_any(low, FERT_KEYWORDS) & has_predict, F.lit("fertilizer"))
            .when(_contains_any(low, YIELD_KEYWORDS) & has_predict, F.lit("yield"))
            .otherwise(F.lit("general")))


def _java_pattern(p: str, strict: bool) -> str:
    if strict:
        p = r"\b" + p
    return "(?i)" + p


def extract_param(msg: Column, patterns: list[str], default: float, strict: bool = False) -> Column:
    """First matching pattern wins; its group is parsed as a number.

    A pattern that matches but holds a malformed number (e.g. "6.5.1") gives
    NULL (an error), it does not fall through to the next pattern or the
    default. No match at all gives the default.
    """
    out = F.lit(float(default))
    for p in reversed(patterns):
        jp = _java_pattern(p, strict)
        out = F.when(msg.rlike(jp), F.regexp_extract(msg, jp, 1).try_cast("double")).otherwise(out)
    return out


def extract_params(msg: Column, strict: bool = False) -> Column:
    """STRUCT of the seven parameters (N, P, K, temperature, humidity, ph, rainfall)."""
    return F.struct(*[extract_param(msg, pats, d, strict).alias(name) for name, pats, d in PARAM_PATTERNS])


def params_error(params: Column) -> Column:
    """True when some matched parameter could not be parsed."""
    return F.exists(F.array(*[params[f] for f in PARAM_FIELDS]), lambda v: v.isNull())


def first_contained(msg: Column, vocab: list[str] | Column, strip_items: bool = False) -> Column:
    """First vocabulary item (in vocabulary order) contained in the lower-cased
    text, else the first item. ``vocab`` is a literal list or an array column.

    A literal list becomes a chain of branches that ends at the first hit and lower-cases the text once."""
    low = F.lower(msg)
    item_key = (lambda v: F.lower(strip_ws(v))) if strip_items else F.lower
    if isinstance(vocab, list):
        out = F.lit(vocab[0] if vocab else None).cast("string")
        hit = None
        for v in vocab:
            is_in = F.contains(low, item_key(F.lit(v)))
            hit = F.when(is_in, F.lit(v)) if hit is None else hit.when(is_in, F.lit(v))
        return out if hit is None else hit.otherwise(out)
    return first_keyed(low, F.transform(vocab, lambda v: F.struct(v.alias("v"), item_key(v).alias("key"))))


def first_keyed(low: Column, items: Column) -> Column:
    """``v`` of the first (v, key) of an array whose key the text ``low`` contains, else of the first one. ``low`` is read once an
    item: give a computed column, not an expression."""
    hits = F.filter(items, lambda p: F.contains(low, p["key"]))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.try_element_at(items, F.lit(1)))["v"]


def split_sentences(text: Column) -> Column:
    return F.split(strip_ws(text), SENTENCE_SPLIT)


def split_response(text: Column) -> Column:
    """STRUCT(summary, detail): <= 3 sentences -> (text, NULL); else first two / rest."""
    s = split_sentences(text)
    n = F.size(s)
    summary = F.when(n <= 3, text).otherwise(F.concat_ws(" ", F.slice(s, 1, 2)))
    detail = F.when(n <= 3, F.lit(None).cast(T.StringType())).otherwise(
        F.concat_ws(" ", F.slice(s, F.lit(3), n - 2)))
    return F.struct(summary.alias("summary"), detail.alias("detail"))
