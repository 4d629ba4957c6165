"""Matcher operators: (name, value, params) -> boolean column, by a registry that users can extend.

A matcher reads the field's name or its value; which one is the operator's own choice, whatever target
the rule declares (``keyword_contains`` reads the value unless ``fields`` holds "name"). With intended
semantics the declared target decides. Null values miss.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.text import digits, id_card_valid, let, luhn, normalised, normalised_text

MAX_PATTERN = 512
MIN_DOUBLE = 5e-324  # the least positive double: without ``min`` zero and negative values miss


class Field:
    """A field under test: its name and value as columns, normal forms built once."""

    def __init__(self, name: Column, value: Column, semantics: str = "reference", target: str = "field_value"):
        self.name, self.value, self.semantics, self.target = name, value.cast("string"), semantics, target
        self.plain_name, self.plain_value = normalised(name), normalised(self.value)

    @classmethod
    def bound(cls, b: Column | dict[str, Column], semantics: str = "reference", target: str = "field_value") -> Field:
        """From a struct<name, value, plain_name, plain_value>, or columns by these names, evaluated elsewhere."""
        f = cls.__new__(cls)
        f.name, f.value, f.plain_name, f.plain_value, f.semantics, f.target = b["name"], b["value"], b["plain_name"], b["plain_value"], semantics, target
        return f


Operator = Callable[[Field, dict], Column]
REGISTRY: dict[str, Operator] = {}


def register(name: str, operator: Operator | None = None):
    """Add an operator, directly or as a decorator."""
    if operator is None:
        return lambda f: register(name, f)
    REGISTRY[name] = operator
    return operator


def get(name: str) -> Operator | None:
    return REGISTRY.get(name)


def has(name: str) -> bool:
    return name in REGISTRY


def names() -> list[str]:
    return sorted(REGISTRY)


def as_bool(value: object, default: bool) -> bool:
    if isinstance(value, bool):
        return value
    return value.strip().lower() == "true" if isinstance(value, str) else default


def as_number(value: object, default: float | None, kind: type = float):
    try:
        return kind(value) if value is not None and not isinstance(value, bool) else default
    except (TypeError, ValueError):
        return default


def as_list(value: object) -> list[str]:
    if value is None:
        return []
    return [str(v) for v in value] if isinstance(value, (list, tuple, set)) else [str(value)]


def _any(hits: list[Column]) -> Column:
    out = F.lit(False)
    for h in hits:
        out = out | h
    return F.coalesce(out, F.lit(False))


def contains_any(subject: Column, words: list[str]) -> Column:
    """Whether any word occurs; words that hold another of the list add nothing and are left out. In a subject of
    single-byte characters only the words of such characters are looked for."""
    least = list(dict.fromkeys(w for w in words if not any(o != w and o in w for o in words)))
    wide = [w for w in least if not w.isascii()]
    hits = [F.contains(subject, F.lit(w)) for w in least if w.isascii()]
    return _any([*hits, (F.octet_length(subject) > F.length(subject)) & _any([F.contains(subject, F.lit(w)) for w in wide])] if wide else hits)


@functools.cache
def valid(pattern: str) -> bool:
    """Whether the engine's own dialect, that of ``rlike``, accepts a pattern."""
    try:
        SparkContext.getOrCreate()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def found(pattern: str, text: str) -> bool:
    """Whether a valid pattern occurs in a text known while the plan is built."""
    return SparkContext.getOrCreate()._jvm.java.util.regex.Pattern.compile(pattern).matcher(text).find()


def glob(pattern: str) -> str:
    """A glob of ``*`` and ``?`` as a regular expression; all else is literal."""
    return "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern)


@register("regex")
def regex(f: Field, params: dict) -> Column:
    pattern = str(params.get("pattern") or "")
    if not pattern or len(pattern) > MAX_PATTERN or not valid(pattern):
        return F.lit(False)
    flag = "(?i)" if as_bool(params.get("case_insensitive"), False) else ""
    return F.coalesce(f.value.rlike(flag + pattern), F.lit(False))


def _reads_name(f: Field, params: dict) -> bool:
    return "name" in as_list(params.get("fields")) or f.semantics == "intended" and f.target == "field_name"


@register("keyword_contains")
def keyword_contains(f: Field, params: dict) -> Column:
    """Substring tests over the normal form, which is made once for all rules; a byte search each beats
    one alternation, which java.util.regex tries word by word at every character."""
    words = [w for k in as_list(params.get("keywords")) if (w := normalised_text(k))]
    subject = f.plain_name if _reads_name(f, params) else f.plain_value
    if f.semantics == "intended" and as_bool(params.get("use_word_boundaries"), False):
        return _any([F.lower(f.name if _reads_name(f, params) else f.value).rlike("|".join(rf"\b{re.escape(w)}\b" for w in words))]) if words else F.lit(False)
    return contains_any(subject, words)


@register("keyword_equals")
def keyword_equals(f: Field, params: dict) -> Column:
    words = [normalised_text(k) for k in as_list(params.get("keywords"))]
    return F.coalesce(f.plain_value.isin(words), F.lit(False)) if words else F.lit(False)


@register("prefix")
def prefix(f: Field, params: dict) -> Column:
    return _any([F.startswith(f.value, F.lit(p)) for p in as_list(params.get("prefixes"))])


@register("suffix")
def suffix(f: Field, params: dict) -> Column:
    return _any([F.endswith(f.value, F.lit(p)) for p in as_list(params.get("suffixes"))])


@register("length_range")
def length_range(f: Field, params: dict) -> Column:
    return F.coalesce(F.length(f.value).between(as_number(params.get("min"), 0, int), as_number(params.get("max"), 2**31 - 1, int)), F.lit(False))


@register("id_card_checksum")
def id_card_checksum(f: Field, params: dict) -> Column:
    return id_card_valid(f.value)


@register("medical_card_checksum")
def medical_card_checksum(f: Field, params: dict) -> Column:
    return F.coalesce(let(digits(f.value), lambda d: F.length(d).between(8, 12) & luhn(d)), F.lit(False))


@register("luhn_checksum")
def luhn_checksum(f: Field, params: dict) -> Column:
    """At least 13 digits; intended semantics apply ``min_length`` and ``max_length`` too."""
    lo, hi = 13, 2**31 - 1
    if f.semantics == "intended":
        lo, hi = as_number(params.get("min_length"), lo, int), as_number(params.get("max_length"), hi, int)
    return F.coalesce(let(digits(f.value), lambda d: F.length(d).between(lo, hi) & luhn(d)), F.lit(False))


@register("icd10_range")
def icd10_range(f: Field, params: dict) -> Column:
    """Codes between bounds in text order, either end open. Intended semantics also read ``intervals``
    and compare the category part of the code."""
    plain = lambda s: re.sub("[^A-Z0-9]", "", str(s or "").upper())
    code = F.regexp_replace(F.upper(f.value), "[^A-Z0-9]", "")
    ranges = [(plain(r.get("from")), plain(r.get("to"))) for r in params.get("ranges") or ()]
    if f.semantics == "intended":
        ranges += [(plain(r.get("start")), plain(r.get("end"))) for r in params.get("intervals") or ()]
        code = F.substring(code, 1, 3)
    hits = []
    for lo, hi in ranges:
        if lo or hi:
            hits.append((code >= lo if lo else F.lit(True)) & (code <= hi if hi else F.lit(True)) & (code != ""))
    return _any(hits)


@register("date_range")
def date_range(f: Field, params: dict) -> Column:
    pattern = str(params.get("pattern") or r"\d{4}[-/]\d{2}[-/]\d{2}")
    return F.coalesce(f.value.rlike(pattern), F.lit(False)) if valid(pattern) else F.lit(False)


@register("value_range")
def value_range(f: Field, params: dict) -> Column:
    lo = as_number(params.get("min"), MIN_DOUBLE if f.semantics == "reference" else float("-inf"))
    v = f.value.try_cast("double")
    return F.coalesce(v.between(lo, as_number(params.get("max"), 1.7976931348623157e308)) & ~F.isnan(v), F.lit(False))


@register("field_name_match")
def field_name_match(f: Field, params: dict) -> Column:
    hits = []
    for p in as_list(params.get("patterns")):
        hits.append(f.name.rlike("(?i)" + p) if valid(p) else F.contains(F.lower(f.name), F.lit(p.lower())))
    return _any(hits)


@register("contains_digit_ratio")
def contains_digit_ratio(f: Field, params: dict) -> Column:
    share = F.length(F.regexp_replace(f.value, r"[^\p{Nd}]", "")) / F.length(f.value)
    return F.coalesce((F.length(f.value) > 0) & (share >= as_number(params.get("threshold"), 0.5)), F.lit(False))


def intended(f: Field, name: str) -> Operator | None:
    """Aliases that the bundled packs use and only intended semantics know."""
    if f.semantics != "intended":
        return None
    return {"prefix_match": prefix, "email": lambda f, p: F.coalesce(f.value.rlike(r"^[\w.+-]+@[\w-]+\.[\w.]+$"), F.lit(False))}.get(name)
