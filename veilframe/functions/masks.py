"""Masking and pseudonymisation as native expressions.

Lengths count code points. For text of the basic plane this is what UTF-16 units would give; a
supplementary character counts once here.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field kinds by what a lower-cased field name contains; the first hit wins.
FIELD_KINDS = (
    ("mobile", ("mobile", "phone")),
    ("id_card", ("id_card", "idcard", "身份证")),
    ("name", ("name", "姓名")),
    ("bank_card", ("bank", "card_no")),
    ("email", ("email", "mail", "邮箱")),
    ("address", ("address", "addr", "地址", "住址")),
)

# Keys whose values are redacted.
SENSITIVE_KEYS = (
    "id_card", "idcard", "identity", "mobile", "phone", "telephone", "email", "mail", "bank_card", "bankcard", "card_no",
    "password", "passwd", "secret", "token", "access_token", "refresh_token", "ssn", "social_security", "address", "addr",
    "name", "real_name", "fullname", "medical_record", "diagnosis",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def guess_field_type(name: str) -> str:
    low = name.lower()
    return next((kind for kind, words in FIELD_KINDS if any(w in low for w in words)), "default")


def mobile(c: Column | str) -> Column:
    c = _col(c)
    return F.when(F.length(c) == 11, F.concat(F.substring(c, 1, 3), F.lit("****"), F.substring(c, 8, 4))).otherwise(c)


def id_card(c: Column | str) -> Column:
    c = _col(c)
    return F.when(F.length(c) == 18, F.concat(F.substring(c, 1, 6), F.lit("*" * 8), F.substring(c, 15, 4))).otherwise(c)


def person_name(c: Column | str) -> Column:
    """Two characters keep the first; any other length keeps first and last around two stars."""
    c = _col(c)
    first = F.substring(c, 1, 1)
    return F.when(F.length(c) == 0, c).when(F.length(c) == 2, F.concat(first, F.lit("*"))).otherwise(F.concat(first, F.lit("**"), F.right(c, F.lit(1))))


def bank_card(c: Column | str) -> Column:
    c = _col(c)
    return F.when(F.length(c) >= 8, F.concat(F.substring(c, 1, 4), F.lit(" **** **** "), F.right(c, F.lit(4)))).otherwise(c)


def default(c: Column | str, prefix: int = 3, suffix: int = 3) -> Column:
    c = _col(c)
    stars = F.repeat(F.lit("*"), F.length(c) - (prefix + suffix))
    return F.when(F.length(c) > prefix + suffix, F.concat(F.left(c, F.lit(prefix)), stars, F.right(c, F.lit(suffix)))).otherwise(c)


def email(c: Column | str) -> Column:
    c = _col(c)
    at = F.instr(c, "@")
    return F.when(F.length(c) == 0, c).when(at <= 1, default(c, 2, 2)).otherwise(F.concat(F.substring(c, 1, 1), F.lit("***"), F.substr(c, at)))


def address(c: Column | str) -> Column:
    c = _col(c)
    return F.when(F.length(c) > 6, F.concat(F.substring(c, 1, 6), F.lit("***"))).otherwise(c)


def truncate(c: Column | str, keep: int) -> Column:
    c = _col(c)
    return F.when(F.length(c) > keep, F.concat(F.left(c, F.lit(keep)), F.lit("***"))).otherwise(c)


def redact(c: Column | str, keep: int = 8) -> Column:
    """Never null: null and empty give the empty string."""
    c = F.coalesce(_col(c), F.lit(""))
    if keep <= 0:
        return F.when(c == "", c).otherwise(F.lit("***"))
    return F.when(c == "", c).otherwise(F.concat(F.left(c, F.lit(keep)), F.lit("***")))


def full_mask() -> Column:
    return F.lit("[REDACTED]")


def redact_for_log(c: Column | str) -> Column:
    return redact(c, 8)


def hmac_token(c: Column | str, salt: str | bytes) -> Column:
    """The first 16 characters of base64(HMAC-SHA256(salt, value)).

    The two key pads are literals, so the token is two native hashes a row and equal values of two
    tables can be joined on it. An empty salt is no key: ValueError. Null stays null.
    """
    key = salt.encode() if isinstance(salt, str) else salt
    if not key:
        raise ValueError("the salt is empty")
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(_col(c), "utf-8")), 256))
    return F.substring(F.base64(F.unhex(F.sha2(F.concat(outer, digest), 256))), 1, 16)


MASKS = {"mobile": mobile, "id_card": id_card, "name": person_name, "bank_card": bank_card, "email": email, "address": address, "default": default}


def mask_value(field: str, c: Column | str) -> Column:
    """The mask that the field's name asks for, chosen while the plan is built."""
    return MASKS[guess_field_type(field)](c)


def mask_by_name(name: Column | str, value: Column | str) -> Column:
    """The same choice a row at a time, for (name, value) rows."""
    low, out = F.lower(_col(name)), None
    for kind, words in FIELD_KINDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, MASKS[kind](value)) if out is None else out.when(hit, MASKS[kind](value))
    return out.otherwise(default(value))


def mask_record(df: DataFrame, columns: list[str] | None = None, null_as_empty: bool = False) -> DataFrame:
    """Every string column (or those of ``columns``) masked by its name; other columns and the column
    order stay."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns):
            c = mask_value(f.name, F.coalesce(c, F.lit("")) if null_as_empty else c)
        out.append(c.alias(f.name))
    return df.select(*out)


def mask_dataframe(df: DataFrame, columns: list[str] | None = None, semantics: str = "reference") -> DataFrame:
    """Reference semantics mask every string column whatever ``columns`` says and turn null into "";
    intended semantics mask ``columns`` only."""
    return mask_record(df, None if semantics == "reference" else columns, null_as_empty=True)


def mask_map(c: Column | str) -> Column:
    """A map of fields, each masked by its key."""
    return F.transform_values(_col(c), lambda k, v: mask_by_name(k, v))


def mask_batch(names: Column | str, values: Column | str) -> Column:
    """Values masked by the names beside them, as far as the shorter array goes."""
    names, values = _col(names), _col(values)
    n = F.least(F.size(names), F.size(values))
    return F.zip_with(F.slice(names, F.lit(1), n), F.slice(values, F.lit(1), n), lambda k, v: mask_by_name(k, v))


def _plain_key(name: str) -> str:
    return name.lower().replace("_", "").replace("-", "")


def is_sensitive_key(name: str, keys: tuple[str, ...] = SENSITIVE_KEYS) -> bool:
    return any(_plain_key(k) in _plain_key(name) for k in keys)


def redact_record(df: DataFrame, keys: tuple[str, ...] = SENSITIVE_KEYS, keep: int = 8) -> DataFrame:
    """String columns with sensitive names redacted."""
    return df.select(*(redact(f"`{f.name}`", keep).alias(f.name) if isinstance(f.dataType, T.StringType) and is_sensitive_key(f.name, keys) else F.col(f"`{f.name}`") for f in df.schema))


def redact_map(c: Column | str, keys: tuple[str, ...] = SENSITIVE_KEYS, keep: int = 8) -> Column:
    """The values under sensitive keys of a map redacted."""

    def each(k: Column, v: Column) -> Column:
        plain, hit = F.regexp_replace(F.lower(k), "[_-]", ""), F.lit(False)
        for key in keys:
            hit = hit | F.contains(plain, F.lit(_plain_key(key)))
        return F.when(hit & v.isNotNull(), redact(v, keep)).otherwise(v)

    return F.transform_values(_col(c), each)
