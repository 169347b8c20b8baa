"""Masking, counting and pseudonymising personal data as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Placeholders and patterns that results depend on.
MENTION, URL, EMAIL, CPF, PHONE = "@usuario", "<url>", "<email>", "<cpf>", "<telefone>"
EMAIL_PATTERN = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"
URL_PATTERN = r"(?:https?://|www\.)[^\s\p{Z}\x1c-\x1f\x85]+"
CPF_PATTERN = r"(?<!\p{Nd})\p{Nd}{3}\.?\p{Nd}{3}\.?\p{Nd}{3}-?\p{Nd}{2}(?!\p{Nd})"
PHONE_PATTERN = r"(?<!\p{Nd})(?:\+?55[\s-]?)?\(?\p{Nd}{2}\)?[\s-]?9?\p{Nd}{4}[\s-]?\p{Nd}{4}(?!\p{Nd})"
MENTION_PATTERN = r"(?<![\p{L}\p{N}_@])@[\p{L}\p{N}_]+"
TEXT_COLUMNS = ("text", "text_normalized", "texto", "texto_normalizado")
TEXT_PREFIXES = ("top_example", "exemplo", "example")


def validate_cpf(value: Column) -> Column:
    """Eleven digits, not all equal, with both check digits right."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    d = F.transform(F.split(digits, ""), lambda c: c.cast("int"))

    def check(n: int) -> Column:
        total = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda a, i: a + F.element_at(d, i) * (n + 2 - i))
        rest = (total * 10) % 11
        return F.when(rest == 10, 0).otherwise(rest) == F.element_at(d, n + 1)

    shaped = (F.length(digits) == 11) & ~digits.rlike(r"^(\d)\1{10}$")
    return F.when(shaped, check(9) & check(10)).otherwise(F.when(value.isNull(), F.lit(None)).otherwise(False))


def mask_personal_data(t: Column, *, mask_mentions: bool = True) -> Column:
    """E-mail, URL, valid CPF, phone, mention, in this order."""
    t = F.regexp_replace(F.regexp_replace(t, EMAIL_PATTERN, EMAIL), URL_PATTERN, URL)
    found = F.array_distinct(F.filter(F.regexp_extract_all(t, F.lit(f"({CPF_PATTERN})"), F.lit(1)), lambda c: validate_cpf(c)))
    t = F.aggregate(found, t, lambda a, c: F.regexp_replace(a, F.concat(F.lit(r"(?<!\d)\Q"), c, F.lit(r"\E(?!\d)")), F.lit(CPF)))
    t = F.regexp_replace(t, PHONE_PATTERN, PHONE)
    return F.regexp_replace(t, MENTION_PATTERN, MENTION) if mask_mentions else t


def mask_text_columns(df: DataFrame) -> DataFrame:
    wanted = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and (f.name in TEXT_COLUMNS or f.name.startswith(TEXT_PREFIXES))]
    return df.withColumns({c: mask_personal_data(F.col(c)) for c in wanted}) if wanted else df


def count_personal_data(df: DataFrame, column: str) -> DataFrame:
    """One row: texts that hold each category, and texts; e-mails are taken out before mentions, URLs before phones."""
    t = F.col(column)
    no_mail = F.regexp_replace(t, EMAIL_PATTERN, " ")
    no_url = F.regexp_replace(t, URL_PATTERN, " ")
    mentions = F.filter(F.regexp_extract_all(no_mail, F.lit(f"({MENTION_PATTERN})"), F.lit(1)), lambda m: m != MENTION)
    cpfs = F.filter(F.regexp_extract_all(t, F.lit(f"({CPF_PATTERN})"), F.lit(1)), lambda c: validate_cpf(c))
    return df.agg(
        F.count_if(F.size(mentions) > 0).alias("mencao"), F.count_if(t.rlike(URL_PATTERN)).alias("url"), F.count_if(t.rlike(EMAIL_PATTERN)).alias("email"),
        F.count_if(F.size(cpfs) > 0).alias("cpf"), F.count_if(no_url.rlike(PHONE_PATTERN)).alias("telefone"), F.count(F.lit(1)).alias("total"),
    )


def pseudonymize_value(value: Column, key: bytes, *, length: int = 20) -> Column:
    """The first hex digits of HMAC-SHA256(key, value), with the pads computed once on the driver."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in block))
    inner = F.sha2(F.concat(pad(0x36), F.encode(value, "UTF-8")), 256)
    return F.substring(F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256), 1, length)


def pseudonymize_id(value: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), value.cast("string")), 256), 1, 16)
