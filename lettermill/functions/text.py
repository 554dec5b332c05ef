"""Text expressions: cleaning, ids, scrubbing, markup."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of scrubbed values and names of fields that are always hidden (fixed values).
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD = r"\b\d{13,19}\b"
PHONE = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
SENSITIVE_KEYS = (
    "password", "passwd", "secret", "token", "api_key", "apikey", "authorization", "auth", "credential", "ssn", "credit_card", "card_number", "phone", "address", "first_name", "last_name",
)
MAX_VALUE = 100


def clean_body(text: str | Column) -> Column:
    """Without quoted lines, quoted originals and the signature; line ends trimmed, blank runs shortened. Null gives ''."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    lines = F.split(t, "\n", -1)
    stop = F.array_position(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", " "))), "-----Original Message-----")
    before = F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines)
    unquoted = F.array_join(F.filter(before, lambda x: ~x.startswith(">")), "\n")
    unsigned = F.substring_index(unquoted, "\n-- \n", 1)
    trimmed = F.array_join(F.transform(F.split(unsigned, "\n", -1), lambda x: F.regexp_replace(x, r"\s+$", "")), "\n")
    return F.regexp_replace(F.regexp_replace(trimmed, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def source_id(kind: str, key: Column) -> Column:
    """msg_, att_ or thr_ ids; thread ids are base64url without padding."""
    if kind == "thread":
        return F.concat(F.lit("thr_"), F.rtrim(F.translate(F.base64(key.cast("binary")), "+/", "-_"), F.lit("=")))
    return F.concat(F.lit({"message": "msg_", "attachment": "att_"}[kind]), key.cast("string"))


def source_key(sid: Column) -> Column:
    """The key in a source id."""
    body = F.substring(sid, 5, 1 << 20)
    return F.when(sid.startswith("thr_"), F.decode(F.unbase64(F.translate(body, "-_", "+/")), "UTF-8")).otherwise(body)


def embedding_text(subject: str, name: str, body: str, max_tokens: int = 7500) -> Column:
    """The text that is embedded, cut to its longest beginning of ``max_tokens`` estimated tokens; only longer texts go to Python."""
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    whole = F.concat(F.lit("Subject: "), part(subject), F.lit("\nFrom: "), part(name), F.lit("\n\n"), part(body))

    @F.pandas_udf("string")
    def beginning(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else t[: bisect_right(range(len(t) + 1), max_tokens, key=lambda n: _tokens(t[:n])) - 1])

    return F.coalesce(beginning(F.when(estimated_tokens(whole) > max_tokens, whole)), whole)


def _tokens(text: str) -> int:
    return len(text.encode()) // 4 + sum(len(u.encode()) for u in re.findall(r"https?://\S+", text)) // 2


def estimated_tokens(text: Column) -> Column:
    """A token for four bytes, and for every two bytes of links one more."""
    links = F.aggregate(F.regexp_extract_all(text, F.lit(r"https?://\S+"), F.lit(0)), F.lit(0), lambda s, u: s + F.octet_length(u))
    return F.floor(F.octet_length(text) / 4) + F.floor(links / 2)


def scrubbed(value: str | Column) -> Column:
    """E-mail addresses, social security numbers, card numbers with a right check digit and phone numbers are hidden, long values cut."""
    v = F.col(value) if isinstance(value, str) else value
    v = F.regexp_replace(F.regexp_replace(v, EMAIL, "[REDACTED-EMAIL]"), SSN, "[REDACTED-SSN]")
    cards = F.filter(F.array_distinct(F.regexp_extract_all(v, F.lit(CARD), F.lit(0))), lambda c: F.call_function("luhn_check", c))
    v = F.aggregate(cards, v, lambda s, c: F.regexp_replace(s, F.concat(F.lit(r"\b"), c, F.lit(r"\b")), F.lit("[REDACTED-CC]")))
    v = F.regexp_replace(v, PHONE, "[REDACTED-PHONE]")
    return F.when(F.length(v) > MAX_VALUE, F.concat(F.substring(v, 1, MAX_VALUE), F.lit("..."))).otherwise(v)


def scrubbed_map(fields: str | Column) -> Column:
    """A map of strings with sensitive fields hidden outright and the other values scrubbed."""
    return F.transform_values(fields, lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_KEYS), F.lit("[REDACTED]")).otherwise(scrubbed(v)))


def plain_text(body: str | Column, html: str | Column) -> Column:
    """The plain body where it says something, else the markup without its tags; white space collapsed at tags."""
    b, h = (F.col(c) if isinstance(c, str) else c for c in (body, html))
    return F.when(F.trim(F.coalesce(b, F.lit(""))) != "", b).otherwise(F.trim(F.regexp_replace(F.coalesce(h, F.lit("")), "<[^>]+>", " ")))


def evidence_text(body: str, html: str, size: int = 2000, excerpt: int = 300) -> Column:
    """text (cut), excerpt, start, end, sha256 of the excerpt."""
    text = F.substring(plain_text(body, html), 1, size)
    short = F.substring(text, 1, excerpt)
    return F.struct(text.alias("text"), short.alias("excerpt"), F.lit(0).alias("start"), F.length(short).alias("end"), F.sha2(short, 256).alias("sha256"))


def remote_references(html: str | Column) -> Column:
    return F.regexp_count(html, F.lit(r"(?i)src\s*=|background\s*=|url\s*\("))


def active_content(html: str | Column) -> Column:
    h = F.col(html) if isinstance(html, str) else html
    return h.rlike(r"(?i)<\s*(?:script|iframe|object|embed|form)\b") | h.rlike(r"(?i)\bon\w+\s*=")


def lenient_timestamp(text: str | Column) -> Column:
    """ISO dates and times; a date alone is midnight UTC, Z is understood, anything else null."""
    t = F.trim(text)
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")))


def label_list(header: str | Column) -> Column:
    """Labels of a comma-separated header."""
    return F.filter(F.transform(F.split(header, ","), lambda x: F.trim(x)), lambda x: x != "")
