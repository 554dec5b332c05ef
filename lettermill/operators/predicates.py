"""Filters as Column expressions: Catalyst pushes them to the scan."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARMS = ("to", "cc", "bcc")


def _arm(name: str) -> Column:
    return F.coalesce(F.col(f"recipients.{name}"), F.array().cast("array<string>"))


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def holds(column: Column, text: str) -> Column:
    """Substring, without regard to case; no wildcard is special."""
    return F.lower(column).contains(text.lower())


def in_range(date: Column, after: Any = None, before: Any = None) -> Column:
    """Half-open [after, before); a null date is in no bounded range."""
    return all_of([date >= F.lit(after).cast("timestamp")] * (after is not None) + [date < F.lit(before).cast("timestamp")] * (before is not None))


def received_by(address: str) -> Column:
    return any_of([F.array_contains(_arm(a), address) for a in ARMS])


def n_recipients() -> Column:
    return sum((F.size(_arm(a)) for a in ARMS), F.lit(0))


def message_filter(*, sender: str | None = None, sender_domain: str | None = None, recipient: str | None = None, after: Any = None, before: Any = None, has_attachment: bool | None = None, subject_contains: str | None = None, labels: list[str] | None = None, max_to: int | None = None, max_cc: int | None = None, max_recipients: int | None = None, direct_only: bool = False) -> Column:
    """The fixed message filters, AND between them; ``direct_only`` is one To and no Cc and excludes the two limits."""
    if direct_only:
        if max_to is not None or max_cc is not None:
            raise ValueError("direct_only cannot be combined with max_to or max_cc")
        max_to, max_cc = 1, 0
    parts = [in_range(F.col("date"), after, before)]
    if sender is not None:
        parts.append(F.col("sender_address") == sender)
    if sender_domain is not None:
        parts.append(F.col("sender_domain") == sender_domain)
    if recipient is not None:
        parts.append(received_by(recipient))
    if has_attachment is not None:
        parts.append(F.col("has_attachment") == has_attachment)
    if subject_contains is not None:
        parts.append(holds(F.col("subject"), subject_contains))
    if labels:
        parts.append(F.col("labels").isNotNull() & (F.size(F.array_except(F.array(*map(F.lit, labels)), F.col("labels"))) == 0))
    parts += [F.size(_arm("to")) <= max_to] * (max_to is not None) + [F.size(_arm("cc")) <= max_cc] * (max_cc is not None) + [n_recipients() <= max_recipients] * (max_recipients is not None)
    return all_of(parts)


def of_account(mails: DataFrame, accounts: DataFrame, account: str) -> DataFrame:
    """Messages attributed to an account, also those first seen in another."""
    return mails.join(accounts.filter(F.col("source_account") == account).select(F.col("email_id").alias("id")), "id", "left_semi")


def mentions(text: str) -> Column:
    return F.coalesce(holds(F.col("body_text"), text), F.lit(False)) | F.coalesce(holds(F.col("subject"), text), F.lit(False))


def scope_filter(*, date_from: Any = None, date_to: Any = None, mailboxes: list[str] | None = None, senders: list[str] | None = None, recipients: list[str] | None = None, participants: list[str] | None = None, subject: str | None = None, has_attachment: bool | None = None) -> Column:
    """Several values a field are alternatives; fields are ANDed."""
    given = lambda values: F.array(*map(F.lit, values))
    got = lambda values: any_of([F.arrays_overlap(_arm(a), given(values)) for a in ARMS])
    parts = [in_range(F.col("date"), date_from, date_to)]
    if mailboxes:
        parts.append(F.col("source_account").isin(mailboxes))
    if senders:
        parts.append(F.col("sender_address").isin(senders))
    if recipients:
        parts.append(got(recipients))
    if participants:
        parts.append(F.col("sender_address").isin(participants) | got(participants))
    if subject:
        parts.append(holds(F.col("subject"), subject))
    if has_attachment is not None:
        parts.append(F.col("has_attachment") == has_attachment)
    return all_of(parts)


def content_family(content_type: Column) -> Column:
    """pdf, image, spreadsheet, document, text or other (null too)."""
    t = F.lower(content_type)
    starts = lambda *names: any_of([t.startswith(n) for n in names])
    office = "application/vnd.openxmlformats-officedocument."
    return (
        F.when(starts("application/pdf"), "pdf")
        .when(starts("image/"), "image")
        .when(starts(office + "spreadsheetml", "application/vnd.ms-excel", "text/csv"), "spreadsheet")
        .when(starts(office + "wordprocessingml", "application/msword", office + "presentationml", "text/html"), "document")
        .when(starts("text/plain"), "text")
        .otherwise("other")
    )


def order_by(order: str, key: str = "id") -> list[Column]:
    """The four validated orders, each with the key as a tie-break; null places are spelled out."""
    ways = {
        "date DESC": lambda: [F.col("date").desc_nulls_last(), F.col(key).asc()],
        "date ASC": lambda: [F.col("date").asc_nulls_first(), F.col(key).asc()],
        "sender_address ASC": lambda: [F.col("sender_address").asc_nulls_last(), F.col(key).asc()],
        "sender_address DESC": lambda: [F.col("sender_address").desc_nulls_first(), F.col(key).asc()],
    }
    if order not in ways:
        raise ValueError(f"order must be one of {sorted(ways)}")
    return ways[order]()


def keyset_after(date: Any, key: Any, *, descending: bool = False, date_col: str = "date", key_col: str = "id") -> Column:
    """Rows after a cursor of (date, key), dates null last in both directions; a null date in the cursor is among those last rows."""
    d, k = F.col(date_col), F.col(key_col)
    later = (lambda c, v: c < v) if descending else (lambda c, v: c > v)
    if date is None:
        return d.isNull() & later(k, F.lit(key))
    at = F.lit(date).cast("timestamp")
    return later(d, at) | ((d == at) & later(k, F.lit(key))) | d.isNull()
