"""Phone rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls as U
from .emails import SCRIPTS

# Fixed patterns: links, labelled numbers, and numbers in JSON-like keys.
LINK = r"(?is)tel:\s*([^\"'<>\s]+)"
LABELLED = r"(?is)(?:\b(?:tel(?:ephone)?|telefon|phone|hotline|mobile|mob|call us|call)\b\s*(?:[:=]|is|号码|电话)?\s*|tel:\s*)([+]?\d[\d\s()./\-]{5,}\d)"
KEYED = r"(?is)['\"]?(?:telephone|phone|tel|mobile|mob|contact_number|contactNumber)['\"]?\s*[:=]\s*['\"]?([+]?\d[\d\s()./\-]{5,}\d)"
# Numbers that are no phones.
SENTINELS = ("2147483647",)


def candidates(page: Column, decoded: Column) -> Column:
    """Candidate numbers of raw HTML and its decoded text, in order: visible ones, then embedded ones."""
    one = lambda x, p: F.regexp_extract_all(x, F.lit(p), F.lit(1))
    return F.concat(one(page, LINK), one(F.regexp_replace(decoded, SCRIPTS, " "), LABELLED), one(decoded, LINK), one(decoded, KEYED))


def normalized(value: Column) -> Column:
    """Digits with + for an international number; '' for what is no phone number."""
    plain = F.trim(F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value))
    v = F.regexp_replace(plain, r"(?i)^tel:\s*", "")
    v = F.regexp_replace(F.regexp_replace(v, r"(?s)[?#].*$", ""), r"(?is)(?:ext\.?|extension|durchwahl)\s*\d+.*$", "")
    v = F.regexp_replace(F.regexp_replace(v, r"\s+", " "), r"^[ ,.;]+|[ ,.;]+$", "")

    def number(x: Column) -> Column:
        plus = F.startswith(x, F.lit("+")) | F.startswith(x, F.lit("00"))
        digits = F.regexp_replace(x, r"\D", "")
        digits = F.when(plus, F.regexp_replace(digits, "^00", "")).otherwise(digits)
        return U.bind(F.struct(x.alias("v"), plus.alias("plus"), digits.alias("digits")), checked)

    def checked(x: Column) -> Column:
        digits, plus = x["digits"], x["plus"]
        bad = (
            x["v"].rlike(r"(?i)\bfax\b") | digits.isin("", *SENTINELS) | ~F.length(digits).between(7, 15) | digits.rlike(r"^(?:19|20)\d{11,}$")
            | ((F.length(digits) >= 13) & ~plus & ~F.startswith(digits, F.lit("0"))) | digits.rlike(r"^(\d)\1*$")
        )
        return F.when(bad, "").when(plus, F.concat(F.lit("+"), digits)).otherwise(digits)

    return U.bind(v, number)


def signature(phone: Column) -> Column:
    return F.regexp_replace(phone, r"\D", "")
