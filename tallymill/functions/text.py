"""Small text rules as Columns: redaction, safe tokens and cells, grouping values, keys."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "[REDACTED]"
#: What is masked in any text, in this order.
SECRET_PATTERNS = (
    r"""(?i)\b(?:proxy[-_ ]?)?authorization\b\s*[:=]\s*(?:bearer\s+)?["']?[^\s,;"'}\]]+""",
    r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+",
    r"""(?i)["']?(?:api[_-]?key|access[_-]?token|refresh[_-]?token|client[_-]?secret|secret|cookie)["']?\s*[:=]\s*["']?[^\s,;"'}\]]+""",
    r"\b(?:sk-[A-Za-z0-9_-]{8,}|gh[pousr]_[A-Za-z0-9]{20,}|AIza[0-9A-Za-z_-]{20,})\b",
)
#: Keys whose entries are left out, in small letters and without separators.
SENSITIVE_KEYS = ("authorization", "proxyauthorization", "cookie", "setcookie", "apikey", "accesskey", "accesstoken", "refreshtoken", "secret", "clientsecret")
SECRET_WORDS = r"(?i)\b(?:proxy[-_ ]?)?authorization\b|\bbearer\b|\b(?:api[_-]?key|access[_-]?token|refresh[_-]?token|client[_-]?secret|cookie)\b|" + SECRET_PATTERNS[3]


def redact(text: Column, secrets: tuple[str, ...] = ()) -> Column:
    """Given secrets first, the longest before those that it holds; then what looks like one."""
    for secret in sorted(filter(None, secrets), key=lambda s: (-len(s), s)):
        text = F.replace(text, F.lit(secret), F.lit(MASK))
    for pattern in SECRET_PATTERNS:
        text = F.regexp_replace(text, pattern, MASK)
    return text


def redact_map(values: Column, secrets: tuple[str, ...] = ()) -> Column:
    """A map without its sensitive keys and with its values redacted."""
    kept = F.map_filter(values, lambda k, v: ~F.regexp_replace(F.lower(k), "[^a-z0-9]", "").isin(*SENSITIVE_KEYS))
    return F.transform_values(kept, lambda k, v: redact(v, secrets))


class _Number(str):
    """A JSON number as it was written."""


def _masked(text: str, secrets: list[str], patterns: list[re.Pattern]) -> str:
    for secret in secrets:
        text = text.replace(secret, MASK)
    for pattern in patterns:
        text = pattern.sub(MASK, text)
    return text


def _walked(value: object, mask) -> str:
    """JSON of a value with sensitive keys left out at any depth and strings masked; of keys that become equal the last one counts."""
    if isinstance(value, dict):
        kept = {mask(k): _walked(v, mask) for k, v in value.items() if re.sub("[^a-z0-9]", "", k.lower()) not in SENSITIVE_KEYS}
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{v}" for k, v in kept.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(_walked(v, mask) for v in value) + "]"
    if isinstance(value, _Number):
        return value
    return json.dumps(mask(value) if isinstance(value, str) else value, ensure_ascii=False)


def redact_json(text: Column, secrets: tuple[str, ...] = ()) -> Column:
    """A JSON text with the entries of sensitive keys left out at any depth, and strings and other keys masked as redact() masks text.

    Numbers, booleans and nulls stay as written, and what comes out is JSON. Of a key that stands twice in an object the
    last entry counts. Text that is no JSON (or is nested deeper than Python's parser goes) is masked as plain text; null
    stays null.
    """
    ordered = sorted(filter(None, secrets), key=lambda s: (-len(s), s))

    @F.pandas_udf("string")
    def walk(texts: pd.Series) -> pd.Series:
        patterns = [re.compile(p, re.ASCII) for p in SECRET_PATTERNS]
        mask = lambda t: _masked(t, ordered, patterns)

        def one(t: str | None) -> str | None:
            if t is None:
                return None
            try:
                return _walked(json.loads(t, parse_int=_Number, parse_float=_Number), mask)
            except (ValueError, RecursionError):
                return mask(t)

        return texts.map(one, na_action="ignore")

    return walk(text)


def safe_csv_cell(text: Column) -> Column:
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def safe_token(text: Column, most: int) -> Column:
    """The text if it is a short token of safe characters that doesn't look like a secret, else null."""
    return F.when(text.rlike(r"\A[A-Za-z0-9._:/@+=-]+\z") & (F.length(text) <= most) & ~text.rlike(SECRET_WORDS), text)


def attempt_count(n: Column) -> Column:
    return F.when(n.between(1, 2**31 - 1), n)


def provider_scope_key(provider: Column, url: Column) -> Column:
    """SHA-256 of the provider and the origin of its address; the origin of `mock` is `offline`.

    Null where the address is missing or is no absolute HTTP(S) address of a host, without a user's name or password.
    """
    name = F.lower(F.trim(provider))
    part = lambda k: F.try_parse_url(url, F.lit(k))
    safe = F.lower(part("PROTOCOL")).isin("http", "https") & part("HOST").isNotNull() & part("USERINFO").isNull()
    origin = F.when(name == "mock", F.lit("offline")).when(safe, F.lower(F.concat(part("PROTOCOL"), F.lit("://"), part("AUTHORITY"))))
    return F.sha2(F.concat(name, F.lit("\u0000"), origin), 256)


def fingerprint(canonical: Column) -> Column:
    return F.substring(F.sha2(canonical, 256), 1, 12)
