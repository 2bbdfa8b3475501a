"""Keeping credentials out of reprs, logs and error messages."""

from __future__ import annotations

import re
from collections.abc import Mapping

MASK = "***"

_SECRET_NAME = re.compile(r"pass(word|wd)|pwd|secret|token|credential|accountkey|sas", re.IGNORECASE)

# `name=value` pairs and `//user:password@host` as they occur in JDBC and lake URIs.
_URI_PAIR = re.compile(
    r"(?P<name>\b(?:password|passwd|pwd|secret|accesstoken|token|sig)\s*=)[^;&?\s]*", re.IGNORECASE
)
_URI_USERINFO = re.compile(r"(?P<user>//[^/:@\s]+:)[^@/\s]+(?=@)")


def mask_options(options: Mapping[str, object]) -> dict[str, object]:
    """The same options with the value of every credential-like key masked."""
    return {
        key: MASK if _SECRET_NAME.search(key) else mask_text(value) if isinstance(value, str) else value
        for key, value in options.items()
    }


def mask_text(text: str | None) -> str | None:
    """A URI or message without the passwords, tokens and signatures it may carry."""
    if text is None:
        return None
    return _URI_USERINFO.sub(rf"\g<user>{MASK}", _URI_PAIR.sub(rf"\g<name>{MASK}", text))
