"""Plans from a JSON file or from base64-encoded JSON."""

from __future__ import annotations

import base64
import binascii
import json
from pathlib import Path

from planloom.plans.model import Plan, PlanError


def plan_from_file(path: str | Path) -> Plan:
    return _parse(Path(path).read_text(encoding="utf-8"), str(path))


def plan_from_base64(text: str) -> Plan:
    try:
        document = base64.b64decode(text, validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError) as error:
        raise PlanError("inline plan is not base64-encoded UTF-8") from error
    return _parse(document, "inline plan")


def _parse(document: str, origin: str) -> Plan:
    try:
        data = json.loads(document)
    except json.JSONDecodeError as error:
        # The position only: the document may hold credentials.
        raise PlanError(f"{origin}: not JSON (line {error.lineno}, column {error.colno})") from None
    if not isinstance(data, dict):
        raise PlanError(f"{origin}: a plan is a JSON object")
    return Plan.from_dict(data)
