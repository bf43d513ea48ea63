"""Tolerant readers of written answers and hints."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys that wrap a list in an answer, and the labels of a written lead with their fields.
WRAPPERS = ("facts", "leads", "results", "items", "data")
LABELS = {"TITLE:": "title", "PATTERN:": "observed_pattern", "RATIONALE:": "rationale", "FILES:": "affected_files", "CONFIDENCE:": "confidence"}


def without_fences(text: str) -> str:
    """The text with the marks and headers of code fences taken off, their contents kept."""
    return re.sub(r"```[^\n]*\n?", "", text).strip()


def _first_balanced(text: str) -> str | None:
    """The first balanced array or object, brackets in strings not counted."""
    for m in re.finditer(r"[\[{]", text):
        try:
            _, end = json.JSONDecoder().raw_decode(text, m.start())
            return text[m.start() : end]
        except ValueError:
            continue
    return None


def extract_json_array(text: str | None) -> list:
    """The list an answer holds: fenced, wrapped under a common key, in a chat envelope, or amid prose.

    A single object counts as a list of one; an answer without any is the empty list.
    """
    body = without_fences(text or "")
    try:
        value = json.loads(body)
    except ValueError:
        found = _first_balanced(body)
        if found is None:
            return []
        value = json.loads(found)
    if isinstance(value, str):
        return extract_json_array(value) if value != body else []
    if isinstance(value, list):
        return value
    if isinstance(value, dict):
        for key in WRAPPERS:
            if isinstance(value.get(key), list):
                return value[key]
            if isinstance(value.get(key), str):
                return extract_json_array(value[key])
        choices = value.get("choices")
        if isinstance(choices, list) and choices and isinstance(choices[0], dict):
            message = choices[0].get("message")
            inner = message.get("content") if isinstance(message, dict) else choices[0].get("text")
            if isinstance(inner, str):
                return extract_json_array(inner)
        return [value]
    return []


def labelled_lead(text: str | None) -> dict:
    """Fields of a lead written under labels; a label that comes again overrides, other lines go on with the last one."""
    held: dict[str, list[str]] = {}
    now = None
    for line in (text or "").splitlines():
        bare = line.lstrip("*# ")
        label = next((k for k in LABELS if bare.startswith(k)), None)
        if label:
            now = LABELS[label]
            held[now] = [bare[len(label) :].strip()]
        elif now and line.strip():
            held[now].append(line.strip())
    joined = {k: "\n".join(x for x in v if x).strip() or None for k, v in held.items()}
    files = [f.strip().lstrip("-").strip() for f in re.split(r"[,\n]", joined.get("affected_files") or "")]
    try:
        confidence = float(joined.get("confidence") or "")
    except ValueError:
        confidence = None
    return {"title": joined.get("title"), "observed_pattern": joined.get("observed_pattern"), "rationale": joined.get("rationale"), "affected_files": [f for f in files if f] or None, "confidence": confidence}


def hinted_end(hint: Column, occurred: Column) -> Column:
    """End of validity a hint gives: 'this sprint' is fourteen days; anything else leaves it open."""
    return F.when(F.lower(F.trim(hint)) == "this sprint", occurred + F.expr("INTERVAL 14 DAYS"))
