"""Decision records in Markdown: files to typed rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.runtime import ship

# What makes a line of a record a constraint.
BINDING = ("must not", "must ", "shall not", "shall ", "required to", "is prohibited", "are prohibited", "never ", "always ", "cannot ", "may not")
FIELDS = "path string, adr_id string, title string, status string, date string, supersedes array<string>, mentions array<string>, decision string, constraints array<string>, errors array<string>"

_HEAD = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_ID = re.compile(r"^([A-Za-z]+[- ]?\d+|\d+)\s*[:.\-–]\s*(.+)$")
_LABEL = re.compile(r"^\s*(?:[-*]\s*)?\**(status|date|supersedes|superseded by)\**\s*:\s*\**\s*(.+?)\s*$", re.I)
_PATH = re.compile(r"`([\w./-]+\.[A-Za-z]\w{0,5})`")
_REF = re.compile(r"\b([A-Z]{2,4})[- ]?(\d+)\b")


def parse_record(path: str, text: str | None) -> dict:
    """One record: id and title from the first heading, sections by their headings' first words.

    Without an id in the heading the file name's number is the id. Fenced code holds no headings.
    Missing parts give an error entry, never an exception; a null text is an empty one.
    """
    out = {"path": path, "adr_id": None, "title": None, "status": None, "date": None, "supersedes": [], "mentions": [], "decision": None, "constraints": [], "errors": []}
    section, body, fenced = "", {}, False
    for line in (text or "").splitlines():
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        head = None if fenced else _HEAD.match(line)
        if head and len(head[1]) == 1 and out["title"] is None:
            found = _ID.match(head[2])
            out["adr_id"], out["title"] = (found[1].replace(" ", "-"), found[2]) if found else (None, head[2])
        elif head and len(head[1]) == 2:
            section = head[2].lower()
        else:
            label = None if fenced else _LABEL.match(line)
            if label and not section.startswith(("decision", "context", "consequence")):
                key = label[1].lower()
                if key == "supersedes":
                    out["supersedes"] += [f"{a}-{b}" for a, b in _REF.findall(label[2])]
                elif key in ("status", "date") and out[key] is None:
                    out[key] = label[2].strip("* ")
            body.setdefault(section, []).append(line)
    whole = {k: "\n".join(v).strip() for k, v in body.items()}
    named = lambda p: next((v for k, v in whole.items() if k.startswith(p)), None)
    status = named("status")
    if status and out["status"] is None:
        out["status"] = status.splitlines()[0].strip("*_ .")
        out["supersedes"] += [f"{a}-{b}" for line in status.splitlines() if line.lower().lstrip("-* ").startswith("supersedes") for a, b in _REF.findall(line)]
    out["decision"] = named("decision")
    if out["adr_id"] is None:
        number = re.match(r"(\d+)", path.rsplit("/", 1)[-1])
        out["adr_id"] = f"ADR-{int(number[1]):04d}" if number else None
    out["mentions"] = sorted(set(_PATH.findall(text or "")))
    for part in ("decision", "consequence"):
        for line in (named(part) or "").splitlines():
            line = line.strip("-* \t")
            if len(line.encode()) >= 10 and any(m in line.lower() for m in BINDING):
                out["constraints"].append(line)
    for key in ("adr_id", "title", "status", "decision"):
        if not out[key]:
            out["errors"].append(f"no {key}")
    out["supersedes"] = list(dict.fromkeys(out["supersedes"]))
    return out


def parse_records(files: DataFrame) -> DataFrame:
    """Rows of FIELDS for files (path, text), whole texts, in batches."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([parse_record(p, t) for p, t in zip(f["path"], f["text"])], columns=[c.split()[0] for c in FIELDS.split(", ")])

    return files.select("path", "text").mapInPandas(run, FIELDS)


def read_records(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """Records of a folder tree; files are listed by the reader and split among tasks. Files of no byte hold no record."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return parse_records(files.select("path", F.col("content").cast("string").alias("text")))
