"""Provenance of a run: required fields, completeness, and Markdown reports over small result tables."""

from __future__ import annotations

import datetime
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame

# The fields a complete provenance has.
REQUIRED = {
    "analysis": ["type", "description", "variant_type", "input_data_type", "input_data_description"],
    "cohort": ["name", "disease", "n_probands", "source", "repository", "accession", "data_access_url"],
    "knowledge_graph": ["name", "version", "doi_or_url", "export_query_file"],
    "pipeline": ["code_commit", "rules_version", "rules_file", "pipeline_log_file"],
    "attribution": ["analyst_name", "institution", "contact_email"],
}


def load(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    pipeline = data.get("pipeline") or {}
    return data | {"pipeline": pipeline | {"python_version": pipeline.get("python_version") or sys.version.split()[0]}}


def missing(data: dict) -> list[str]:
    """Required fields without a value, as ``section.field``."""
    return [f"{s}.{k}" for s, keys in REQUIRED.items() for k in keys if not isinstance(data.get(s), dict) or data[s].get(k) is None]


def status(data: dict | None) -> str:
    """COMPLETE, PARTIAL (some required fields lack) or INCOMPLETE (no provenance given)."""
    if not data:
        return "INCOMPLETE"
    return "PARTIAL" if missing(data) else "COMPLETE"


def markdown(data: dict) -> str:
    """All given fields by section, required ones without a value as 'not specified'."""
    lines = [f"Status: {status(data)}"]
    for section in [*REQUIRED, *(s for s in data if s not in REQUIRED and isinstance(data[s], dict))]:
        values = data.get(section) or {}
        keys = [*REQUIRED.get(section, []), *(k for k in values if k not in REQUIRED.get(section, []))]
        lines += ["", f"## {section}", *(f"- {k}: {values.get(k) if values.get(k) is not None else 'not specified'}" for k in keys)]
    return "\n".join(lines)


def table(df: DataFrame, rows: int) -> str:
    """The first ``rows`` of a report as a Markdown table; the table is ordered by the caller."""
    def cell(v: object) -> str:
        return "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")

    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in df.limit(rows).collect()])


def record_command(folder: str, args: list[str], parameters: dict) -> Path:
    """What was run, when and with which parameters, as JSON in ``last_command.json``."""
    path = Path(folder, "last_command.json")
    now = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
    path.write_text(json.dumps({"args": args, "parameters": parameters, "at": now}, indent=1, sort_keys=True), encoding="utf-8")
    return path
