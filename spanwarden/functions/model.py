"""Types of the data model: ordered enums, and the schemas of findings and of tables around them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
CONFIDENCES = ("LOW", "MEDIUM", "HIGH")
LIKELIHOODS = ("RARE", "UNLIKELY", "POSSIBLE", "LIKELY", "ALMOST_CERTAIN")
INFO, LOW, MEDIUM, HIGH, CRITICAL = range(5)

FINDING = """ordinal long, rule_id string, scanner string, title string, path string, start_line int, end_line int,
start_column int, end_column int, snippet string, severity int, confidence int, likelihood int, cwe array<string>,
owasp array<string>, tags array<string>"""


def parse_enum(value: str | int, labels: tuple[str, ...]) -> int:
    """The rank of a label, whatever its case and with blanks for underscores, or of a rank; else ValueError."""
    text = str(value).strip()
    if text.lstrip("-").isdigit():
        if 0 <= int(text) < len(labels):
            return int(text)
    elif (name := text.upper().replace(" ", "_")) in labels:
        return labels.index(name)
    raise ValueError(f"{value!r} is none of {', '.join(labels)}")


def label(rank: Column, labels: tuple[str, ...]) -> Column:
    """The label of a rank column."""
    return F.element_at(F.array(*map(F.lit, labels)), rank + 1)


def rank(name: Column, labels: tuple[str, ...]) -> Column:
    """The rank of a label column, null for none."""
    at = F.array_position(F.array(*map(F.lit, labels)), F.upper(F.replace(F.trim(name), F.lit(" "), F.lit("_"))))
    return F.when(at > 0, (at - 1).cast("int"))
