"""Reports: one JSON row a document, and Markdown of one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT_VERSION = "1.0"


def review_json(summary: DataFrame, matches: DataFrame, contributions: DataFrame) -> DataFrame:
    """(doc_id, json): summary, matches in their order, sources by id. Matches
    are cut to a bounded number a document before they come here."""
    m = matches.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("match_rank", *(c for c in matches.columns if c not in ("doc_id", "match_rank"))))).alias("matches"))
    c = contributions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "words", "percent"))).alias("sources"))
    rows = summary.join(m, "doc_id", "left").join(c, "doc_id", "left")
    body = F.struct(F.lit(REPORT_VERSION).alias("version"), F.struct(*(x for x in summary.columns if x != "doc_id")).alias("summary"), "matches", "sources")
    return rows.select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def review_markdown(row: dict) -> str:
    """A report of one document, from its parsed JSON row."""
    lines = ["# Source overlap review", "", "| measure | value |", "|---|---|"]
    lines += [f"| {k} | {v} |" for k, v in row["summary"].items()]
    lines += ["", "## Sources", "", *(f"- {s['source_id']}: {s['words']} words ({s['percent']} %)" for s in row.get("sources") or [])]
    lines += ["", "## Matches", "", *(f"{m['match_rank']}. {m['severity']}, {m['status']}, source {m['source_id']}" for m in row.get("matches") or [])]
    return "\n".join([*lines, "", "Overlap is not a verdict; review attribution."])
