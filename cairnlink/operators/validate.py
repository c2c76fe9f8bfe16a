"""Validation of result files: one row for each finding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

S1 = "source1_entity_id"


def result_findings(results: DataFrame, required: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None, column: str = "matched_entity_ids") -> DataFrame:
    """(rule, subject, id, level) of every broken rule; no row if the results are sound.

    ``results`` and ``candidates`` have comma lists in ``column`` and candidate_entity_ids; ``required`` the S1 ids that must be
    there once; ``known`` the ids that may be named. A match that is no candidate is a warning, all else an error.
    """
    ids = results.select(S1, F.explode(F.split(F.coalesce(column, F.lit("")), ",")).alias("id")).where("id <> ''")

    def finding(rows: DataFrame, rule: str, id_: str | None = None, level: str = "error") -> DataFrame:
        return rows.select(F.lit(rule).alias("rule"), F.col(S1).alias("subject"), (F.col(id_) if id_ else F.lit("")).alias("id"), F.lit(level).alias("level"))

    found = [
        finding(results.groupBy(S1).count().where("count > 1"), "duplicate_row"),
        finding(ids.groupBy(S1, "id").count().where("count > 1"), "duplicate_id", "id"),
        finding(ids.where(F.col("id").startswith("S1-")).distinct(), "self_id", "id"),
        finding(ids.where(~F.col("id").rlike("^S[123]-")).distinct(), "bad_prefix", "id"),
        finding(required.select(S1).join(results, S1, "left_anti"), "missing_row"),
        finding(results.select(S1).join(required, S1, "left_anti").distinct(), "extra_row"),
    ]
    if known is not None:
        found.append(finding(ids.distinct().join(known.select(F.col(known.columns[0]).alias("id")), "id", "left_anti"), "unknown_id", "id"))
    if candidates is not None:
        named = candidates.select(S1, F.explode(F.split("candidate_entity_ids", ",")).alias("id"))
        found.append(finding(ids.join(named, [S1, "id"], "left_anti").distinct(), "not_a_candidate", "id", "warning"))
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def header_findings(lines: DataFrame, header: str = f"{S1}\tmatched_entity_ids") -> DataFrame:
    """(rule, line) of a result file read as text: header not as expected, comma instead of tab, rows without tab.

    ``lines`` has number (0 for the header) and value.
    """
    first = F.col("number") == 0
    rule = F.when(first & F.col("value").contains(",") & ~F.col("value").contains("\t"), "comma_header").when(first & (F.rtrim("value") != header), "bad_header").when(~first & (F.col("value") != "") & ~F.col("value").contains("\t"), "no_tab")
    return lines.select(rule.alias("rule"), F.col("number").alias("line")).where("rule is not null")
