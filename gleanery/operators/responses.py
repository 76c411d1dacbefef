"""How much of a rule's text answers those who commented: counted markers and sliding windows of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T

# What counts as a heading, a marker, a commenter and an act of the agency.
HEADING = (
    r"^\s*(?:[IVXLC]+\.|[A-Z]\.|\d+\.)?\s*(?:(?:Summary\s+of\s+|Public\s+|Response\s+to\s+|Discussion\s+of\s+)?"
    r"Comments?(?:\s+and\s+Responses?)?|Response\s+to\s+Comments?|Comment\s+and\s+Response|Public\s+Participation)\s*:?\s*$"
)
COMMENT = r"^\s*Comments?\s*:"
RESPONSE = r"^\s*(?:Agency\s+)?Response\s*:"
COMMENTER = r"\b(?:commenters?|some\s+commenters?|many\s+commenters?|several\s+commenters?|one\s+commenter|other\s+commenters?)\b"
ACT = (
    r"\b(?:agree|disagree|agrees|disagrees|declines?|declined|concurs?|has\s+revised|have\s+revised|has\s+modified|is\s+finalizing|are\s+finalizing|did\s+not\s+find|"
    r"does\s+not\s+agree|is\s+not\s+persuaded|acknowledges?|rejects?|adopted?|has\s+determined|concludes?|considered|reviewed|in\s+response\s+to|after\s+considering)\b"
)


def counted(text: Column | str) -> list[Column]:
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    count = lambda p, flags, name: F.regexp_count(t, F.lit(f"(?{flags}){p}")).cast("long").alias(name)
    return [F.length(t).cast("long").alias("chars"), count(RESPONSE, "imuU", "comment_response_pairs"), count(COMMENT, "imuU", "comment_markers"), count(COMMENTER, "iuU", "commenter_mentions"), count(HEADING, "imuU", "response_headings")]


def passages(rows: DataFrame, key: str, text: str, window: int = 700, stride: int = 350, commenter: str = COMMENTER, act: str = ACT) -> DataFrame:
    """(key, windows, response_windows, offsets, response_density): windows with both a commenter and an act; the first 5 offsets.

    Windows are cut and tested within the row, so a text isn't copied for each of them.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    starts = lambda v: F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(v) - window), F.lit(stride))
    hit = lambda w: w.rlike("(?iuU)" + commenter) & w.rlike("(?iuU)" + act)
    found = rows.select(F.col(key), T.let(t, lambda v: F.struct(F.size(starts(v)).cast("long").alias("windows"), F.filter(starts(v), lambda at: hit(F.substring(v, at + 1, F.lit(window)))).alias("at"))).alias("f"))
    out = found.select(key, "f.windows", F.size("f.at").cast("long").alias("response_windows"), F.transform(F.slice("f.at", 1, 5), lambda x: x.cast("long")).alias("offsets"))
    return out.withColumn("response_density", F.col("response_windows") / F.col("windows"))
