"""Line deduplication by overlapping windows of three lines.

A text is split at ``\\n``. Every run of three neighbouring lines is a window, a text of one or two lines is one window
of all of them; windows whose lines are all blank do not count. Windows are compared by a 64-bit hash of their lines with
blanks at both ends of each line left out. The first occurrence of a window in the corpus, by document id and then place,
stays; each later one covers its lines, and covered lines are removed, overlaps merged.

Null and empty texts have no windows and stay as they are, as do texts without a covered line. A text that loses all its
lines becomes empty. Rows with a null id come first; repeated rows (same id) are ordered by their text and removed as
any other copy, but of rows that are equal in id and text all stay or go together, so that one copy is not mistaken for
another: they stay. Extra columns stay. An empty table gives an empty table.

Lines and windows never leave the JVM. Windows are counted with map-side aggregation, so a passage in a third of all
documents is one row per task; the join that finds later occurrences is a plain one that Spark splits where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinframe.llm.common import unused
from twinframe.session import stored

WINDOW = 3


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text hash, place, window hash): one row per window."""
    lines = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.transform(F.split(text_col, "\n"), lambda line: F.trim(line)).alias("lines"))
    places = F.sequence(F.lit(0), F.greatest(F.size("lines") - WINDOW, F.lit(0)))
    placed = lines.select("id", "t", "lines", F.explode(places).alias("at"))
    window = F.array_join(F.slice("lines", F.col("at") + 1, F.lit(WINDOW)), "\n")
    return placed.select("id", "t", "at", window.alias("window")).where(F.length(F.translate("window", "\n", "")) > 0).select("id", "t", "at", F.xxhash64("window").alias("window"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with the text cleaned, and ``n_lines`` and ``n_removed`` (lines before, lines removed; null texts have none).

    Where ``docs`` has a column of such a name, that stays, and the new one's name ends in ``_``.
    """
    found = stored(windows(docs, id_col, text_col), "windows")
    place = F.struct("id", "t", "at")
    repeated = found.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    later = found.join(repeated.select("window", "first"), "window").where(place > F.col("first"))
    covered = later.groupBy("id", "t").agg(F.collect_set("at").alias("starts"))
    names = docs.columns
    n_lines, n_removed = (unused(names, x) for x in ("n_lines", "n_removed"))
    row, key, digest = (unused(names, x) for x in ("row", "key", "digest"))
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(row), F.col(id_col).alias(key), F.xxhash64(text_col).alias(digest))
    right = covered.select(F.col("id").alias(f"{key}_"), F.col("t").alias(f"{digest}_"), "starts")
    met = left.join(right, F.col(key).eqNullSafe(F.col(f"{key}_")) & (F.col(digest) == F.col(f"{digest}_")), "left")
    met = met.select(row, F.col("starts").alias(starts := unused(names, "starts")))
    text = F.col(f"{row}.`{text_col}`")
    lines = F.split(text, "\n")
    reach = F.flatten(F.transform(starts, lambda at: F.sequence(at, at + WINDOW - 1)))
    gone = F.array_distinct(F.filter(reach, lambda at: at < F.size(lines)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    cleaned = F.array_join(F.transform(kept, lambda at: F.get(lines, at)), "\n")
    return met.select(
        *[(F.when(F.col(starts).isNull(), text).otherwise(cleaned) if c == text_col else F.col(f"{row}.`{c}`")).alias(c) for c in names],
        F.when(text.isNull(), 0).when(F.length(text) == 0, 0).otherwise(F.size(lines)).alias(n_lines),
        F.when(F.col(starts).isNull(), 0).otherwise(F.size(gone)).alias(n_removed),
    )
