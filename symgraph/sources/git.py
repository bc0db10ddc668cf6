"""What a working tree's version control says is dirty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def dirty_files(lines: DataFrame) -> DataFrame:
    """(path, deleted) from the lines (line) of a porcelain status: of a rename the new path; only files that would be indexed, each once."""
    rest = F.trim(F.substring("line", 4, 1 << 30))
    path = F.regexp_replace(F.element_at(F.split(rest, " -> "), -1), '^"|"$', "")
    p = lines.where(F.length("line") > 3).select(path.alias("path"), F.substring("line", 1, 2).contains("D").alias("deleted"))
    return p.where(paths.language(F.col("path")).isNotNull() & ~paths.is_skipped(F.col("path"))).groupBy("path").agg(F.min("deleted").alias("deleted"))
