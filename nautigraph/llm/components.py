"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import stars
from .common import written


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links(a, b) that isn't the root, the least node, of its component.

    Self-links and null ends are passed over; an empty table gives none.  Each round is written out.
    """
    return stars(links, lambda df: written(df, "stars")).select(F.col("a").alias("node"), F.col("b").alias("root"))
