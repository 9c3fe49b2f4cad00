"""Report text built from aggregated tables."""
from pyspark.sql import DataFrame, Window, functions as F


def markdown_table(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Numbered lines of a Markdown table. The input is an aggregated table, one row per report line."""
    body = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |"))
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    rows = df.select((F.row_number().over(w) + 2).cast("long").alias("line_no"), body.alias("line"))
    head = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    top = df.sparkSession.createDataFrame(list(enumerate(head, 1)), "line_no long, line string")
    return top.unionByName(rows)
