"""What is sent to a judge, as text columns, and the gate on what that may cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    """Text inside an XML element."""
    out = F.coalesce(text, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def element(name: str, content: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), content, F.lit(f"</{name}>"))


def blind_payload(rows: DataFrame) -> DataFrame:
    """One XML text per response: paper, prompt, response; nothing of what any scorer said. Needs title, year, names, prompt, text."""
    paper = element("paper", F.concat(element("title", escaped(F.col("title"))), element("year", escaped(F.col("year").cast("string"))), element("authors", escaped(F.array_join("names", ", ")))))
    return rows.withColumn("payload", element("case", F.concat(paper, element("prompt", escaped(F.col("prompt"))), element("response", escaped(F.col("text"))))))


def audit_payload(rows: DataFrame) -> DataFrame:
    """A text per response that shows the scorer's class, and why it is starred where it is."""
    star = F.when(F.col("star_reason") != "not_starred", F.concat(F.lit("\nLooked at because: "), F.col("star_reason"))).otherwise("")
    return rows.withColumn("payload", F.concat(F.lit("Class: "), F.col("cls"), star, F.lit("\n\nResponse:\n"), F.coalesce("text", F.lit(""))))


def within_budget(cost: DataFrame, most: float) -> float:
    """The estimate, if it is within the budget; none or a negative budget is no limit."""
    total = float(cost.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("c")).first()["c"])
    if most > 0 and total > most:
        raise ValueError(f"the estimate of {total:.2f} exceeds the budget of {most:.2f}")
    return total
