"""A class hierarchy: closure, ancestors, and vocabularies that children inherit and override.

``edges``: child, parent, ord (place among a child's parents). Closures grow one level a round, by joins, until nothing new
comes; a cycle adds nothing new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.session import materialise


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth): every ancestor over any parents, the node itself at depth 0, at its least depth."""
    nodes = edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node"))).where("node IS NOT NULL").distinct()
    found = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    frontier, parents = found, edges.where("child IS NOT NULL AND parent IS NOT NULL").select(F.col("child").alias("ancestor"), "parent").distinct()
    depth = 0
    while True:
        depth += 1
        step = frontier.select("node", "ancestor").join(parents, "ancestor").select("node", F.col("parent").alias("ancestor")).distinct()
        frontier = materialise(step.join(found, ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if frontier.isEmpty():
            return found
        found = materialise(found.unionByName(frontier), "closure")


def lineage(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth) along the first parents only: specific to general."""
    first = edges.groupBy("child").agg(F.min_by("parent", F.struct("ord", "parent")).alias("parent"))
    return closure(first.withColumn("ord", F.lit(0)))


def subclasses(edges: DataFrame, ancestor: str) -> DataFrame:
    """Nodes that are the ancestor or below it."""
    return closure(edges).where(F.col("ancestor") == ancestor).select("node")


def inherited_terms(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """(node, term, classification): terms of a node and of its lineage; of equal terms the nearest one's class holds."""
    own = terms.select(F.col("node").alias("ancestor"), F.lower(F.trim("term")).alias("term"), "classification")
    reach = lineage(edges).join(own, "ancestor")
    return reach.groupBy("node", "term").agg(F.min_by("classification", F.struct("depth", "classification")).alias("classification"))


def terms_in(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term) of terms found anywhere in a text (no word bounds), longest first. ``texts``: id, node, text."""
    listed = terms.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.length("term")).alias("n"), "term"))).alias("all"))
    found = texts.join(listed, "node").select("id", F.posexplode(F.filter("all", lambda t: F.contains(F.lower("text"), t["term"]))).alias("place", "t"))
    return found.select("id", "place", "t.term")


def attributes(triples: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(node, one column per name): the first value (by text) of each attribute. ``triples``: node, name, value."""
    wide = triples.where(F.col("name").isin(*names)).groupBy("node").pivot("name", list(names)).agg(F.min("value"))
    return triples.select("node").distinct().join(wide, "node", "left")


def mode_terms(nodes: DataFrame, edges: DataFrame, terms: DataFrame, retraction: DataFrame, base: DataFrame) -> DataFrame:
    """(node, term, classification): the vocabulary of each node of ``nodes`` (node, has_retraction).

    Its own and its lineage's terms, with the retraction terms where it has a retraction; the base terms where that gives none.
    Of equal terms the one nearest to the node holds.
    """
    own = nodes.join(inherited_terms(edges, terms), "node").select("node", "has_retraction", "term", "classification", F.lit(0).alias("far"))
    plain = lambda df: df.select(F.lower(F.trim("term")).alias("term"), "classification")
    # Vocabularies are short lists by nature; they meet each node once.
    more = nodes.where("has_retraction").crossJoin(plain(retraction)).select("node", "has_retraction", "term", "classification", F.lit(1).alias("far"))
    both = own.unionByName(more)
    none = nodes.join(both.select("node"), "node", "left_anti").crossJoin(plain(base)).select("node", "has_retraction", "term", "classification", F.lit(2).alias("far"))
    return both.unionByName(none).groupBy("node", "term").agg(F.min_by("classification", F.struct("far", "classification")).alias("classification"))


def terms_by_class(terms: DataFrame, *classes: str) -> DataFrame:
    """Terms of some classes, or all, longest first."""
    rows = terms.where(F.col("classification").isin(*classes)) if classes else terms
    return rows.orderBy(F.desc(F.length("term")), "term")
