"""A small subset of Turtle: prefixes, ``subject predicate object`` lists with ``;`` and ``,``, literals; enough for class trees."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r'<[^>]*>|"""(?:.|\n)*?"""|"(?:[^"\\]|\\.)*"|\^\^\S+|@[a-z-]+|[;,.\[\]](?=\s|$)|[^\s;,<>"\[\]]+')


def triples(text: str) -> Iterator[tuple[str, str, str]]:
    """(subject, predicate, object) with prefixes spelled out; an anonymous node is named _:b1, _:b2, ... in order."""
    prefixes: dict[str, str] = {}
    plain = "\n".join(re.sub(r'(^|\s)#(?!\S*>)[^"\n]*$', "", line) for line in text.split("\n"))

    def name(token: str) -> str:
        if token.startswith("<"):
            return token[1:-1]
        if token.startswith('"'):
            return token.strip('"')
        if token == "a":
            return "rdf:type"
        prefix, colon, rest = token.partition(":")
        return prefixes.get(prefix, f"{prefix}:") + rest if colon else token

    subject = predicate = None
    outer: list[tuple[str | None, str | None]] = []
    blanks = 0
    tokens = [t for t in TOKEN.findall(plain)]
    i = 0
    while i < len(tokens):
        t = tokens[i]
        if t.lower() in ("@prefix", "prefix"):
            prefixes[tokens[i + 1].rstrip(":")] = tokens[i + 2][1:-1]
            i += 3
            continue
        if t == ".":
            subject = predicate = None
        elif t == ";":
            predicate = None
        elif t == "[":
            blanks += 1
            node = f"_:b{blanks}"
            if subject is not None and predicate is not None:
                yield subject, predicate, node
            outer.append((subject or node, predicate))
            subject, predicate = node, None
        elif t == "]":
            subject, predicate = outer.pop()
        elif t == "," or t.startswith("^^") or (t.startswith("@") and predicate):
            pass
        elif subject is None:
            subject = name(t)
        elif predicate is None:
            predicate = name(t)
        else:
            yield subject, predicate, name(t)
        i += 1


def edges(spark: SparkSession, path: str, predicate: str = "subClassOf") -> DataFrame:
    """(child, parent, ord) of a class tree in Turtle files."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))

    def read(batches):
        for pdf in batches:
            found = [(s, o, n) for text in pdf.text for n, (s, p, o) in enumerate(triples(text)) if p.endswith(predicate)]
            yield type(pdf)(found, columns=["child", "parent", "ord"])

    return rows.mapInPandas(read, "child string, parent string, ord int")
