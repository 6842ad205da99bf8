"""Consensus from several annotators' labels, without known truth.

Votes are reduced, item by item, to the counts of label pairs of every annotator with the *anchors* (the most active
annotators, at most ANCHORS; usually all of them): sums of indicator rows per partition, no pairs of rows. From these the
triplet moment method solves accuracies: agreement on a class, corrected for chance, factorises over annotators, so that
the accuracy of one follows from its agreement with two others and theirs. Anchors are solved together; any other annotator
follows from its triplets with anchors, in parallel. The rates of confusing classes follow from the same moments by one
linear least-squares step. Votes are combined with log-odds weights and the class shares.

Defined cases: a vote counts when its error is null and its label is one of the classes in any spelling; of an annotator's
votes on one item the earliest counts (ties: the class that comes first); items or annotators that are null are left out;
an annotator never seen together with an anchor votes by its own shares and decides nothing; on equal posteriors the class
first in ``CLASSES`` wins; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.identifiers import CLASSES, canonical_class
from cellweave.session import materialise, sized

K = len(CLASSES)
#: Annotators whose moments are solved together, on the driver; each of the others is solved against them.
ANCHORS = 256
#: Numbers in a worker's table of pair counts before they are sent on.
FLUSH = 4_000_000
GRAM = "member string, cls int, anchor int, counts array<double>"
SOLVED = "member string, n_votes long, accuracy double, skill double, rates array<array<double>>"


def valid_votes(votes: DataFrame, item: str = "item_id", member: str = "member_id", label: str = "label", error: str = "error", at: str = "voted_at") -> DataFrame:
    """(item, member, cls): one valid vote per item and annotator; cls is the class's place in ``CLASSES``."""
    place = F.array_position(F.array(*map(F.lit, CLASSES)), canonical_class(votes[f"`{label}`"])) - 1
    rows = votes.where(votes[f"`{error}`"].isNull()).select(
        votes[f"`{item}`"].alias("item"), votes[f"`{member}`"].alias("member"), place.cast("int").alias("cls"), votes[f"`{at}`"].alias("at")
    )
    rows = rows.where("item IS NOT NULL AND member IS NOT NULL AND cls >= 0")
    return rows.groupBy("item", "member").agg(F.min(F.struct(F.col("at").isNull(), "at", "cls")).alias("v")).select("item", "member", F.col("v.cls").alias("cls"))


class _Gram:
    """Counts of each annotator's labels with each anchor's, summed over the partition's items."""

    def __init__(self, anchors: list[str]) -> None:
        self.place = {m: i for i, m in enumerate(anchors)}

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names: dict[str, int] = {}
        width = len(self.place) * K
        total = np.zeros((0, width))
        for pdf in batches:
            sizes = [len(b) for b in pdf.ballot]
            row = np.repeat(np.arange(len(sizes)), sizes)
            votes = [(v["member"], v["cls"]) for b in pdf.ballot for v in b]
            code = np.fromiter((names.setdefault(m, len(names)) * K + c for m, c in votes), np.int64, len(votes))
            hot = np.fromiter((self.place.get(m, -1) * K + c if m in self.place else -1 for m, c in votes), np.int64, len(votes))
            if len(names) * K > len(total):
                total = np.concatenate([total, np.zeros((len(names) * K - len(total), width))])
            # Items in portions, so that the indicator rows stay few with many anchors.
            ends = np.searchsorted(row, np.arange(0, len(sizes) + 1, max(1, FLUSH // (8 * width))))
            for a, b in zip(ends, np.append(ends[1:], len(row))):
                if a == b:
                    continue
                first = row[a]
                indicator = np.zeros((row[b - 1] - first + 1, width), np.float32)
                mine = hot[a:b] >= 0
                indicator[row[a:b][mine] - first, hot[a:b][mine]] = 1
                order = np.argsort(code[a:b], kind="stable")
                sorted_ = code[a:b][order]
                begin = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
                step = max(1, FLUSH // width)
                # A code's votes in pieces, each summed at once.
                cuts = np.unique(np.concatenate([begin, np.arange(0, len(sorted_), step)]))
                for p, q in zip(cuts, np.append(cuts[1:], len(sorted_))):
                    total[sorted_[p]] += indicator[row[a:b][order[p:q]] - first].sum(0)
            if total.size > FLUSH:
                yield self.rows(names, total)
                names, total = {}, np.zeros((0, width))
        yield self.rows(names, total)

    def rows(self, names: dict[str, int], total: np.ndarray) -> pd.DataFrame:
        order = list(names)
        table = total.reshape(len(total), -1, K) if total.size else np.zeros((0, 1, K))
        at, anchor = np.nonzero(table.any(2))
        return pd.DataFrame({"member": [order[i // K] for i in at], "cls": (at % K).astype("int32"), "anchor": anchor.astype("int32"), "counts": list(table[at, anchor])})


def pair_counts(votes: DataFrame, anchors: list[str]) -> DataFrame:
    """(member, cls, anchor, c0, ...): how many items ``member`` labelled ``cls`` and the anchor labelled 0, 1, ..."""
    ballots = votes.groupBy("item").agg(F.collect_list(F.struct("member", "cls")).alias("ballot")).select("ballot")
    return ballots.mapInPandas(_Gram(anchors), GRAM).groupBy("member", "cls", "anchor").agg(*[F.sum(F.col("counts")[k]).alias(f"c{k}") for k in range(K)])


def triplet_skill(agreement: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Skills r with agreement[i, j] ~ r[i] * r[j]: each from all triplets, weighted by how surely they are known."""
    m = len(agreement)
    off = ~np.eye(m, dtype=bool) & (weight > 0)
    a, w = np.where(off, agreement, 0.0), np.where(off, weight, 0.0)
    # r_i^2 = a_ij a_ik / a_jk; as a weighted least-squares ratio, so that weak a_jk do not blow up.
    top = np.einsum("ij,ik,jk->i", w * a, w * a, w * a, optimize=True)
    low = np.einsum("ij,ik,jk->i", w, w, w * a * a, optimize=True)
    size = np.sqrt(np.clip(np.where(low > 0, top / np.where(low > 0, low, 1), 0), 1e-4, 0.9999))
    # Signs: most are better than chance, so the surest pairs decide; an annotator against them is reversed.
    sign = np.ones(m)
    for _ in range(20):
        new = np.where((w * a) @ (sign * size) < 0, -1.0, 1.0)
        if (new == sign).all():
            break
        sign = new
    skill = sign * size
    # Refine against all pairs (alternating least squares on the same moments).
    for _ in range(200):
        step = (w * a) @ skill / np.maximum(w @ (skill**2), 1e-9)
        step = np.clip(step, -0.9999, 0.9999)
        if np.abs(step - skill).max(initial=0) < 1e-9:
            break
        skill = 0.5 * skill + 0.5 * step
    return skill if skill @ np.maximum(weight.sum(1), 0) >= 0 else -skill


class Moments:
    """What the moments of the anchors say: class shares, and of each anchor correlations with the truth and vote rates."""

    def __init__(self, counts: np.ndarray) -> None:
        m = len(counts)
        own = np.stack([np.diag(counts[i, i]) for i in range(m)])
        self.skill = triplet_skill(*self.agreement(counts, own))
        trust = np.clip(self.skill, 0, None) ** 2 * own.sum(1)
        share = (own + 0.5) / (own + 0.5).sum(1, keepdims=True)
        prior = trust @ share / trust.sum() if trust.sum() > 0 else share.mean(0)
        self.prior = np.clip(prior, 1e-4, None) / np.clip(prior, 1e-4, None).sum()
        # The same on each class against all others.
        self.alpha = np.stack([triplet_skill(*self.correlation(counts, c)) for c in range(K)], axis=1)
        start = self.class_rates(self.alpha, share)
        self.rates = start
        self.rates = np.stack([self.member_rates(counts[i], start[i], skip=i) for i in range(m)])

    @staticmethod
    def agreement(counts: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Agreement corrected for chance, and its weight, of each pair (rows may be other annotators than columns)."""
        together = counts.sum((2, 3))
        n = np.maximum(together, 1)
        agree = np.einsum("ijkk->ij", counts) / n
        chance = np.einsum("ijk,ijk->ij", counts.sum(3), counts.sum(2)) / n**2
        return (agree - chance) / np.maximum(1 - chance, 1e-6), np.where(together > 1, together, 0)

    @staticmethod
    def correlation(counts: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
        """Correlation of the votes for one class, and its weight, of each pair."""
        together = counts.sum((2, 3))
        n = np.maximum(together, 1)
        p, q = counts[:, :, c, :].sum(2) / n, counts[:, :, :, c].sum(2) / n
        spread = np.sqrt(np.maximum(p * (1 - p), 1e-6) * np.maximum(q * (1 - q), 1e-6))
        return (counts[:, :, c, c] / n - p * q) / spread, np.where(together > 1, together, 0)

    def class_rates(self, alpha: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Vote rates from the correlations of each class's votes with the truth."""
        q = self.prior
        gap = alpha * np.sqrt(share * (1 - share)) / np.sqrt(q * (1 - q))
        hit, miss = np.clip(share + (1 - q) * gap, 0.01, 0.99), np.clip(share - q * gap, 0.002, 0.9)
        rates = np.where(np.eye(K, dtype=bool)[None], hit[:, None, :], miss[:, None, :])
        return rates / rates.sum(2, keepdims=True)

    def member_rates(self, counts: np.ndarray, start: np.ndarray, skip: int = -1) -> np.ndarray:
        """Vote rates of one annotator from its counts with the anchors: joint counts are linear in them, given the anchors' rates."""
        together = counts.sum((1, 2))
        weight = np.where(together > 1, np.clip(self.skill, 0, None) ** 2, 0) * together
        if skip >= 0:
            weight[skip] = 0
        left = np.einsum("j,jtl,jsl->ts", weight, self.rates, self.rates)
        right = np.einsum("j,jtl,jkl->tk", weight / np.maximum(together, 1), self.rates, counts)
        if np.trace(left) <= 0:
            return start
        joint = np.clip(np.linalg.solve(left + 1e-6 * np.trace(left) * np.eye(K), right), 1e-5, None)
        return joint / joint.sum(1, keepdims=True)

    def member(self, counts: np.ndarray, own: np.ndarray) -> tuple[float, np.ndarray]:
        """Skill and vote rates of an annotator that is no anchor, from its triplets with anchors."""
        share = ((own + 0.5) / (own + 0.5).sum())[None]
        fit = lambda a, w, r: float(np.clip((w * a) @ r / max(w @ r**2, 1e-9), -0.9999, 0.9999))
        a, w = self.agreement(counts[None], None)
        skill = fit(a[0], w[0], self.skill)
        alpha = np.array([[fit(x[0], y[0], self.alpha[:, c]) for c in range(K) for x, y in [self.correlation(counts[None], c)]]])
        return skill, self.member_rates(counts, self.class_rates(alpha, share)[0])


class _Others:
    """Solves annotators that are no anchors: rows (member, own, entries)."""

    def __init__(self, moments: Moments) -> None:
        self.moments = moments

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for member, own, entries in zip(pdf.member, pdf.own, pdf.entries):
                counts = np.zeros((len(self.moments.skill), K, K))
                for e in entries:
                    counts[e["anchor"], e["cls"]] = [e[f"c{k}"] for k in range(K)]
                # The annotator's label comes first, the anchor's second.
                skill, rates = self.moments.member(counts, np.array(own, float))
                rows.append(_person(member, int(sum(own)), self.moments.prior, skill, rates))
            yield pd.DataFrame(rows, columns=["member", "n_votes", "accuracy", "skill", "rates"])


def _person(member: str, n: int, prior: np.ndarray, skill: float, rates: np.ndarray) -> tuple:
    return member, n, float(np.einsum("k,kk->", prior, rates)), float(skill), [[float(x) for x in r] for r in rates]


def annotators(votes: DataFrame, anchors: int = ANCHORS) -> tuple[DataFrame, np.ndarray]:
    """(member, n_votes, accuracy, skill, rates[true][vote]) of every annotator, and the class shares. ``votes`` is read several times."""
    spark = votes.sparkSession
    own = materialise(votes.groupBy("member").agg(*[F.count_if(F.col("cls") == k).alias(f"n{k}") for k in range(K)], F.count("*").alias("n")), "members")
    listed = sorted(r["member"] for r in own.orderBy(F.desc("n"), "member").limit(anchors).collect())
    if not listed:
        return spark.createDataFrame([], SOLVED), np.full(K, 1 / K)
    pairs = materialise(pair_counts(votes, listed), "pairs")
    place = {m: i for i, m in enumerate(listed)}
    known = pairs.join(F.broadcast(spark.createDataFrame([(m,) for m in listed], "member string")), "member").toPandas()
    counts = np.zeros((len(listed), len(listed), K, K))
    counts[known["member"].map(place), known["anchor"], known["cls"]] = known[[f"c{k}" for k in range(K)]].to_numpy()
    moments = Moments(counts)
    people = [_person(m, int(np.trace(counts[i, i])), moments.prior, moments.skill[i], moments.rates[i]) for m, i in place.items()]
    solved = spark.createDataFrame(people, SOLVED)
    entry = F.struct("anchor", "cls", *[f"c{k}" for k in range(K)])
    rest = own.join(F.broadcast(solved.select("member")), "member", "left_anti").select("member", F.array(*[f"n{k}" for k in range(K)]).alias("own"))
    # Of one annotator: at most K entries for each anchor.
    seen = pairs.groupBy("member").agg(F.collect_list(entry).alias("entries"))
    rest = rest.join(seen, "member", "left").withColumn("entries", F.coalesce("entries", F.array().cast(seen.schema["entries"].dataType)))
    return solved.unionByName(rest.mapInPandas(_Others(moments), SOLVED)), moments.prior


def consensus(votes: DataFrame, least: int = 3, anchors: int = ANCHORS) -> tuple[DataFrame, DataFrame]:
    """Items (item, cls, confidence, n_votes, agreement) with at least ``least`` annotators, and annotators.

    agreement is the share of agreeing pairs among the item's votes. Annotators: member, n_votes, accuracy, skill (agreement
    with the truth corrected for chance), rates.
    """
    votes = materialise(votes, "votes")
    people, prior = annotators(votes, anchors)
    people = materialise(people, "people")
    weights = people.select("member", F.inline(F.array(*[F.struct(F.lit(v).alias("cls"), F.array(*[F.log(F.greatest(F.col("rates")[t][v], F.lit(1e-6)) * K) for t in range(K)]).alias("w")) for v in range(K)])))
    scored = votes.join(sized(materialise(weights, "weights")), ["member", "cls"])
    items = scored.groupBy("item").agg(
        F.count("*").alias("n_votes"),
        *[F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(K)],
        *[F.count_if(F.col("cls") == k).alias(f"n{k}") for k in range(K)],
    )
    total = [F.col(f"s{k}") + F.lit(float(np.log(prior[k]))) for k in range(K)]
    top = F.greatest(*total)
    cls = F.coalesce(*[F.when(t == top, F.lit(k)) for k, t in enumerate(total)])
    norm = sum((F.exp(t - top) for t in total[1:]), F.exp(total[0] - top))
    n = F.col("n_votes")
    squares = sum((F.col(f"n{k}") * F.col(f"n{k}") for k in range(1, K)), F.col("n0") * F.col("n0"))
    items = items.where(n >= least).select(
        "item", cls.alias("cls"), (1 / norm).alias("confidence"), "n_votes", F.when(n > 1, (squares - n) / (n * (n - 1))).alias("agreement")
    )
    return items, people
