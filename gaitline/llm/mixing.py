"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that they belong to). Each pattern offers
its words once at no cost, and again for each further epoch at a rising cost; the flow routes these
capacities to the sources' quotas at least total cost. What a source gets from an epoch of a pattern is then
filled with whole documents in a seeded order, up to the document that comes nearest to the amount.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import WORD, through_disk

#: Fixed values of the production mix: weights by rank of source, share of all sizes, epochs.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
MAX_PATTERNS = 100_000
#: The seeded order is narrowed down by so many of its hexadecimal digits at a time, until so few documents are left.
DIGITS, ORDER_DIGITS, END_ROWS = 2, 64, 4096


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> dict[str | None, float]:
    """Target of each source: share of all sizes by weight, at most epochs times its size.

    Sources by code point, null last, take the weights in turn. What exceeds a source's limit is dealt again
    by weight to the others, until none is above: each is then at its limit, or at one level times its weight.
    """
    ranked = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    open_ = {s: (weights[k % len(weights)], n) for k, (s, n) in enumerate(ranked)}
    total, closed, out = share * sum(n for _, n in ranked), 0, {}
    while open_:
        level = (total - closed) / sum(w for w, _ in open_.values())
        above = [s for s, (w, n) in open_.items() if level * w > epochs * n]
        for s in above:
            closed += epochs * open_[s][1]
            out[s] = float(epochs * open_.pop(s)[1])
        if not above:
            out |= {s: level * w for s, (w, _) in open_.items()}
            break
    return out


def route(capacity: Mapping[int, float], members: Mapping[int, Sequence[int]], quota: Mapping[int, float], epochs: int = EPOCHS) -> dict[tuple[int, int], float]:
    """Min-cost flow: (pattern, source) -> words.

    Arcs: start -> pattern, one for each epoch e with the pattern's capacity and cost e*e (convex); pattern ->
    each of its sources; source -> end with its quota. Successive shortest paths: the cost of a path is that of
    the epoch that it opens, since rerouting between sources costs nothing, so all paths of an epoch are
    augmented before the next opens. An epoch is a maximum flow by breadth-first augmentation.
    """
    flow: dict[tuple[int, int], float] = {}
    left = {s: float(q) for s, q in quota.items()}
    by_source: dict[int, list[int]] = {}
    for p, sources in members.items():
        for s in sources:
            by_source.setdefault(s, []).append(p)
    for _ in range(epochs):
        spare = {p: float(c) for p, c in capacity.items()}
        for p in members:  # direct arcs first: the augmentation then only has to reroute
            for s in members[p]:
                x = min(spare[p], left.get(s, 0.0))
                if x > 0:
                    flow[p, s] = flow.get((p, s), 0.0) + x
                    spare[p] -= x
                    left[s] -= x
        while True:
            came: dict[tuple[str, int], tuple[str, int] | None] = {("p", p): None for p, c in spare.items() if c > 1e-6 and members[p]}
            queue, end = list(came), None
            while queue and end is None:
                after = []
                for node in queue:
                    kind, k = node
                    steps = [("s", s) for s in members[k]] if kind == "p" else [("p", p) for p in by_source[k] if flow.get((p, k), 0.0) > 1e-6]
                    for nxt in steps:
                        if nxt not in came:
                            came[nxt] = node
                            after.append(nxt)
                            if nxt[0] == "s" and left.get(nxt[1], 0.0) > 1e-6:
                                end = nxt
                                break
                    if end:
                        break
                queue = after
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            back = [flow[b[1], a[1]] for a, b in zip(path, path[1:]) if a[0] == "s"]
            x = min([spare[path[0][1]], left[end[1]], *back])
            for a, b in zip(path, path[1:]):
                arc, sign = ((a[1], b[1]), 1) if a[0] == "p" else ((b[1], a[1]), -1)
                flow[arc] = flow.get(arc, 0.0) + sign * x
            spare[path[0][1]] -= x
            left[end[1]] -= x
    return {k: v for k, v in flow.items() if v > 1e-6}


Pattern = tuple[str | None, ...]


@dataclass
class Plan:
    """What the flow decides for each membership pattern and source."""

    patterns: list[tuple[Pattern, int]]  # and words
    sizes: dict[str | None, int]
    targets: dict[str | None, float]
    #: (number of a pattern, source) -> words that the source gets from it
    flow: dict[tuple[int, str | None], float]

    def taken(self) -> list[float]:
        """Words taken from each pattern, repeats counted."""
        out = [0.0] * len(self.patterns)
        for (p, _), v in self.flow.items():
            out[p] += v
        return out


def plan(patterns: Sequence[tuple[Pattern, int]], weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> Plan:
    """The flow of (pattern, words) rows, patterns being distinct; in time near the number of memberships where patterns have one source."""
    ranked = sorted(patterns, key=lambda x: [(s is None, s or "") for s in x[0]])
    sizes: dict[str | None, int] = {}
    for p, n in ranked:
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    number = {s: k for k, s in enumerate(sources)}
    aim = targets([(s, sizes[s]) for s in sources], weights, share, epochs)
    found = route({k: n for k, (_, n) in enumerate(ranked)}, {k: [number[s] for s in p] for k, (p, _) in enumerate(ranked)}, {number[s]: aim[s] for s in sources}, epochs)
    return Plan(ranked, sizes, aim, {(p, sources[s]): v for (p, s), v in found.items()})


def names_of(source: str, memberships: str | None) -> Column:
    return F.array_sort(F.array_distinct(F.col(memberships))) if memberships else F.array(F.col(source))


def row_key(text: str, source: str, memberships: str | None = None) -> Column:
    """What tells rows of one id apart: a hash of text and membership."""
    return F.xxhash64(F.col(text), names_of(source, memberships))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", memberships: str | None = None, source: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = "", max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """doc_id, size long, source_size long, target double, taken long, key long; one row for each row of docs, none for an empty table.

    memberships: a column of arrays of sources where documents belong to several; else `source` holds the one.
    source_size and target are those of the document's (first) source. Null and empty texts have size 0 and
    are never taken; a null source is a source of its own, the last; an empty membership has target 0. key: row_key().
    Rows equal in id, text and source are told apart only by place and may be taken differently. Other columns of
    docs are not looked at. What each source gets from each pattern is plan()'s flow.

    Shuffles: one small row for each document, by (pattern, first digits of the seeded order); only the bucket
    that an amount ends in is ordered document by document. Patterns go to the driver, at most max_patterns
    of them (ValueError beyond).
    """
    names = names_of(source, memberships)
    key = row_key(text, source, memberships)
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    # rows of one id go by their texts, equal rows by their place
    order = F.concat(order, *(F.lpad(F.hex(x), 16, "0") for x in (key, F.xxhash64(F.monotonically_increasing_id()))))
    rows = docs.select(F.col(doc_id).alias("doc_id"), size_of(F.col(text)).alias("size"), names.alias("pattern"), key.alias("key"), order.alias("seeded"))
    rows = through_disk(rows, "mix")  # the one pass over the texts
    sums = rows.groupBy("pattern").agg(F.sum("size").alias("words"))
    patterns = [(tuple(r["pattern"] or ()), r["words"] or 0) for r in sums.limit(max_patterns + 1).collect()]
    if len(patterns) > max_patterns:
        raise ValueError(f"over {max_patterns} membership patterns")
    made = plan(patterns, weights, share, epochs)
    quotas, at = [], []
    kind = dict(docs.select(names.alias("p")).dtypes)["p"]
    for (p, n), words in zip(made.patterns, made.taken()):
        whole = min(epochs, int(words // n)) if n else 0
        rest = float(words - whole * n)
        quotas.append((list(p), whole, rest, made.sizes[p[0]] if p else 0, made.targets.get(p[0], 0.0) if p else 0.0))
        if rest > 0:
            at.append((list(p), "", 0, rest))
    spark = docs.sparkSession
    quota = spark.createDataFrame(quotas, f"q_pattern {kind}, whole int, rest double, source_size long, target double")
    same = F.col("pattern").eqNullSafe(F.col("q_pattern"))

    # where each pattern's amount ends in the seeded order: a hot pattern's documents are summed by the next
    # digits first, so no task sees more than 16^DIGITS sums of a pattern, until few documents are left in its bucket
    ends, depth = [], 0
    while at and depth < ORDER_DIGITS:
        depth += DIGITS
        now = spark.createDataFrame(at, f"q_pattern {kind}, prefix string, before long, end double")
        near = rows.join(F.broadcast(now), same & F.startswith("seeded", "prefix"))
        parts = near.groupBy("pattern", F.substring("seeded", 1, depth).alias("bucket"), "before", "end").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        running = W.partitionBy("pattern").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        upto = parts.withColumn("upto", F.col("before") + F.sum("words").over(running))
        found = upto.filter((F.col("upto") >= F.col("end")) & (F.col("upto") - F.col("words") < F.col("end"))).collect()
        at = [(r["pattern"], r["bucket"], r["upto"] - r["words"], r["end"]) for r in found if r["n"] > END_ROWS]
        ends += [(r["pattern"], r["bucket"], r["upto"] - r["words"], r["end"]) for r in found if r["n"] <= END_ROWS]
    last = spark.createDataFrame(ends + at, f"e_pattern {kind}, last string, before long, end double")
    quota = quota.join(last, F.col("q_pattern").eqNullSafe(F.col("e_pattern")), "left").drop("e_pattern")

    dealt = rows.join(F.broadcast(quota), same)  # at most max_patterns rows
    bucket = F.substring(F.col("seeded"), F.lit(1), F.length("last"))
    at_end = dealt.filter(bucket == F.col("last"))
    fill = W.partitionBy("pattern").orderBy("seeded").rowsBetween(W.unboundedPreceding, 0)
    upto = F.sum("size").over(fill) + F.col("before")
    # a document is in if its middle lies before the end of the amount
    in_end = at_end.withColumn("more", (2 * upto - F.col("size") <= 2 * F.col("end")).cast("int"))
    sure = dealt.filter(~F.coalesce(bucket == F.col("last"), F.lit(False))).withColumn("more", F.coalesce(bucket < F.col("last"), F.lit(False)).cast("int"))
    return sure.unionByName(in_end).select("doc_id", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), "target", ((F.col("whole") + F.col("more")) * F.col("size")).cast("long").alias("taken"), "key")
