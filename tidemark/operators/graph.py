"""Money-flow patterns on the collapsed transfer graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import clean, number
from tidemark.functions.overlap import overlap_totals, overlapping_pairs, top_overlaps
from tidemark.functions.stored import stored
from tidemark.policy import GraphPolicy
from tidemark.schema import require_columns


def build_edges(df: DataFrame) -> DataFrame:
    """One directed edge per (src, dst): how often, how much, first and last time."""
    if "amount_paid" not in df.columns and "amount" in df.columns:
        df = df.withColumnRenamed("amount", "amount_paid")
    require_columns(df.columns, ["from_account", "to_account", "amount_paid", "timestamp"],
                    "the transfer graph")
    return (df.select(clean("from_account").alias("src"), clean("to_account").alias("dst"),
                      number(df, "amount_paid").alias("amount"), "timestamp")
              .where((F.col("src") != "") & (F.col("dst") != ""))
              .groupBy("src", "dst")
              .agg(F.count("*").alias("transaction_count"), F.sum("amount").alias("total_amount"),
                   F.min("timestamp").alias("first_timestamp"),
                   F.max("timestamp").alias("last_timestamp")))


def graph_summary(df: DataFrame, edges: DataFrame) -> DataFrame:
    def row(**counts) -> list[Column]:
        return [F.coalesce(counts.get(c, F.lit(0)), F.lit(0)).cast("long").alias(c)
                for c in ("input_rows", "nodes", "edges", "self_loops")]

    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    one = (df.agg(*row(input_rows=F.count("*")))
             .unionByName(ends.agg(*row(nodes=F.count_distinct("node"))))
             .unionByName(edges.agg(*row(edges=F.count("*"),
                                         self_loops=F.count_if(F.col("src") == F.col("dst")))))
             .agg(*[F.sum(c).alias(c) for c in ("input_rows", "nodes", "edges", "self_loops")]))
    n = F.col("nodes")
    return one.withColumn("density", F.round(
        F.when(n > 1, F.col("edges") / (n * (n - 1))).otherwise(0.0), 8))


def fans(edges: DataFrame, direction: str, policy: GraphPolicy = GraphPolicy()) -> DataFrame:
    """All hubs by in- or out-degree: degree, transfers, amount."""
    hub = {"in": "dst", "out": "src"}[direction]
    return (edges.groupBy(F.col(hub).alias("account"))
                 .agg(F.count("*").alias("degree"),
                      F.sum("transaction_count").alias("transaction_count"),
                      F.round(F.sum("total_amount"), 2).alias("total_amount"))
                 .where(F.col("degree") >= policy.fan_degree))


def top_fans(edges: DataFrame, direction: str, max_results: int | None = 100,
             policy: GraphPolicy = GraphPolicy()) -> DataFrame:
    """Hubs by degree with their first counterparties in name order."""
    found = fans(edges, direction, policy)
    if max_results is not None:
        found = found.orderBy(F.desc("degree"), "account").limit(max_results)
    hub, other = ("dst", "src") if direction == "in" else ("src", "dst")
    return found.join(_listed(edges, hub, other, "account", "counterparties", policy.listed),
                      "account", "left")


def _listed(pairs: DataFrame, key: str, item: str, key_name: str, name: str,
            k: int) -> DataFrame:
    """Per key its k smallest items, sorted. Ranks are cut per map task before the shuffle,
    so an array never holds more than k entries."""
    rank = Window.partitionBy(key).orderBy(item)
    return (pairs.select(key, item, F.row_number().over(rank).alias("_r"))
                 .where(F.col("_r") <= k)
                 .groupBy(F.col(key).alias(key_name))
                 .agg(F.array_sort(F.collect_list(item)).alias(name)))


def _senders(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("set_id"), F.col("dst").alias("token"))


def _receivers(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("set_id"), F.col("src").alias("token"))


def bipartite_pairs(edges: DataFrame, policy: GraphPolicy = GraphPolicy()) -> DataFrame:
    """Source pairs paying at least two common targets: K(2, n)."""
    return _as_bipartite(overlapping_pairs(_senders(edges), None, policy.shared_targets))


def _as_bipartite(found: DataFrame) -> DataFrame:
    return found.select(F.col("a").alias("source_a"), F.col("b").alias("source_b"),
                        F.col("shared").alias("destination_count"),
                        (F.col("shared") * 2).alias("edge_count"))


def bipartite_accounts(edges: DataFrame, policy: GraphPolicy = GraphPolicy()) -> DataFrame:
    """Per source account: with how many others it forms a K(2, n), over how many edges, the widest n."""
    return overlap_totals(_senders(edges), None, policy.shared_targets).select(
        F.col("set_id").alias("account"), F.col("as_a").alias("pair_count"), (F.col("shared") * 2).alias("edge_count"), "widest")


def top_bipartite(edges: DataFrame, max_results: int = 100,
                  policy: GraphPolicy = GraphPolicy()) -> DataFrame:
    """The widest pairs, each with its first common targets."""
    best = _as_bipartite(top_overlaps(_senders(edges), None, max_results, policy.shared_targets))
    return _with_middle(best, edges.select(F.col("src").alias("source_a"), F.col("dst").alias("m")),
                        edges.select(F.col("src").alias("source_b"), F.col("dst").alias("m")),
                        "source_a", "source_b", "destinations", policy.listed)


def _with_middle(best: DataFrame, a_side: DataFrame, b_side: DataFrame, a: str, b: str,
                 name: str, k: int) -> DataFrame:
    shared = best.select(a, b).join(a_side, a).join(b_side, [b, "m"])
    rank = Window.partitionBy(a, b).orderBy("m")
    listed = (shared.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= k)
                    .groupBy(a, b).agg(F.array_sort(F.collect_list("m")).alias(name)))
    return best.join(listed, [a, b], "left")


def pattern_membership(edges: DataFrame, policy: GraphPolicy = GraphPolicy()) -> DataFrame:
    """(account, pattern, size, strength): hubs, accounts with shared partners, and accounts on cycles.

    Size is the hub's degree, the widest set of shared partners, or the number of cycles up to four accounts.
    Strength is size / (size + least), with the least size that makes the pattern: a half there, near one far beyond.
    """
    def leg(found: DataFrame, pattern: str, size: Column, least: int) -> DataFrame:
        n = size.cast("long")
        return found.select("account", F.lit(pattern).alias("pattern"), n.alias("size"), (n / (n + least)).alias("strength"))

    rings = cycle_accounts(edges).groupBy("account").agg(F.sum("cycle_count").alias("n"))
    return (leg(fans(edges, "in", policy), "fan_in", F.col("degree"), policy.fan_degree)
            .unionByName(leg(fans(edges, "out", policy), "fan_out", F.col("degree"), policy.fan_degree))
            .unionByName(leg(bipartite_accounts(edges, policy), "bipartite", F.col("widest"), policy.shared_targets))
            .unionByName(leg(rings, "cycle", F.col("n"), 1)))


def graph_signals(membership: DataFrame) -> DataFrame:
    """The graph detector's signal of each account: its strongest pattern, and all of them as flags."""
    return membership.groupBy(F.col("account").alias("entity_id")).agg(
        F.lit("graph_engine").alias("detector"), F.max("strength").alias("score"),
        F.collect_set("pattern").alias("flags"), F.lit(False).alias("high_risk_country"))


def gather_scatter(edges: DataFrame, policy: GraphPolicy = GraphPolicy()) -> DataFrame:
    """Hubs that both gather from and scatter to at least three accounts."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("dst").alias("hub"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        F.struct(F.col("src").alias("hub"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    return (ends.groupBy("e.hub").agg(F.sum("e.i").alias("source_count"),
                                      F.sum("e.o").alias("destination_count"))
                .where((F.col("source_count") >= policy.fan_degree)
                       & (F.col("destination_count") >= policy.fan_degree)))


def top_gather_scatter(edges: DataFrame, max_results: int | None = 100,
                       policy: GraphPolicy = GraphPolicy()) -> DataFrame:
    found = gather_scatter(edges, policy)
    if max_results is not None:
        found = found.orderBy(F.desc(F.col("source_count") + F.col("destination_count")),
                              "hub").limit(max_results)
    return (found.join(_listed(edges, "dst", "src", "hub", "sources", policy.listed), "hub", "left")
                 .join(_listed(edges, "src", "dst", "hub", "destinations", policy.listed),
                       "hub", "left"))


def scatter_gather_pairs(edges: DataFrame, policy: GraphPolicy = GraphPolicy()) -> DataFrame:
    """(source, destination) joined by at least three two-hop paths.

    That is the targets of one account overlapping the payers of another in three or more
    accounts; three paths imply the out-degree of three the pattern also asks for.
    """
    return _as_scatter(overlapping_pairs(_senders(edges), _receivers(edges), policy.scatter_paths))


def _as_scatter(found: DataFrame) -> DataFrame:
    return found.select(F.col("a").alias("source"), F.col("b").alias("destination"),
                        F.col("shared").alias("path_count"))


def scatter_gather_accounts(edges: DataFrame, policy: GraphPolicy = GraphPolicy()) -> DataFrame:
    """Per account: pairs it is the source of and the destination of, their paths, and the most paths of one."""
    return overlap_totals(_senders(edges), _receivers(edges), policy.scatter_paths).select(
        F.col("set_id").alias("account"), F.col("as_a").alias("as_source"), F.col("as_b").alias("as_destination"),
        F.col("shared").alias("path_count"), "widest")


def top_scatter_gather(edges: DataFrame, max_results: int = 100,
                       policy: GraphPolicy = GraphPolicy()) -> DataFrame:
    best = _as_scatter(top_overlaps(_senders(edges), _receivers(edges), max_results, policy.scatter_paths))
    return _with_middle(best, edges.select(F.col("src").alias("source"), F.col("dst").alias("m")),
                        edges.select(F.col("dst").alias("destination"), F.col("src").alias("m")),
                        "source", "destination", "intermediaries", policy.listed)


#: How often edges that no cycle can use are left out; each time shortens dead ends by one account at both ends.
_TRIMS = 2


def _hops(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges with the ranks of both ends (rank = degree, then name): all, downward ones, upward ones."""
    plain = edges.where(F.col("src") != F.col("dst")).select(
        "src", "dst", F.col("transaction_count").alias("n"), F.col("total_amount").alias("amt"))
    for _ in range(_TRIMS):
        plain = _trimmed(stored(plain))
    degree = (plain.select(F.explode(F.array("src", "dst")).alias("node"))
                   .groupBy("node").agg(F.count("*").alias("deg")))
    ranked = stored(plain.join(degree.select(F.col("node").alias("src"), F.col("deg").alias("sd")), "src")
                         .join(degree.select(F.col("node").alias("dst"), F.col("deg").alias("dd")), "dst"))
    src_rank, dst_rank = F.struct("sd", "src"), F.struct("dd", "dst")
    return ranked, ranked.where(src_rank > dst_rank), ranked.where(src_rank < dst_rank)


def _trimmed(plain: DataFrame) -> DataFrame:
    """Edges that a cycle may use: their payer is paid by someone, and their payee pays someone."""
    return (plain.join(plain.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
                 .join(plain.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))


def _away(ranked: DataFrame, down: DataFrame) -> DataFrame:
    """top -> m -> w with m and w below top."""
    hop = ranked.select(F.col("src").alias("m"), F.col("dst").alias("w"), F.col("dd").alias("wd"),
                        F.col("n").alias("n2"), F.col("amt").alias("amt2"))
    return (down.select(F.col("src").alias("top"), F.col("sd").alias("td"), F.col("dst").alias("m"), "n", "amt")
            .join(hop, "m").where(F.struct("wd", "w") < F.struct("td", "top"))
            .select("top", "w", "m", (F.col("n") + F.col("n2")).alias("n"), (F.col("amt") + F.col("amt2")).alias("amt")))


def _home(ranked: DataFrame, up: DataFrame) -> DataFrame:
    """w -> m -> top with w and m below top."""
    hop = ranked.select(F.col("src").alias("w"), F.col("sd").alias("wd"), F.col("dst").alias("m"),
                        F.col("n").alias("n3"), F.col("amt").alias("amt3"))
    return (up.select(F.col("src").alias("m"), F.col("dst").alias("top"), F.col("dd").alias("td"), "n", "amt")
            .join(hop, "m").where(F.struct("wd", "w") < F.struct("td", "top"))
            .select("top", "w", "m", (F.col("n") + F.col("n3")).alias("n"), (F.col("amt") + F.col("amt3")).alias("amt")))


def cycles(edges: DataFrame, max_length: int = 4, hops: tuple[DataFrame, ...] | None = None) -> DataFrame:
    """Every simple directed cycle of two to four accounts, from its smallest account on.

    Two-hop paths start at the cycle's highest-ranked account and only pass through lower-ranked ones. A busy
    account is then never a middle, except for accounts busier still, so the number of paths stays near
    edges x arboricity where an unordered self-join grows with the square of the busiest degree. Cycles of four are as
    many as there are; ``square_paths`` has them in factors, and ``cycle_accounts`` counts them without listing.
    """
    if not 2 <= max_length <= 4:
        raise ValueError("cycle length must be 2, 3 or 4")
    ranked, down, up = hops or _hops(edges)
    back = up.select(F.col("src").alias("dst"), F.col("dst").alias("src"),
                     F.col("n").alias("n2"), F.col("amt").alias("amt2"))
    parts = [down.join(back, ["src", "dst"])
                 .select(F.array("src", "dst").alias("ring"), (F.col("n") + F.col("n2")).alias("n"),
                         (F.col("amt") + F.col("amt2")).alias("amt"))]
    if max_length >= 3:
        close = up.select(F.col("src").alias("w"), F.col("dst").alias("top"),
                          F.col("n").alias("n3"), F.col("amt").alias("amt3"))
        parts.append(_away(ranked, down).join(close, ["w", "top"]).select(
            F.array("top", "m", "w").alias("ring"), (F.col("n") + F.col("n3")).alias("n"),
            (F.col("amt") + F.col("amt3")).alias("amt")))
    if max_length >= 4:
        home = _home(ranked, up).select("top", "w", F.col("m").alias("m2"), F.col("n").alias("n2"),
                                        F.col("amt").alias("amt2"))
        parts.append(_away(ranked, down).join(home, ["top", "w"]).where(F.col("m") != F.col("m2")).select(
            F.array("top", "m", "w", "m2").alias("ring"), (F.col("n") + F.col("n2")).alias("n"),
            (F.col("amt") + F.col("amt2")).alias("amt")))
    rings = parts[0]
    for part in parts[1:]:
        rings = rings.unionByName(part)
    return rings.select(_from_smallest(F.col("ring")).alias("accounts"),
                        F.size("ring").alias("length"), F.col("n").alias("transaction_count"),
                        F.round("amt", 2).alias("total_amount"))


def square_paths(edges: DataFrame, hops: tuple[DataFrame, ...] | None = None) -> DataFrame:
    """Cycles of four in factors: for each (top, opposite) the middles of the ways out and of the ways home.

    A row is a middle, with transfers and amount of its way out (n1, amt1) and home (n2, amt2), null where it has none.
    A cycle is a middle out and another one home of the same two accounts, so rows grow with the paths.
    """
    ranked, down, up = hops or _hops(edges)
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (("n", "long"), ("amt", "double"))]
    ways = _away(ranked, down).select("top", F.col("w").alias("opposite"), "m", F.struct("n", "amt").alias("out"),
                                      F.struct(*none).alias("home")).unionByName(
        _home(ranked, up).select("top", F.col("w").alias("opposite"), "m", F.struct(*none).alias("out"),
                                 F.struct("n", "amt").alias("home")))
    return ways.groupBy("top", "opposite", F.col("m").alias("middle")).agg(
        F.max("out.n").alias("n1"), F.max("out.amt").alias("amt1"),
        F.max("home.n").alias("n2"), F.max("home.amt").alias("amt2"))


def cycle_accounts(edges: DataFrame) -> DataFrame:
    """All cycles of two to four accounts, counted per account and length; those of four come from products.

    With c1 ways out and c2 home, and e middles in both, two accounts have c1 * c2 - e cycles; a middle's way
    out meets every way home but its own. Sums of transfers and amounts follow in the same way.
    """
    hops = _hops(edges)
    paths = square_paths(edges, hops)
    both = F.col("n1").isNotNull() & F.col("n2").isNotNull()
    totals = paths.groupBy("top", "opposite").agg(
        F.count("n1").alias("c1"), F.count("n2").alias("c2"), F.count_if(both).alias("e"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(f"s_{c}") for c in ("n1", "n2", "amt1", "amt2")),
        F.coalesce(F.sum(F.when(both, F.col("n1") + F.col("n2"))), F.lit(0)).alias("e_n"),
        F.coalesce(F.sum(F.when(both, F.col("amt1") + F.col("amt2"))), F.lit(0)).alias("e_amt"),
    ).where((F.col("c1") > 0) & (F.col("c2") > 0))

    def whole(c: str) -> Column:
        return F.col(f"s_{c}1") * F.col("c2") + F.col(f"s_{c}2") * F.col("c1") - F.col(f"e_{c}")

    ends = totals.select(F.explode(F.array("top", "opposite")).alias("account"),
                         (F.col("c1") * F.col("c2") - F.col("e")).alias("count"), whole("n").alias("n"), whole("amt").alias("amt"))
    own = both.cast("long")

    def through(c: str, here: str, there: str) -> Column:
        mine, other = F.col(f"{c}{here}"), F.col(f"{c}{there}")
        met = mine * (F.col(f"c{there}") - own) + F.col(f"s_{c}{there}") - F.when(both, other).otherwise(0)
        return F.when(mine.isNotNull(), met).otherwise(0)

    count = sum((F.when(F.col(f"n{a}").isNotNull(), F.col(f"c{b}") - own).otherwise(0) for a, b in (("1", "2"), ("2", "1"))), F.lit(0))
    middles = paths.join(totals, ["top", "opposite"]).select(
        F.col("middle").alias("account"), count.alias("count"),
        (through("n", "1", "2") + through("n", "2", "1")).alias("n"),
        (through("amt", "1", "2") + through("amt", "2", "1")).alias("amt"))
    squares = ends.unionByName(middles).select("account", F.lit(4).alias("length"), "count", "n", "amt")
    short = cycles(edges, 3, hops).select(F.explode("accounts").alias("account"), "length", F.lit(1).cast("long").alias("count"),
                                    F.col("transaction_count").alias("n"), F.col("total_amount").alias("amt"))
    return (short.unionByName(squares).groupBy("account", "length")
            .agg(F.sum("count").alias("cycle_count"), F.sum("n").alias("transaction_count"),
                 F.round(F.sum("amt"), 2).alias("total_amount")).where("cycle_count > 0"))


def _from_smallest(ring: Column) -> Column:
    at = F.array_position(ring, F.array_min(ring)).cast("int")
    return F.concat(F.slice(ring, at, F.size(ring)), F.slice(ring, 1, at - 1))


@dataclass(frozen=True)
class GraphResult:
    status: str
    note: str
    parts: dict[str, DataFrame]


def find_patterns(df: DataFrame, *, max_results: int = 100,
                  policy: GraphPolicy = GraphPolicy()) -> GraphResult:
    """All pattern reports of a transaction set, each a lazy frame."""
    if max_results < 1:
        raise ValueError("max_results must be positive")
    edges = build_edges(df)
    return GraphResult("ok", "Graph analysis completed.", {
        "summary": graph_summary(df, edges),
        "fan_in": top_fans(edges, "in", max_results, policy),
        "fan_out": top_fans(edges, "out", max_results, policy),
        "bipartite": top_bipartite(edges, max_results, policy),
        "gather_scatter": top_gather_scatter(edges, max_results, policy),
        "scatter_gather": top_scatter_gather(edges, max_results, policy),
        "cycles": cycles(edges).orderBy("length", "accounts").limit(max_results),
    })
