"""Keyword search over a relational schema: tuple sets, candidate networks, top-N joined results.

The schema is a small graph of relations with foreign keys, so networks are generated on the driver; the joins
they stand for run as DataFrame plans.  Foreign-key edges point from the referencing to the referenced relation.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rank


@dataclass(frozen=True)
class ForeignKey:
    source: str
    column: str
    target: str
    key: str


@dataclass
class Relation:
    name: str
    key: str
    text: tuple[str, ...] = ()
    size: int | None = None

    def selectivity(self, other: Relation) -> float:
        return other.size / self.size


@dataclass
class Schema:
    relations: dict[str, Relation]
    keys: list[ForeignKey] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> Schema:
        """'n R0 .. Rn-1 (from to)*': every pair is a foreign key of ``from`` to ``to``, columns named after the target."""
        words = text.split()
        n = int(words[0])
        names, rest = words[1 : n + 1], words[n + 1 :]
        if len(names) != n or len(rest) % 2 or not set(rest) <= set(names):
            raise ValueError("malformed schema")
        pairs = list(zip(rest[::2], rest[1::2]))
        return cls({r: Relation(r, "id") for r in names}, [ForeignKey(a, f"{b}_id", b, "id") for a, b in pairs])

    def edges(self, name: str) -> list[tuple[int, str, bool]]:
        """(number, neighbour, is name the referencing side?) of the foreign keys at a relation, both directions."""
        out = []
        for i, k in enumerate(self.keys):
            if k.source == name:
                out.append((i, k.target, True))
            if k.target == name:
                out.append((i, k.source, False))
        return out

    def many_to_many(self, a: str, b: str) -> bool:
        """Whether some relation references both."""
        return any(x.source == y.source and (x.target, y.target) == (a, b) for x in self.keys for y in self.keys if x is not y)


@dataclass(frozen=True)
class Network:
    """A tree of tuple variables: (relation, bound to its tuple set?) and edges (a, b, foreign key number, a is the source?)."""

    nodes: tuple[tuple[str, bool], ...]
    edges: tuple[tuple[int, int, int, bool], ...] = ()

    @property
    def bound(self) -> int:
        return sum(b for _, b in self.nodes)

    def canonical(self) -> str:
        """Equal for isomorphic trees: the smallest string over all roots."""
        near: dict[int, list[tuple[int, str]]] = {i: [] for i in range(len(self.nodes))}
        for a, b, k, fwd in self.edges:
            near[a].append((b, f"{k}{'>' if fwd else '<'}"))
            near[b].append((a, f"{k}{'<' if fwd else '>'}"))

        def text(v: int, parent: int) -> str:
            name, is_bound = self.nodes[v]
            kids = sorted(label + text(u, v) for u, label in near[v] if u != parent)
            return f"{name}{'*' if is_bound else ''}({','.join(kids)})"

        return min(text(v, -1) for v in range(len(self.nodes)))

    def degree(self, v: int) -> int:
        return sum(v in (a, b) for a, b, _, _ in self.edges)

    def accepted(self) -> bool:
        """No leaf without a tuple set."""
        return all(is_bound or self.degree(v) > 1 for v, (_, is_bound) in enumerate(self.nodes)) and self.bound > 0

    def redundant(self, v: int) -> bool:
        """Whether dropping the keywords of v leaves all keywords covered: tuple sets hold all keywords or none."""
        return self.nodes[v][1] and self.bound > 1

    def size(self) -> int:
        return len(self.edges)


def networks(schema: Schema, with_tuples: set[str], n_keywords: int, max_joins: int = 5, cap: int | None = None) -> list[Network]:
    """Candidate networks breadth first: at most n_keywords bound variables, no two variables forced to one tuple.

    A variable can't reach two neighbours through one foreign key of its own, as both would be the same tuple.
    Isomorphic networks are kept once, before the cap applies.
    """
    seen: set[str] = set()
    out: list[Network] = []
    level = [Network(((r, True),)) for r in sorted(with_tuples)]
    while level:
        grown: list[Network] = []
        for n in level:
            name = n.canonical()
            if name in seen:
                continue
            seen.add(name)
            if n.accepted():
                out.append(n)
                if cap and len(out) >= cap:
                    return out
            if n.size() >= max_joins:
                continue
            for v, (rel, _) in enumerate(n.nodes):
                for k, to, forward in schema.edges(rel):
                    # two neighbours through one foreign key of a variable would be the same tuple
                    if forward and any(e[2] == k and ((e[0] == v and e[3]) or (e[1] == v and not e[3])) for e in n.edges):
                        continue
                    for is_bound in {False, to in with_tuples}:
                        if not is_bound or n.bound < n_keywords:
                            grown.append(Network((*n.nodes, (to, is_bound)), (*n.edges, (v, len(n.nodes), k, forward))))
        level = grown
    return out


def statistics(found: list[Network]) -> list[tuple[int, int, int]]:
    """(joins, bound variables, networks) counts."""
    count: dict[tuple[int, int], int] = {}
    for n in found:
        count[n.size(), n.bound] = count.get((n.size(), n.bound), 0) + 1
    return sorted((a, b, c) for (a, b), c in count.items())


def tuple_set(post: DataFrame, query: DataFrame, cap: int = 1000, cut: bool = False) -> DataFrame:
    """(qid, id, score): one relation's retrieval results."""
    run = rank.search(post, query, k=cap)
    return (rank.relative_cut(run) if cut else run).select("qid", "id", "score")


def rarest_keyword(post: DataFrame, query: DataFrame) -> DataFrame:
    """(qid, term): each query's keyword in the fewest tuples, ties to the smaller word."""
    df = query.select("qid", "term").join(post.groupBy("term").agg(F.count_distinct("id").alias("n")), "term", "left")
    return df.groupBy("qid").agg(F.min_by("term", F.struct(F.coalesce("n", F.lit(0)), "term")).alias("term"))


def exact_keyword_sets(post: DataFrame, query: DataFrame) -> DataFrame:
    """(qid, id, keywords): exactly the query's keywords that a tuple holds."""
    return post.join(query.select("qid", "term"), "term").groupBy("qid", "id").agg(F.array_sort(F.collect_set("term")).alias("keywords"))


def plan(network: Network, schema: Schema, tables: dict[str, DataFrame], tuples: dict[str, DataFrame]) -> DataFrame:
    """(qid, ids array<struct<rel, id>>, score): the network's join, score = sum of tuple scores / number of variables.

    Starts from a tuple set, so every join carries the query id and works on reduced inputs.  Variables of one relation
    hold different tuples.
    """
    start = next(v for v, (_, b) in enumerate(network.nodes) if b)

    def side(v: int) -> DataFrame:
        rel, is_bound = network.nodes[v]
        r = schema.relations[rel]
        keys = {k.column for k in schema.keys if k.source == rel} | {k.key for k in schema.keys if k.target == rel} | {r.key}
        df = tables[rel].select(*(F.col(c).alias(f"v{v}_{c}") for c in sorted(keys)))
        if is_bound:
            ts = tuples[rel].select(F.col("qid").alias(f"q{v}"), F.col("id").alias(f"t{v}"), F.col("score").alias(f"s{v}"))
            df = df.join(ts, F.col(f"v{v}_{r.key}") == F.col(f"t{v}")).drop(f"t{v}")
        return df

    out = side(start).withColumnRenamed(f"q{start}", "qid")
    done, left = {start}, list(network.edges)
    while left:
        a, b, k, forward = next(e for e in left if (e[0] in done) != (e[1] in done))
        left.remove((a, b, k, forward))
        fk = schema.keys[k]
        new = b if a in done else a
        src, dst = (a, b) if forward else (b, a)
        cond = F.col(f"v{src}_{fk.column}") == F.col(f"v{dst}_{fk.key}")
        if network.nodes[new][1]:
            cond = cond & (F.col("qid") == F.col(f"q{new}"))
        out = out.join(side(new), cond)
        done.add(new)
    key = lambda v: F.col(f"v{v}_{schema.relations[network.nodes[v][0]].key}")
    for v in range(len(network.nodes)):
        for u in range(v):
            if network.nodes[u][0] == network.nodes[v][0]:
                out = out.where(key(u) != key(v))
    score = reduce(lambda x, y: x + y, [F.col(f"s{v}") for v, (_, b) in enumerate(network.nodes) if b]) / len(network.nodes)
    ids = F.array(*[F.struct(F.lit(network.nodes[v][0]).alias("rel"), key(v).cast("long").alias("id")) for v in range(len(network.nodes))])
    return out.select("qid", ids.alias("ids"), F.round(score, 6).alias("score"))


def search(schema: Schema, tables: dict[str, DataFrame], tuples: dict[str, DataFrame], n_keywords: int, n: int = 20, max_joins: int = 5) -> DataFrame:
    """(qid, network, ids, score, rank): the n best joined results of each query over all networks."""
    found = networks(schema, set(tuples), n_keywords, max_joins)
    parts = [plan(c, schema, tables, tuples).withColumn("network", F.lit(c.canonical())) for c in found]
    every = reduce(DataFrame.unionByName, parts)
    text = F.array_join(F.transform("ids", lambda x: F.concat_ws(":", x["rel"], x["id"].cast("string"))), " ")
    # a symmetric network finds each result once per order of its equal variables
    every = every.withColumn("key", F.array_join(F.array_sort(F.transform("ids", lambda x: F.concat_ws(":", x["rel"], x["id"].cast("string")))), " ")).withColumn("id", text)
    once = every.groupBy("qid", "network", "key").agg(F.max("score").alias("score"))
    return rank.top_k(once.withColumnRenamed("key", "id").withColumn("id", F.concat_ws(" | ", "id", "network")), n)


def upper_bound(network: Network, best: dict[str, float]) -> float:
    """No result of the network scores more; best: the highest score in each tuple set."""
    return sum(best[r] for r, b in network.nodes if b) / len(network.nodes)


def search_bounded(schema: Schema, tables: dict[str, DataFrame], tuples: dict[str, DataFrame], n_keywords: int, n: int = 20, max_joins: int = 5) -> list:
    """The n best results of one query, running networks by falling upper bound and stopping when none can enter."""
    best = {r: (t.agg(F.max("score")).first()[0] or 0.0) for r, t in tuples.items()}
    order = sorted(networks(schema, set(tuples), n_keywords, max_joins), key=lambda c: (-upper_bound(c, best), c.canonical()))
    top: list = []
    for c in order:
        if len(top) >= n and top[n - 1]["score"] >= upper_bound(c, best):
            break
        rows = plan(c, schema, tables, tuples).orderBy(F.col("score").desc(), "ids").limit(n).collect()  # n rows at most
        top = sorted([*top, *rows], key=lambda r: -r["score"])[:n]
    return top


def result_roots(results: DataFrame, main: str) -> DataFrame:
    """(qid, rank, id): each result's node of the main relation, or its first node if it has none."""
    nodes = F.split(F.substring_index("id", " | ", 1), " ")
    own = F.filter(nodes, lambda x: F.startswith(x, F.lit(f"{main}:")))
    node = F.when(F.size(own) > 0, F.element_at(own, 1)).otherwise(F.element_at(nodes, 1))
    return results.select("qid", "rank", F.substring_index(node, ":", -1).alias("id"))
