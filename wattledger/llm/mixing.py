"""Hierarchical budgeting over a tree of domains, languages and sources, and the documents each leaf gives.

A budget of tokens goes down the tree.  At each node the children share it by weight; a child that has less than its
share gives what it has, and the rest is shared again among its siblings.  As a node's supply is the sum of its
children's, only what a whole subtree lacks is seen above it: siblings come before ancestors.  The shares are found in
closed form by sorting the children by supply per weight, so a level is one window over its nodes, not a loop.

A leaf's stream is its documents in an order drawn anew from the seed for each epoch.  The leaf gives whole epochs and
a prefix of the next one.  The prefix is found without sorting the leaf: its documents fall into about as many ranges of
the drawn number as each range has documents, and only the range in which the budget ends is sorted.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wattledger.llm.common import fresh
from wattledger.session import cut

#: Weights are whole numbers up to this, so that weight times tokens stays within 63 bits.
MAX_WEIGHT = 10_000
#: The mixture of query and pipeline: whole weights of domains, and of languages in each domain; others weigh 1.
WEIGHTS = [
    (("d0",), 4), (("d1",), 3), (("d2",), 2), (("d3",), 1),
    *[((d, lang), w) for d in ("d0", "d1", "d2", "d3") for lang, w in (("en", 5), ("de", 2), ("fr", 2), ("es", 1))],
]
PATH, SEED, MAX_EPOCHS = ["domain", "lang", "source"], 17, 2


def _on(a: str, b: str, columns: list[str]):
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in columns], F.lit(True))


def share(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Add ``budget``: each child's part of its parent's ``total``, by ``weight`` and at most its ``supply``.

    Parts are whole tokens and add up to the total (or to the supply, if that is less).  What rounding leaves goes one
    token each to the first children by supply per weight and name.
    """
    order = W.partitionBy(*parents, F.lit(0)).orderBy((F.col("supply") / F.col("weight")).asc(), F.col(name))
    ranked = children.filter("weight > 0").select(
        "*",
        (F.sum("supply").over(order.rowsBetween(W.unboundedPreceding, -1))).alias("given"),
        F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).alias("heft"),
        F.row_number().over(order).alias("place"),
    ).withColumn("left", F.col("total") - F.coalesce("given", F.lit(0)))
    ranked = ranked.withColumn("full", F.col("supply") * F.col("heft") <= F.col("left") * F.col("weight"))
    siblings = W.partitionBy(*parents, F.lit(0))
    open_ = F.when(~F.col("full"), F.struct("place", "left", "heft"))
    ranked = ranked.withColumn("at", F.min(open_).over(siblings))
    part = F.expr("(at.left * weight) div at.heft")
    ranked = ranked.withColumn("part", F.when(F.col("full"), F.col("supply")).otherwise(part))
    spare = F.col("total") - F.sum("part").over(siblings)
    extra = (~F.col("full")) & (F.col("place") - F.col("at.place") < spare)
    return ranked.withColumn("spare", spare).withColumn(
        "budget", F.col("part") + F.when(extra, 1).otherwise(0)
    ).drop("given", "heft", "place", "left", "full", "at", "part", "spare")


def budgets(leaves: DataFrame, path: list[str], weights: list[tuple[tuple[str, ...], int]], share_of_supply: float = 1.0,
            max_epochs: int = 1) -> DataFrame:
    """(path..., tokens, supply, budget) of each leaf; ``leaves`` has the path, weight-free, and ``tokens``.

    ``weights`` lists (path of a node, whole weight); a node that is not listed weighs 1, and one of weight 0 gives
    nothing.  The budget of the whole is ``share_of_supply`` of all tokens, rounded down, at most ``max_epochs`` times
    what leaves of positive weight have.
    """
    if any(not 0 <= w <= MAX_WEIGHT for _, w in weights):
        raise ValueError(f"weights must be from 0 to {MAX_WEIGHT}")
    nodes = leaves.withColumn("supply", F.col("tokens") * max_epochs)
    counts = F.lit(True)
    for depth in range(len(path)):
        given = [x for p, w in weights if len(p) == depth + 1 for x in (F.array(*map(F.lit, p)), F.lit(w).cast("bigint"))]
        weight = F.lit(1).cast("bigint")
        if given:
            weight = F.coalesce(F.try_element_at(F.create_map(*given), F.array(*path[: depth + 1])), weight)
        nodes = nodes.withColumn(f"w{depth}", weight)
        counts = counts & (F.col(f"w{depth}") > 0)
    nodes = cut(nodes.withColumn("supply", F.when(counts, F.col("supply")).otherwise(0)))
    sums = nodes.agg(F.sum("supply").alias("most"), F.sum("tokens").alias("all")).first()
    total = min(int(sums["most"] or 0), math.floor((sums["all"] or 0) * share_of_supply))
    above = None
    for depth in range(len(path)):
        names = path[: depth + 1]
        level = nodes.groupBy(*names, F.col(f"w{depth}").alias("weight")).agg(F.sum("supply").alias("supply"))
        if above is None:
            level = level.withColumn("total", F.lit(total).cast("bigint"))
        else:
            level = level.alias("n").join(above.alias("o"), _on("n", "o", path[:depth])).select("n.*", "o.total")
        above = share(level, path[:depth], path[depth]).select(*names, F.col("budget").alias("total"))
    done = nodes.alias("n").join(above.alias("o"), _on("n", "o", path), "left")
    return done.select(
        *[f"n.{c}" for c in path], "n.tokens", "n.supply", "n.docs", F.coalesce("o.total", F.lit(0)).alias("budget")
    )


def mix(docs: DataFrame, path: list[str], weights: list[tuple[tuple[str, ...], int]], key: str = "doc_id",
        tokens: str = "n_tokens", seed: int = 0, share_of_supply: float = 1.0, max_epochs: int = 1) -> DataFrame:
    """(key, path..., n_tokens, epochs, n_taken) of every row of ``docs``.

    ``epochs`` counts the whole epochs that take the document, ``n_taken`` the tokens that the last, partial epoch takes
    of it: all, the first so many of the document in which the budget ends, or 0.  A null in the path is the node ''; a
    null token count is 0.  The order of an epoch is that of md5('seed:epoch:key'), ties by tokens; repeated rows are
    documents of their own.  An empty table gives no rows.
    """
    docs = cut(docs.select(
        F.col(key).alias("k"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"p{i}") for i, c in enumerate(path)],
        F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("t"),
    ))
    names = [f"p{i}" for i in range(len(path))]
    leaves = docs.groupBy(*names).agg(F.sum("t").alias("tokens"), F.count("*").alias("docs"))
    plan = cut(
        budgets(leaves, names, weights, share_of_supply, max_epochs)
        .withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("bigint"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
        .withColumn("ranges", F.ceil(F.sqrt("docs")).cast("bigint"))
        .select(*names, "epochs", "rest", "ranges")
    )
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("epochs") + 1).cast("string"), F.coalesce(F.col("k").cast("string"), F.lit(""))))
    placed = (
        docs.alias("n").join(plan.alias("o"), _on("n", "o", names))
        .select("n.*", "o.epochs", "o.rest", "o.ranges").withColumn("drawn", drawn)
        .withColumn("range", F.shiftright(F.conv(F.substring("drawn", 1, 8), 16, 10).cast("bigint") * F.col("ranges"), 32))
    )
    running = W.partitionBy(*names).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    spans = (
        placed.groupBy(*names, "range").agg(F.sum("t").alias("sum"))
        .withColumn("before", F.coalesce(F.sum("sum").over(running), F.lit(0)))
    )
    # Joined by leaf and range, so a large leaf is dealt over its ranges.
    ready = placed.join(spans, [*names, "range"])
    ends = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("sum") > F.col("rest"))
    inside = W.partitionBy(*names, "range").orderBy("drawn", "t").rowsBetween(W.unboundedPreceding, -1)
    ending = ready.filter(ends).withColumn(
        "so_far", F.col("before") + F.coalesce(F.sum("t").over(inside), F.lit(0))
    ).withColumn("taken", F.greatest(F.lit(0), F.least("t", F.col("rest") - F.col("so_far"))))
    others = ready.filter(~ends).withColumn("taken", F.when(F.col("before") < F.col("rest"), F.col("t")).otherwise(0))
    columns = [
        F.col("k").alias(key), *[F.col(n).alias(c) for n, c in zip(names, path)], F.col("t").alias("n_tokens"),
        F.col("epochs"), F.col("taken").cast("bigint").alias("n_taken"),
    ]
    return ending.select(*columns).unionByName(others.select(*columns))


def selected(docs: DataFrame, path: list[str], weights: list[tuple[tuple[str, ...], int]], key: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs``, each as often as epochs take it.

    The document in which a budget ends is taken whole: texts are not cut.  Rows with the same key are taken alike, by
    the largest of their numbers.
    """
    taken, times = fresh(docs, "taken_key", "times")
    chosen = (
        mix(docs, path, weights, key, **how)
        .groupBy(F.col(key).alias(taken)).agg(F.max(F.col("epochs") + (F.col("n_taken") > 0).cast("bigint")).alias(times))
        .filter(F.col(times) > 0)
    )
    return docs.join(chosen, F.col(key).eqNullSafe(F.col(taken))).withColumn(
        times, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times)))
    ).drop(taken, times)


def sql(weights: list[tuple[tuple[str, ...], int]], seed: int, max_epochs: int) -> str:
    """DuckDB SQL for the rows of ``mix`` over documents by domain, language and source, whole leaves sorted."""
    def level(depth: int) -> str:
        rows = ", ".join(f"({', '.join(repr(x) for x in p)}, {w})" for p, w in weights if len(p) == depth)
        names = ", ".join(("domain", "lang", "source")[:depth])
        if not rows:
            return f"SELECT {names}, 1 AS weight FROM leaf WHERE false"
        return f"SELECT * FROM (VALUES {rows}) v({names}, weight)"

    def shared(name: str, parent: str, children: str, keys: str, order: str) -> str:
        part = f"PARTITION BY {keys}" if keys else ""
        return f"""
{name}_a AS (SELECT *, total - coalesce(sum(supply) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heft, row_number() OVER w AS place
  FROM ({children}) WINDOW w AS ({part} ORDER BY supply / weight, {order})),
{name}_b AS (SELECT *, supply * heft <= rest * weight AS done FROM {name}_a),
{name}_c AS (SELECT *, min(CASE WHEN NOT done THEN place END) OVER ({part}) AS low FROM {name}_b),
{name}_d AS (SELECT *, max(CASE WHEN place = low THEN rest END) OVER ({part}) AS r, max(CASE WHEN place = low THEN heft END) OVER ({part}) AS h FROM {name}_c),
{name}_e AS (SELECT *, CASE WHEN done THEN supply ELSE (r * weight) // h END AS piece FROM {name}_d),
{name} AS (SELECT *, piece + CASE WHEN NOT done AND place - low < total - sum(piece) OVER ({part}) THEN 1 ELSE 0 END AS budget FROM {name}_e)"""

    return f"""
WITH doc AS (SELECT doc_id, CASE WHEN digits = '' THEN '' ELSE 'd' || CAST(CAST(digits AS INTEGER) % 4 AS VARCHAR) END AS domain, lang, source, t
  FROM (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS digits,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS HUGEINT) AS t FROM documents)),
leaf AS (SELECT domain, lang, source, sum(t) AS tokens, sum(t) * {max_epochs} AS supply FROM doc GROUP BY ALL),
w1 AS ({level(1)}), w2 AS ({level(2)}), w3 AS ({level(3)}),
node AS (SELECT leaf.*, CAST(coalesce(w1.weight, 1) AS HUGEINT) AS a, CAST(coalesce(w2.weight, 1) AS HUGEINT) AS b, CAST(coalesce(w3.weight, 1) AS HUGEINT) AS c
  FROM leaf LEFT JOIN w1 USING (domain) LEFT JOIN w2 USING (domain, lang) LEFT JOIN w3 USING (domain, lang, source)),
one AS (SELECT domain, any_value(a) AS weight, sum(supply) AS supply, (SELECT least(sum(supply), sum(tokens)) FROM node) AS total FROM node GROUP BY domain),
{shared("x1", "", "SELECT * FROM one", "", "domain")},
{shared("x2", "x1", "SELECT n.domain, n.lang, any_value(b) AS weight, sum(n.supply) AS supply, any_value(x1.budget) AS total FROM node n JOIN x1 USING (domain) GROUP BY ALL", "domain", "lang")},
{shared("x3", "x2", "SELECT n.domain, n.lang, n.source, c AS weight, n.supply, x2.budget AS total FROM node n JOIN x2 USING (domain, lang)", "domain, lang", "source")},
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs,
  CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM leaf JOIN x3 USING (domain, lang, source)),
run AS (SELECT doc.*, epochs, rest, coalesce(sum(t) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || CAST(epochs + 1 AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), t
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM doc JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, CAST(t AS BIGINT) AS n_tokens, CAST(epochs AS BIGINT) AS epochs, CAST(greatest(0, least(t, rest - before)) AS BIGINT) AS n_taken FROM run"""
