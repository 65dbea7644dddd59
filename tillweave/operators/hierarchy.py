"""Parent/child trees walked level by level.

Each round joins the current level to the node table once. The level is written to the shared
folder between rounds, so lineage stays short and a lost executor repeats one round only. A path
of visited ids stops a ring: the row that would repeat is dropped, the row before it is kept.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.operators.scalars import beside
from tillweave.session import stash


def hierarchy(
    df: DataFrame,
    id: str,
    parent: str,
    start: Column | None = None,
    direction: str = "down",
    paths: dict[str, tuple[str, str]] | None = None,
    roots: dict[str, str] | None = None,
    prior: dict[str, str] | None = None,
    sort: list[str] | None = None,
    max_depth: int | None = None,
) -> DataFrame:
    """Every (start row, reached row) pair with `level`, `is_leaf` and `is_cycle`.

    `paths` maps a name to (column, separator): separator-prefixed values from the start row.
    `roots` maps a name to the column of the start row, `prior` to the column of the row one
    step before. `sort` adds `sort_path`, an array whose order is depth first with siblings by
    those columns. `direction="up"` climbs from the start rows to their ancestors.
    """
    paths, roots, prior, sort = paths or {}, roots or {}, prior or {}, sort or []
    df = stash(df)  # every round reads the nodes; their plan runs once
    down = direction == "down"
    node_id, link = (id, parent) if down else (parent, id)
    # `link` of the next row must equal `node_id` of the current one
    first = df.filter(start if start is not None else F.col(parent).isNull())

    def key_struct(prefix: str = "") -> Column:
        return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in sort]) if sort else None

    level = first.select(
        *df.columns,
        F.lit(1).alias("level"),
        F.array(F.col(id)).alias("_seen"),
        F.array(F.col(parent)).alias("_seen_parents"),
        *[F.concat(F.lit(sep), F.col(c)).alias(n) for n, (c, sep) in paths.items()],
        *[F.col(c).alias(n) for n, c in roots.items()],
        *[F.lit(None).cast(df.schema[c].dataType).alias(n) for n, c in prior.items()],
        *([F.array(key_struct()).alias("sort_path")] if sort else []),
    )
    nodes = df.select(*[F.col(c).alias(f"_n_{c}") for c in df.columns])
    done: list[DataFrame] = []
    level = stash(level)
    for depth in count(1):  # ends: no path holds an id twice
        if level.isEmpty():
            break
        done.append(level)
        if max_depth is not None and depth >= max_depth:
            break
        step = level.join(nodes, F.col(node_id) == F.col(f"_n_{link}")).filter(
            ~F.array_contains("_seen", F.col(f"_n_{id}"))
        )
        level = stash(step.select(
            *[F.col(f"_n_{c}").alias(c) for c in df.columns],
            (F.col("level") + 1).alias("level"),
            F.concat("_seen", F.array(f"_n_{id}")).alias("_seen"),
            F.concat("_seen_parents", F.array(f"_n_{parent}")).alias("_seen_parents"),
            *[F.concat(F.col(n), F.lit(sep), F.col(f"_n_{c}")).alias(n) for n, (c, sep) in paths.items()],
            *[F.col(n) for n in roots],
            *[F.col(c).alias(n) for n, c in prior.items()],
            *([F.concat("sort_path", F.array(key_struct("_n_"))).alias("sort_path")] if sort else []),
        ))
    out = done[0] if done else level
    for more in done[1:]:
        out = out.unionByName(more)
    if down:
        # children met again on the own path do not count: the row is a leaf of this walk
        kids = df.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_kid_of")).agg(
            F.count("*").alias("_kids"))
        out = out.join(kids, F.col(id) == F.col("_kid_of"), "left")
        again = F.size(F.filter("_seen_parents", lambda p: p == F.col(id)))
        out = out.withColumns({
            "is_leaf": F.when(F.coalesce("_kids", F.lit(0)) - again <= 0, 1).otherwise(0),
            "is_cycle": F.when(again > 0, 1).otherwise(0),
        }).drop("_kid_of", "_kids")
    else:
        up = df.select(F.col(id).alias("_up"))
        out = out.join(up, F.col(parent) == F.col("_up"), "left")
        again = F.array_contains("_seen", F.col(parent))
        out = out.withColumns({
            "is_leaf": F.when(F.col("_up").isNull() | again, 1).otherwise(0),
            "is_cycle": F.when(again, 1).otherwise(0),
        }).drop("_up")
    return out.drop("_seen", "_seen_parents")


def order_siblings(df: DataFrame) -> DataFrame:
    """Depth-first order with siblings by their sort keys."""
    return df.orderBy(F.col("sort_path").asc_nulls_last())


def path_all(df: DataFrame, id: str, parent: str, name: str, sep: str = " > ",
             ambiguous: str = "(ambiguous)") -> DataFrame:
    """One path per node from its root; a node reached along several paths is ambiguous."""
    walked = hierarchy(df.select(id, parent, name), id, parent, paths={"path": (name, sep)})
    trimmed = walked.select(id, F.col("path").substr(F.lit(len(sep) + 1), F.length("path")).alias("path"))
    one = trimmed.groupBy(id).agg(F.min("path").alias("path"), F.count("*").alias("_n"))
    return one.select(id, F.when(F.col("_n") > 1, ambiguous).otherwise(F.col("path")).alias("path"))


def climb(df: DataFrame, id: str, parent: str, start: dict[str, Column], join: dict[str, Column], rounds: int | None = None) -> DataFrame:
    """Fold the ancestors of every node by pointer doubling: one row per node, as many rounds as the
    logarithm of the depth.

    A row holds the values of the nodes from itself up to, and without, `_up`. `start` are those of
    the node alone; a round puts `join` of the own values and those of the row of `_up`, named
    `_up_<name>`, in their place. `_up` is NULL at the end of a climb; what is not at its end after
    `rounds` (by default enough for all nodes in one line) goes on or runs in a ring. Ids are unique.
    """
    known = df.select(F.col(id).alias("_there"))
    there = df.join(known, F.col(parent) == F.col("_there"), "left")
    state = stash(there.select(F.col(id), F.col("_there").alias("_up"), *[c.alias(n) for n, c in start.items()]))
    if rounds is None:
        rounds = max(1, state.count()).bit_length()
    for _ in range(rounds):
        if state.filter(F.col("_up").isNotNull()).isEmpty():
            break
        above = state.select(F.col(id).alias("_above"), F.col("_up").alias("_next"), *[F.col(n).alias(f"_up_{n}") for n in start])
        both = state.join(above, F.col("_up") == F.col("_above"), "left")
        more = F.col("_above").isNotNull()
        state = stash(both.select(id, F.when(more, F.col("_next")).alias("_up"), *[F.when(more, c).otherwise(F.col(n)).alias(n) for n, c in join.items()]))
    return state


def depth_all(df: DataFrame, id: str, parent: str) -> DataFrame:
    """Depth of every node: how many rows a climb from it meets, each once. Nodes below or on a ring,
    which no climb leaves, are walked row by row; they are the damaged part of the tree alone."""
    base = stash(df.select(id, parent))
    folded = climb(base, id, parent, {"depth": F.lit(1)}, {"depth": F.col("depth") + F.col("_up_depth")})
    whole = folded.filter(F.col("_up").isNull()).select(id, "depth")
    ringed = folded.filter(F.col("_up").isNotNull()).select(id)
    if ringed.isEmpty():
        return whole
    walked = hierarchy(base.join(ringed, id, "left_semi"), id, parent, start=F.lit(True), direction="up", roots={"_of": id})
    return whole.unionByName(walked.groupBy(F.col("_of").alias(id)).agg(F.max("level").alias("depth")))


def leaves(df: DataFrame, id: str, parent: str, root) -> DataFrame:
    """Nodes without children below `root`."""
    walked = hierarchy(df.select(id, parent), id, parent, start=F.col(id) == F.lit(root))
    return walked.filter(F.col("is_leaf") == 1).select(id)


def cycle_report(df: DataFrame, id: str, parent: str) -> DataFrame:
    """One row: node, root, self-parent, dangling-parent, reached and unreached counts."""
    base = df.select(id, parent)
    reached = hierarchy(base, id, parent).select(id).distinct()
    known = base.select(F.col(id).alias("_up")).distinct()
    dangling = base.filter(F.col(parent).isNotNull()).join(known, F.col(parent) == F.col("_up"), "left_anti")
    one = lambda f, n: f.agg(F.count("*").alias(n))
    shape = base.agg(
        F.count("*").alias("nodes"),
        F.count_if(F.col(parent).isNull()).alias("roots"),
        F.count_if(F.col(parent) == F.col(id)).alias("self_parents"),
    )
    out = beside(beside(shape, one(dangling, "dangling")), one(reached, "reached"))
    return out.withColumn("unreached", F.col("nodes") - F.col("reached"))


def on_ring(df: DataFrame, id: str, parent: str) -> DataFrame:
    """Nodes that lie on a ring, found by peeling: a node whose children are all peeled is peeled,
    and what remains besides the tails above the ring is the ring. Only nodes never reached from
    a root are considered, so the loop runs over the damaged part alone."""
    base = df.select(id, parent)
    reached = hierarchy(base, id, parent).select(F.col(id).alias("_ok"))
    rest = stash(base.join(reached, F.col(id) == F.col("_ok"), "left_anti"))
    held = rest.count()
    while held:
        ups = rest.select(F.col(id).alias("_up"))
        alive = rest.join(ups, F.col(parent) == F.col("_up"), "left_semi")
        parents = rest.select(F.col(parent).alias("_p"))
        alive = stash(alive.join(parents, F.col(id) == F.col("_p"), "left_semi"))
        left = alive.count()
        if left == held:
            break
        rest, held = alive, left
    return rest.select(id)
