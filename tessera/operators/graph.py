"""Threads and branches (G1 to G8): pointer doubling over parent links, never a walk per conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.lineage import cut

MAX_ROUNDS = 40


def _doubled(pointers: DataFrame, key: list[str]) -> DataFrame:
    """Follow pointers to their end: (``key``, node, to, dist) with to = the last node and dist steps.

    ``pointers`` has (key, node, to, dist) with to null at an end. Each round joins the table with
    itself and doubles the steps taken, so a chain of n nodes takes log2(n) rounds. Nodes on a cycle
    never end; when a round ends no further node, they get a null ``to`` and are left.
    """
    now = cut(pointers.withColumn("done", F.col("to").isNull()).withColumn("to", F.coalesce("to", "node")))
    open_now = now.filter("not done").count()
    for _ in range(MAX_ROUNDS):
        if not open_now:
            break
        step = now.select(*key, F.col("node").alias("to"), F.col("to").alias("__to"), F.col("dist").alias("__dist"), F.col("done").alias("__done"))
        moved = now.filter("not done").join(step, [*key, "to"], "left")
        moved = moved.select(
            *key,
            "node",
            F.coalesce("__to", "to").alias("to"),
            (F.col("dist") + F.coalesce("__dist", F.lit(0))).alias("dist"),
            F.coalesce("__done", F.lit(True)).alias("done"),
        )
        now = cut(now.filter("done").unionByName(moved))
        # A cycle's distances grow without end; a chain's can't pass the number of nodes.
        before, open_now = open_now, now.filter("not done").count()
        if open_now == before:
            limit = now.groupBy(*key).agg(F.count("*").alias("__n"))
            now = now.join(limit, key).withColumn("stuck", ~F.col("done") & (F.col("dist") > F.col("__n"))).drop("__n")
            open_now = now.filter("not done and not stuck").count()
            now = now.withColumn("to", F.when(~F.col("stuck"), F.col("to"))).withColumn("done", F.col("done") | F.col("stuck")).drop("stuck")
    if open_now:
        raise RuntimeError(f"{open_now} nodes have no end after {MAX_ROUNDS} rounds")
    return now.filter("done").drop("done")


def valid_parents(nodes: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Nodes (key, node, parent, ord, ...) whose parent isn't in the same conversation get a null one."""
    ids = nodes.select(key, F.col("node").alias("parent"), F.lit(True).alias("__there")).distinct()
    joined = nodes.join(ids, [key, "parent"], "left")
    return joined.withColumn("parent", F.when(F.col("__there"), F.col("parent"))).drop("__there")


def _reachable(nodes: DataFrame, key: str) -> DataFrame:
    """Nodes below the first root (by ord, node) of each conversation."""
    roots = nodes.filter("parent is null").groupBy(key).agg(F.min_by("node", F.struct("ord", "node")).alias("root"))
    ends = _doubled(nodes.select(key, "node", F.col("parent").alias("to"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("dist")), [key])
    return nodes.join(ends.select(key, "node", F.col("to").alias("end")), [key, "node"]).join(roots, key).filter(F.col("end") == F.col("root")).drop("end")


def branch_members(nodes: DataFrame, key: str = "conversation_id") -> DataFrame:
    """G1: (key, node, head, depth, root, parent) of every node below the first root.

    A node heads a branch if it is the root or its parent has two children or more; others belong to
    their parent's branch. depth counts from the head.
    """
    there = cut(_reachable(valid_parents(nodes, key), key))
    children = there.filter("parent is not null").groupBy(key, F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    fork = children.filter("children > 1").select(key, F.col("node").alias("parent"), F.lit(True).alias("__fork"))
    marked = there.join(fork, [key, "parent"], "left")
    head = F.col("parent").isNull() | F.col("__fork").isNotNull()
    links = marked.select(key, "node", F.when(~head, F.col("parent")).alias("to"), F.when(head, 0).otherwise(1).cast("long").alias("dist"))
    heads = _doubled(links, [key]).select(key, "node", F.col("to").alias("head"), F.col("dist").alias("depth"))
    return cut(there.join(heads, [key, "node"]))


def branch_id(conversation: Column, head: Column, root: Column) -> Column:
    return F.concat(conversation.cast("string"), F.lit("_"), F.when(head == root, "main").otherwise(head.cast("string")))


def branch_forks(nodes: DataFrame, current: DataFrame, key: str = "conversation_id") -> DataFrame:
    """G1: fork-split branches. ``current`` has (key, current_node); a missing one leaves all inactive.

    Returns key, branch_id, root_message_id, leaf_message_id (the deepest), is_active,
    parent_branch_id, n_messages.
    """
    members = branch_members(nodes, key)
    named = members.withColumn("branch_id", branch_id(F.col(key), F.col("head"), F.col("root")))
    active = named.join(current.select(key, F.col("current_node").alias("node")), [key, "node"], "left_semi").select(key, "branch_id").distinct()
    each = named.groupBy(key, "branch_id").agg(
        F.min_by("node", F.struct("depth", "node")).alias("root_message_id"),
        F.max_by("node", F.struct("depth", "node")).alias("leaf_message_id"),
        F.min_by("parent", F.struct("depth", "node")).alias("__fork"),
        F.count("*").alias("n_messages"),
    )
    above = named.select(key, F.col("node").alias("__fork"), F.col("branch_id").alias("parent_branch_id"))
    return (
        each.join(above, [key, "__fork"], "left")
        .join(active.withColumn("__active", F.lit(True)), [key, "branch_id"], "left")
        .select(
            key, "branch_id", "root_message_id", "leaf_message_id", F.coalesce("__active", F.lit(False)).alias("is_active"),
            "parent_branch_id", "n_messages",
        )
    )


def unreachable_nodes(nodes: DataFrame, key: str = "conversation_id") -> DataFrame:
    """G1 quality figure: nodes that no branch holds, for each conversation that has some."""
    members = branch_members(nodes, key).select(key, "node")
    return nodes.join(members, [key, "node"], "left_anti").groupBy(key).agg(F.count("*").alias("unreachable"))


def leaf_traced(nodes: DataFrame, current: DataFrame, key: str = "conversation_id", walk: str = "first") -> DataFrame:
    """The path to the current leaf is the main branch, what hangs off it are residual ones.

    Without a valid current leaf the main branch goes from the first root along each first
    (``walk="first"``) or last child. A residual branch is a connected rest; its id is its
    first-listed member, its leaf the end of the last children, its parent the main branch if it
    hangs off that. Returns key, branch_id, root_message_id, leaf_message_id, is_active,
    parent_branch_id, n_messages.
    """
    nodes = cut(valid_parents(nodes, key).select(key, "node", "parent", "ord"))
    order = F.struct("ord", "node")
    pick = F.min_by if walk == "first" else F.max_by
    # Where the walk from a node along its first (last) children ends.
    next_child = nodes.filter("parent is not null").groupBy(key, F.col("parent").alias("node"))
    ends = lambda by: _doubled(
        nodes.select(key, "node")
        .join(next_child.agg(by("node", order).alias("to")), [key, "node"], "left")
        .withColumn("dist", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long")),
        [key],
    ).select(key, "node", F.col("to").alias("end"))
    roots = nodes.filter("parent is null").groupBy(key).agg(F.min_by("node", order).alias("node"))
    fallback = roots.join(ends(pick), [key, "node"], "left").select(key, F.coalesce("end", "node").alias("fallback"))
    given = nodes.join(current.select(key, F.col("current_node").alias("node")), [key, "node"], "left_semi").select(key, F.col("node").alias("leaf"))
    leaves = fallback.join(given, key, "left").select(key, F.coalesce("leaf", "fallback").alias("leaf"))

    # Ancestors of the leaf: the frontier doubles with the jump table.
    jump = cut(nodes.select(key, "node", F.col("parent").alias("to")))
    main = cut(leaves.select(key, F.col("leaf").alias("node")))
    size = main.count()
    for _ in range(MAX_ROUNDS):
        more = main.join(jump, [key, "node"]).filter("to is not null").select(key, F.col("to").alias("node"))
        main = cut(main.union(more).distinct())
        far = jump.select(key, F.col("node").alias("to"), F.col("to").alias("__far"))
        jump = cut(jump.join(far, [key, "to"], "left").select(key, "node", F.col("__far").alias("to")))
        before, size = size, main.count()
        if size == before:
            break

    on_main = main.withColumn("on_main", F.lit(True))
    placed = nodes.join(on_main, [key, "node"], "left").withColumn("on_main", F.coalesce("on_main", F.lit(False)))
    main_ids = main.select(key, F.col("node").alias("parent"), F.lit(True).alias("__main_parent"))
    rest = placed.filter("not on_main").join(main_ids, [key, "parent"], "left")
    links = rest.select(
        key, "node", F.when(F.col("__main_parent").isNull(), F.col("parent")).alias("to"),
        F.when(F.col("__main_parent").isNull() & F.col("parent").isNotNull(), 1).otherwise(0).cast("long").alias("dist"),
    )
    tops = _doubled(links, [key]).select(key, "node", F.col("to").alias("top"))
    last = ends(F.max_by)
    hung = rest.select(key, F.col("node").alias("top"), F.col("__main_parent").isNotNull().alias("hung"))
    residual = rest.join(tops, [key, "node"]).groupBy(key, "top").agg(F.min_by("node", order).alias("first"), F.count("*").alias("n_messages"))
    residual = residual.join(hung, [key, "top"]).join(last.withColumnRenamed("node", "top"), [key, "top"])
    name = F.col(key).cast("string")
    main_name = F.concat(name, F.lit("_main"))
    spine = placed.filter("on_main").groupBy(key).agg(F.count("*").alias("n_messages"))
    top_of = placed.filter("on_main and parent is null").select(key, F.col("node").alias("root_message_id"))
    first = spine.join(leaves, key).join(top_of, key, "left").select(
        key, main_name.alias("branch_id"), "root_message_id", F.col("leaf").alias("leaf_message_id"), F.lit(True).alias("is_active"),
        F.lit(None).cast("string").alias("parent_branch_id"), "n_messages",
    )
    others = residual.select(
        key, F.concat(name, F.lit("_"), F.col("first").cast("string")).alias("branch_id"), F.col("top").alias("root_message_id"),
        F.col("end").alias("leaf_message_id"), F.lit(False).alias("is_active"), F.when(F.col("hung"), main_name).alias("parent_branch_id"), "n_messages",
    )
    return first.unionByName(others)


def single_branches(conversations: DataFrame, messages: DataFrame, order: list[str], key: str = "conversation_id") -> DataFrame:
    """One main branch for each conversation, from its first to its last message by ``order``.

    A conversation without messages keeps empty message ids.
    """
    place = F.struct(*order)
    ends = messages.groupBy(key).agg(F.min_by("message_id", place).alias("root"), F.max_by("message_id", place).alias("leaf"))
    return conversations.join(ends, key, "left").select(
        key, F.concat(F.col(key).cast("string"), F.lit("_main")).alias("branch_id"), F.coalesce("root", F.lit("")).alias("root_message_id"),
        F.coalesce("leaf", F.lit("")).alias("leaf_message_id"), F.lit(True).alias("is_active"), F.lit(None).cast("string").alias("parent_branch_id"),
    )


def chain_pointers(events: DataFrame) -> DataFrame:
    """(file, previous): a file continues the session that its first line names, if that isn't itself.

    ``events`` has (file, line, session).
    """
    first = events.filter("session is not null").groupBy("file").agg(F.min_by("session", "line").alias("previous"))
    return first.select("file", F.when(F.col("previous") != F.col("file"), F.col("previous")).alias("previous"))


def chain_roots(pointers: DataFrame) -> DataFrame:
    """(file, root, in_cycle): the start of each file's chain.

    A pointer to a file that isn't there ends at that id. Files that run into a cycle get the smallest
    id of what they reach as their root, and are marked.
    """
    one = pointers.select(F.lit(0).alias("all"), F.col("file").alias("node"), F.col("previous").alias("to"))
    found = _doubled(one.withColumn("dist", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long")), ["all"]).drop("all")
    fine = found.filter("to is not null").select(F.col("node").alias("file"), F.col("to").alias("root"), F.lit(False).alias("in_cycle"))
    lost = found.filter("to is null").select(F.col("node").alias("file"))
    low = cut(lost.join(pointers, "file").select("file", F.least("file", "previous").alias("root"), F.col("previous")))
    for _ in range(MAX_ROUNDS):
        ahead = low.select(F.col("file").alias("previous"), F.col("root").alias("__root"), F.col("previous").alias("__next"))
        nxt = low.join(ahead, "previous", "left").select(
            "file", F.least("root", F.coalesce("__root", "root")).alias("root"), F.coalesce("__next", "previous").alias("previous")
        )
        before, low = low, cut(nxt)
        if low.select("file", "root").exceptAll(before.select("file", "root")).isEmpty():
            break
    return fine.unionByName(low.select("file", "root", F.lit(True).alias("in_cycle")))


def merge_chains(conversations: DataFrame, roots: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations and messages of one chain as one: counts add up, the time window widens, the
    first known title and project stay, messages are numbered through.

    ``conversations`` has (conversation_id, file_ord, title, project, created_at, updated_at, message_count).
    """
    root = roots.select(F.col("file").alias("conversation_id"), "root")
    rows = conversations.join(root, "conversation_id", "left").withColumn("root", F.coalesce("root", "conversation_id"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("file_ord", "conversation_id"))).alias(c)
    merged = rows.groupBy(F.col("root").alias("conversation_id")).agg(
        first("title"), first("project"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"),
        F.sum("message_count").alias("message_count"), F.count("*").alias("files"),
    )
    own = messages.join(rows.select("conversation_id", "root", "file_ord"), "conversation_id")
    through = Window.partitionBy("root").orderBy("file_ord", "conversation_id", "sequence")
    numbered = own.withColumn("sequence", F.row_number().over(through).cast("long"))
    return merged, numbered.drop("conversation_id", "file_ord").withColumnRenamed("root", "conversation_id")


def parent_stubs(children: DataFrame, known: DataFrame, side: DataFrame) -> DataFrame:
    """Conversations that only their children name, made from side metadata.

    ``children`` has (conversation_id, parent_session_id), ``known`` and ``side`` have
    (conversation_id, title, created_at, message_count); known rows get their blanks and an older start.
    """
    named = children.filter("parent_session_id is not null").select(F.col("parent_session_id").alias("conversation_id")).distinct()
    extra = side.select("conversation_id", *[F.col(c).alias(f"__{c}") for c in ("title", "created_at", "message_count")])
    lost = named.join(known, "conversation_id", "left_anti").join(extra, "conversation_id", "left")
    stubs = lost.select("conversation_id", *[F.col(f"__{c}").alias(c) for c in ("title", "created_at", "message_count")], F.lit(True).alias("is_stub"))
    kept = known.join(extra, "conversation_id", "left").select(
        "conversation_id", F.coalesce("title", "__title").alias("title"), F.least("created_at", "__created_at").alias("created_at"),
        F.coalesce("message_count", "__message_count").alias("message_count"), F.lit(False).alias("is_stub"),
    )
    return kept.unionByName(stubs)


def link_to_roots(sessions: DataFrame, roots: DataFrame) -> DataFrame:
    """Sub-sessions point to the root of their parent's chain and are talks between machines."""
    root = roots.select(F.col("file").alias("parent_session_id"), F.col("root").alias("__root"))
    return (
        sessions.join(root, "parent_session_id", "left")
        .withColumn("parent_session_id", F.coalesce("__root", "parent_session_id"))
        .withColumn("interaction_type", F.when(F.col("parent_session_id").isNotNull(), "ai_ai").otherwise("human_ai"))
        .drop("__root")
    )
