"""Prefix trie of conversations: radix trees over turn ids in big-endian order.

A turn's id is the first 16 bytes of the SHA-256 of its role and text, then four with the size of the
text. Equal turns have equal ids wherever they stand, so no text is shuffled. A conversation is the
string of its turns' ids; all strings are dealt out by ranges, and each range becomes one adaptive
radix tree (``radix_tree.RadixTree``), from which only depths of whole turns emit nodes.

Only nodes on the path to the first or last string of a range can also stand in another range. Each
range is told its neighbours' nearest strings: it counts a node as new, and so as a child of its
parent and with the bytes of its turn, only where the range before does not hold it, and a leaf only
where the range after does not go on from it. All other figures add up, so such nodes are merged by
a sum. A prefix that a third of all conversations share thus spreads over many ranges, and equal
conversations meet as one string with a count.

Rows without a conversation id are left out; null role or text is empty; turns order by number, null
first, equal numbers by id, and repeated rows are turns of their own. An empty table gives no node.
Ids below zero have their remainder towards zero. Further columns are not read. A text of any length
is read once, for its id and size; one conversation's ids (20 bytes a turn) have to fit a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from marketspark.llm.common import materialize, text_of
from marketspark.llm.radix_tree import RadixTree

WIDTH = 20  # bytes of a turn id
SIZE_AT = 16  # from here on they are the size of the text
GROUP = 5  # conversations that share the first turns of one
HEAD = 9  # a conversation takes fewer turns of it
RANGE_MB = 16  # strings in one range at about most; bounds a task's memory
BLOCK = 12  # bits: so many neighbouring conversation ids are listed in one piece
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODES = {
    "range": "int", "prefix": "binary", "parent": "binary", "edge": "boolean", "parent_edge": "boolean", "depth": "long", "conv_id": "long",
    "parent_conv_id": "long", "n_convs": "long", "n_children": "long", "n_leaves": "long", "saved_tokens": "long", "ends_sha256": "string",
}
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_id(role: Column, text: Column) -> Column:
    """In hexadecimal; the role's length keeps role and text apart."""
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(told, 256), 1, 2 * SIZE_AT), F.lpad(F.hex(F.octet_length(text)), 2 * (WIDTH - SIZE_AT), "0"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``(conv_id, string)``: the first turns of the group's first conversation, then the own ones after as many.

    Both sides of the join are dealt out by the group, at most five conversations, in one shuffle.
    """
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", turn_id(text_of("role"), text_of("text")).alias("id"))
    own = (
        conversations.where(F.col("conv_id").isNotNull())
        .select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
        .select((F.col("conv_id") - F.col("conv_id") % GROUP).alias("first"), "conv_id", "turn")
        .repartition("first")
        .groupBy("first", "conv_id")
        .agg(F.array_sort(F.collect_list("turn")).alias("turns"))
        .select("first", "conv_id", F.col("turns.id").alias("ids"))
    )
    heads = own.where(F.col("conv_id") == F.col("first")).select("first", F.slice("ids", 1, HEAD).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string")) % HEAD).cast("int")
    rest = F.slice("ids", taken + 1, F.size("ids"))
    ids = F.concat(F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), taken), rest)
    return own.join(heads, "first", "left").select("conv_id", F.unhex(F.array_join(ids, "")).alias("string"))


def distinct_strings(strings: DataFrame) -> DataFrame:
    """``(string, n, least, ends)``: each string once, its members, the least of them, the digest of their ids.

    A digest reads its ids in order. They are first listed in blocks, in parallel, so that a string of
    very many members sends few rows to the task that feeds them to the digest one after the other.
    """
    blocks = (
        strings.select(F.unhex(F.sha2("string", 256)).alias("string_id"), "conv_id", F.shiftright("conv_id", BLOCK).alias("block"))
        .groupBy("string_id", "block")
        .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
        .select("string_id", "block", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("least"), F.array_join("ids", ",").alias("listed"))
    )

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, of, n, least, running = ["n", "least", "ends"], None, 0, 0, None
        for batch in batches:
            done = []
            for string_id, count, first, listed in zip(batch["string_id"], batch["n"], batch["least"], batch["listed"]):
                if string_id == of:
                    running.update(b",")
                else:
                    if of is not None:
                        done.append((n, least, running.hexdigest()))
                    of, n, least, running = string_id, 0, first, hashlib.sha256()
                running.update(listed.encode())
                n += count
            yield pd.DataFrame(done, columns=columns)
        if of is not None:
            yield pd.DataFrame([(n, least, running.hexdigest())], columns=columns)

    members = (
        blocks.repartition("string_id")
        .sortWithinPartitions("string_id", "block")
        .select("string_id", "n", "least", "listed")
        .mapInPandas(digest, "n long, least long, ends string")
    )
    return members.join(strings, F.col("least") == F.col("conv_id")).select("string", "n", "least", "ends")


def _shared_turns(a: bytes, b: bytes) -> int:
    n = 0
    while (turn := a[n * WIDTH : (n + 1) * WIDTH]) and turn == b[n * WIDTH : (n + 1) * WIDTH]:
        n += 1
    return n


def range_nodes(key: tuple, strings: pd.DataFrame, bounds: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one range, with the figures this range adds to them."""
    columns = list(NODES)
    if not len(strings):
        return pd.DataFrame(columns=columns)
    first, last, before, after = (bounds[c].iloc[0] for c in ("first", "last", "before", "after"))
    held_before = -1 if before is None else _shared_turns(first, before)  # to this depth the first path also stands there
    goes_on = after is not None and after.startswith(last)
    tree = RadixTree()
    for string, n, least, digest in zip(strings["string"], strings["n"], strings["least"], strings["ends"]):
        tree.insert(string, (n, least, digest, string == last and goes_on))

    rows: list[dict] = []
    above: list[int] = []  # row of the parent
    added: list[tuple[int, bool]] = []  # bytes of the last text, and whether the node is new here

    def emit(parent: int, running, size: int, depth: int, on_first: bool, edge: bool) -> int:
        rows.append({
            "range": key[0], "prefix": running.digest()[:16], "parent": rows[parent]["prefix"] if rows else None, "edge": edge,
            "parent_edge": bool(rows) and rows[parent]["edge"], "depth": depth, "conv_id": None, "parent_conv_id": None,
            "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved_tokens": 0, "ends_sha256": NO_ENDS,
        })
        above.append(parent)
        added.append((size, not (on_first and depth <= held_before)))
        return len(rows) - 1

    # Parents are emitted before their children: down in this order, up in reverse.
    emit(-1, hashlib.sha256(), 0, 0, True, True)
    stack = [(tree.root, 0, hashlib.sha256(), 0, True, True, b"")]
    while stack:
        node, top, running, depth, on_first, on_last, tail = stack.pop()
        path = tail + node.path  # a path may begin and end inside a turn's id
        for at in range(0, len(path) - WIDTH + 1, WIDTH):
            turn = path[at : at + WIDTH]
            running = running.copy()
            running.update(turn)
            on_first = on_first and first[depth * WIDTH : (depth + 1) * WIDTH] == turn
            on_last = on_last and last[depth * WIDTH : (depth + 1) * WIDTH] == turn
            depth += 1
            top = emit(top, running, int.from_bytes(turn[SIZE_AT:], "big"), depth, on_first, on_first or on_last)
        if node.value is not None:
            n, least, digest, more_after = node.value
            rows[top].update(n_convs=n, conv_id=least, ends_sha256=digest, n_leaves=int(node.layout is None and not more_after))
        tail = path[len(path) // WIDTH * WIDTH :]
        for child in node.children():
            stack.append((child, top, running, depth, on_first, on_last, tail))
    for row, parent, (size, new) in zip(reversed(rows), reversed(above), reversed(added)):
        row["saved_tokens"] += row["n_convs"] * size - (size if new else 0)
        if parent < 0:
            continue
        up = rows[parent]
        for figure in ("n_convs", "n_leaves", "saved_tokens"):
            up[figure] += row[figure]
        up["n_children"] += int(new)
        up["conv_id"] = row["conv_id"] if up["conv_id"] is None else min(up["conv_id"], row["conv_id"])
    for row, parent in zip(rows, above):
        row["parent_conv_id"] = None if parent < 0 else rows[parent]["conv_id"]
    return pd.DataFrame(rows, columns=columns).astype({"parent_conv_id": "Int64", "conv_id": "int64"})


def trie(strings: DataFrame) -> DataFrame:
    """The nodes of ``strings(conv_id, string)``, with distinct ids and strings of whole turn ids."""
    spark = strings.sparkSession
    single = materialize(distinct_strings(strings), "trie-strings")
    mb = (single.agg(F.sum(F.length("string"))).first()[0] or 0) >> 20
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), mb // RANGE_MB + 1)
    dealt = materialize(single.repartitionByRange(ranges, "string").withColumn("range", F.spark_partition_id()), "trie-ranges")
    by_range = Window.orderBy("range")  # one row per range
    bounds = (
        dealt.groupBy("range")
        .agg(F.min("string").alias("first"), F.max("string").alias("last"))
        .select("range", "first", "last", F.lag("last").over(by_range).alias("before"), F.lead("first").over(by_range).alias("after"))
    )
    schema = ", ".join(f"{name} {kind}" for name, kind in NODES.items())
    found = dealt.groupBy("range").cogroup(bounds.groupBy("range")).applyInPandas(range_nodes, schema)
    nodes = materialize(found, "trie-nodes")

    edges, inner = nodes.where("edge"), nodes.where("not edge")
    merged = materialize(
        edges.groupBy("prefix").agg(
            F.min("parent").alias("parent"),
            F.min("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"),
            *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
            F.coalesce(F.min(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256"))), F.lit(NO_ENDS)).alias("ends_sha256"),
        ),
        "trie-edges",
    )
    least = merged.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # A parent's rows are looked up per range, so the children of one large node are not one key.
    per_range = edges.select("range", F.col("prefix").alias("parent")).join(least, "parent")
    below = inner.where("parent_edge").drop("parent_conv_id").join(per_range, ["range", "parent"])
    return (
        merged.join(least, "parent", "left").select(RESULT)
        .union(inner.where("not parent_edge").select(RESULT))
        .union(below.select(RESULT))
    )


def query(conversations: DataFrame) -> DataFrame:
    return trie(materialize(rebuilt(conversations), "trie-conversations"))


_CRC = (
    "xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),"
    " lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),"
    " lambda k, z: CASE WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384::BIGINT) ELSE k >> 1 END)))"
)
SQL = f"""
WITH turns AS (
  SELECT conv_id, octet_length(encode(coalesce(text, ''))) AS size, turn,
    left(sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS id
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, id, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS place FROM turns),
convs AS (SELECT conv_id, {_CRC} % {HEAD} AS taken FROM (SELECT DISTINCT conv_id FROM own)),
parts AS (
  SELECT c.conv_id, 0 AS part, o.place, o.id, o.size FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % {GROUP} AND o.place <= c.taken
  UNION ALL SELECT c.conv_id, 1, o.place, o.id, o.size FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.place > c.taken),
prefixes AS (
  SELECT conv_id, size, row_number() OVER w AS depth, string_agg(id, '') OVER w AS prefix
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)),
held AS (SELECT conv_id, size, depth, prefix FROM prefixes UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM held GROUP BY prefix, depth),
children AS (SELECT left(prefix, length(prefix) - 32) AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT left(n.prefix, (32 * u.k)::BIGINT) AS prefix, sum((c.n IS NULL)::BIGINT) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved_tokens
  FROM nodes n LEFT JOIN children c USING (prefix), unnest(range(n.depth + 1)) AS u(k) GROUP BY 1),
ends AS (
  SELECT prefix, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, arg_max(prefix, depth) AS prefix FROM held GROUP BY conv_id) GROUP BY prefix)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, b.n_leaves::BIGINT AS n_leaves,
  b.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN below b USING (prefix) LEFT JOIN children c USING (prefix) LEFT JOIN ends e USING (prefix)
LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = left(n.prefix, length(n.prefix) - 32)
"""
