"""Merkle manifest of a table: per-group hash trees by slot pivot, proofs and their verification.

A row's leaf is the SHA-256 of its fields, each as byte count, colon and value
(``-`` if null).  Inside a group leaves ascend by ``doc_id``; while more than
one node remains, every ``RUN`` consecutive ones are hashed into one.  The
groups' last nodes, in group order, form a tree of their own, whose last node
is the root.

* Places are numbered by range partitioning and per-partition offsets, so no
  group is ordered in one task, however large.
* ``FANOUT`` = 2^LEVELS nodes below one ancestor are one row: conditional
  aggregates spread them into slot columns.  Concatenating slot columns and
  hashing yields the columns of the next level; leaving out a slot's own
  column yields its siblings.  So four levels cost one exchange, and a tree of
  a billion leaves eight.
* Going down, an ancestor's row brings the siblings above it to its children's
  rows: sixteen leaves share one such row.  Leaves never travel with them.
* A proof is folded as a reader would: the (possibly changed) leaf, hashed with
  its siblings level by level.

Cases: null fields are ``-``; a null ``doc_id`` comes first in its group, the
null group first of all; empty and very long texts are values like others;
rows that share a ``doc_id`` are leaves of their own, in order of their leaf
hash (equal rows have equal leaves, so their order doesn't matter); a group of
one row is its leaf; a table without rows gives none; other columns are
neither hashed nor returned, also where their names are used here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ids import assign_ids
from ..session import materialize
from .text import join_counted

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN = 2
LEVELS = 4
FANOUT = RUN ** LEVELS


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of a row's fields, each with its length."""
    text = [c.cast("string") for c in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text])


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``place`` (from 0) and ``total`` of each row in its group (not null), in the order of the named columns."""
    # the tag splits equal rows over tasks; their order is of no account
    placed = assign_ids(rows.withColumn("tag", F.monotonically_increasing_id()), [group, *order], "place", start=0).drop("tag")
    size = materialize(placed.groupBy(group).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("total")), "merkle-groups")
    return join_counted(placed, size, group).withColumn("place", F.col("place") - F.col("first")).drop("first")


def pivot(nodes: DataFrame, group: list[str], payload: list[str]) -> DataFrame:
    """One row per ``FANOUT`` places of a group: slot columns s0.. of (hash and payload).

    ``nodes`` has the group, ``place`` (at this height), ``width`` (the group's nodes at this height) and ``hash``.
    """
    body = F.struct("hash", *payload)
    slot = F.col("place") % FANOUT
    return nodes.groupBy(*group, "width", F.shiftright("place", LEVELS).alias("up")).agg(
        *[F.max(F.when(slot == k, body)).alias(f"s{k}") for k in range(FANOUT)])


def _level(nodes: list[Column], alive: Column) -> tuple[list[Column], list[Column]]:
    """Slot columns one level up, and each slot's siblings on the way (``before`` and ``after`` it)."""
    up, path = [], []
    for at in range(0, len(nodes), RUN):
        run = nodes[at:at + RUN]
        filled = [F.coalesce(c, F.lit("")) for c in run]
        up.append(F.when(~alive, run[0]).when(run[0].isNotNull(), digest(*filled)))
        for k in range(len(run)):
            sides = [F.concat(F.lit(""), *x) for x in (filled[:k], filled[k + 1:])]
            path.append(F.struct(sides[0].alias("before"), sides[1].alias("after")))
    return up, path


def with_levels(rows: DataFrame) -> DataFrame:
    """Pivoted rows with the hash columns of the levels above (the last is ``above``) and each slot's siblings.

    A level that the group doesn't have (one node is left) passes its node on and has no siblings.
    """
    hashes = [F.col(f"s{k}.hash") for k in range(FANOUT)]
    width = F.col("width")
    for level in range(LEVELS):
        alive = width > 1
        ups, paths = _level(hashes, alive)
        # one projection a level, so that a hash is written once and read by name
        rows = rows.select("*", *[c.alias(f"u{level}_{i}") for i, c in enumerate(ups)],
                           *[F.when(alive, c).alias(f"p{level}_{i}") for i, c in enumerate(paths)])
        hashes = [F.col(f"u{level}_{i}") for i in range(len(ups))]
        width = F.ceil(width / RUN)
    return rows.withColumn("above", hashes[0])


def climb(leaves: DataFrame, group: list[str], payload: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Pivoted rows of every fourth height, and each group's last node (group, ``hash``).

    ``leaves`` has the group, ``place``, ``total``, ``hash`` and the payload; every height is written once.
    """
    nodes = leaves.select(*group, "place", F.col("total").alias("width"), "hash", *payload)
    heights = []
    while True:
        rows = materialize(pivot(nodes, group, [] if heights else payload), "merkle-height")
        heights.append(rows)
        nodes = with_levels(rows).select(*group, F.col("up").alias("place"), F.ceil(F.col("width") / FANOUT).alias("width"),
                                         F.col("above").alias("hash"))
        widest = rows.agg(F.max("width")).first()[0]
        if widest is None or widest <= FANOUT:
            return heights, nodes.select(*group, "hash")


def descend(heights: list[DataFrame], group: list[str], payload: list[str], seed: DataFrame) -> DataFrame:
    """Each leaf's payload and ``hash`` with ``path``, its siblings from below up, and the seed's columns.

    ``seed`` has a row per group, with ``path``, what lies above the group's last node.
    """
    extra = [c for c in seed.columns if c not in (*group, "path")]
    on, above = group, seed
    for i, rows in reversed(list(enumerate(heights))):
        own = payload if i == 0 else []
        rows = with_levels(rows).join(above.withColumnRenamed("path", "rest"), on)
        slots = [F.when(F.col(f"s{k}").isNotNull(), F.struct(
            (F.col("up") * FANOUT + k).alias("place"), F.col(f"s{k}.hash").alias("hash"), *[F.col(f"s{k}.{c}").alias(c) for c in own],
            F.array_compact(F.array(*[F.col(f"p{level}_{k // RUN ** level}") for level in range(LEVELS)])).alias("near")))
            for k in range(FANOUT)]
        each = rows.select(*group, *extra, "rest", F.explode(F.array_compact(F.array(*slots))).alias("slot"))
        above = each.select(*group, *extra, F.col("slot.place").alias("up"), F.col("slot.hash").alias("hash"),
                            *[F.col(f"slot.{c}").alias(c) for c in own], F.concat("slot.near", "rest").alias("path"))
        on = [*group, "up"]
        if i:
            above = above.drop("hash")
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The node that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["before"], node, s["after"]))


def proof_hash(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(docs: DataFrame, changed: Column, group: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS,
             change: dict[str, Column] | None = None) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root and verified of each row.

    ``changed`` tells which rows were tampered with after the manifest was
    made, ``change`` the columns' values then (both on the columns of ``docs``).
    """
    change = change or {}
    columns = [F.col(f"`{c}`") for c in fields]
    after = [change.get(c, F.col(f"`{c}`")) for c in fields]
    leaves = docs.select(
        # null first, then by value; a prefix keeps the null group apart from every other
        F.coalesce(F.concat(F.lit("v"), F.col(group).cast("string")), F.lit("")).alias("branch"),
        F.col(key).alias("key"), leaf_hash(columns).alias("hash"), F.when(changed, leaf_hash(after)).alias("later"))
    heights, tops = climb(numbered(leaves, "branch", ["key", "hash"]), ["branch"], ["key", "later"])
    tops = materialize(tops, "merkle-tops")
    crown, root = climb(numbered(tops.withColumn("tree", F.lit(0)), "tree", ["branch"]), ["tree"], ["branch"])
    start = root.select("tree", F.col("hash").alias("root"), F.array().cast("array<struct<before:string,after:string>>").alias("path"))
    seed = materialize(descend(crown, ["tree"], ["branch"], start).select("branch", "path", "root", F.col("hash").alias("subroot")),
                       "merkle-roots")
    out = descend(heights, ["branch"], ["key", "later"], seed)
    folded = fold(F.coalesce("later", "hash"), F.col("path"))
    return out.select(F.col("key").alias(key), F.col("hash").alias("leaf"), "subroot", "root",
                      proof_hash(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def _duck_levels(name: str, first: str) -> str:
    return f"""{name}(g, lev, hs) AS (
  {first}
  UNION ALL
  SELECT g, lev + 1, list_transform(range(0, len(hs), 2), lambda i: sha256(hs[i + 1] || coalesce(hs[i + 2], '')))
  FROM {name} WHERE len(hs) > 1)"""


def _duck_steps(place: str, first: int) -> str:
    """A node's sibling on each level, marked by the side on which it stands."""
    return f"""lev + {first} AS lev, CASE WHEN ({place} >> lev) & 1 = 1 THEN 'R' ELSE 'L' END
    || coalesce(hs[xor({place} >> lev, 1) + 1], '') AS step"""


def oracle() -> str:
    """The DuckDB twin: lists of hashes a level, and CRC-32 by its table."""
    field = lambda c: f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')"
    leaf = lambda n: "sha256(" + " || ".join(field(n if c == "n_chars" else c) for c in FIELDS) + ")"
    return f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY n) AS tab
  FROM range(256) t(n)),
rows AS (
  SELECT doc_id, coalesce('v' || lang, '') AS g, {leaf("n_chars")} AS leaf, {leaf("n_chars + 1")} AS later,
         coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                                  lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295::BIGINT) % 7 = 0, false) AS changed
  FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM rows),
{_duck_levels("levels", "SELECT g, 0, list(leaf ORDER BY place) FROM leaves GROUP BY g")},
subroots AS (SELECT g, hs[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS nr FROM levels WHERE len(hs) = 1),
{_duck_levels("crown", "SELECT 0, 0, list(subroot ORDER BY nr) FROM subroots")},
steps AS (
  SELECT g, place, {_duck_steps("place", 0)} FROM leaves JOIN levels USING (g) WHERE len(hs) > 1
  UNION ALL
  SELECT l.g, place, {_duck_steps("nr", 1000)} FROM leaves l JOIN subroots s ON s.g = l.g, crown WHERE len(hs) > 1),
paths AS (SELECT g, place, list(step ORDER BY lev) AS path FROM steps GROUP BY ALL),
done AS (
  SELECT doc_id, leaf, subroot, (SELECT hs[1] FROM crown WHERE len(hs) = 1) AS root,
         sha256(array_to_string(list_transform(coalesce(path, []), lambda s: s[2:]), '')) AS proof_sha256,
         list_reduce(list_prepend(CASE WHEN changed THEN later ELSE leaf END, coalesce(path, [])),
                     lambda h, s: CASE WHEN s[1] = 'R' THEN sha256(s[2:] || h) ELSE sha256(h || s[2:]) END) AS folded_root
  FROM leaves JOIN subroots USING (g) LEFT JOIN paths USING (g, place))
SELECT *, folded_root = root AS verified FROM done
"""
