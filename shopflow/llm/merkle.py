"""Merkle manifest of a dataset: a tree of hashes for each group of rows, and one over the groups' roots.

A node is the SHA-256, as hex text, of the digests below it; every two consecutive
nodes have a parent, and so does a last one alone, while a level has several
nodes. ``manifest`` stores the leaves in order and then every ``levels``-th
level only: a subtree of ``2 ** levels`` nodes is a row of a group by aligned
run. ``proofs`` goes down the stored levels again: it computes the nodes
between two of them anew from the lower one, takes the siblings of every node of
the run, puts them before what the run's own root has above it, and drops the rest. So no
interior node is kept, and no proof is shuffled: siblings that many leaves have in
common travel once for each run.

Scale. Rows are reduced to their leaf hashes before anything moves. Leaves are
dealt in ranges of group, order and hash, so a group with most of the rows is
many ranges; positions come from the counts of ranges. A run is ``2 ** levels``
rows at most. The number of rounds is the tree's height over ``levels``.

Edge cases. A null in a field is ``-``; a null group is a group of its own, the first one, and a null in
the order comes first. Rows of equal order are ordered by their hash; equal
rows are leaves of their own. A group of one row has that row's leaf as its
root, and one group's root is the dataset's. No rows give no nodes and no proofs.
Columns that are no field are ignored, whatever their names; so are the lengths of texts.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import let
from .shared import materialize

#: Levels of a subtree between two stored levels: runs of 64 nodes.
LEVELS = 6


class Tree(NamedTuple):
    """Stored levels of the trees of all groups, the leaves first; the last has a row for each group."""

    levels: int
    stored: list[DataFrame]


class Manifest(NamedTuple):
    """Trees of the groups, and the tree over their roots (of one group)."""

    groups: Tree
    top: Tree


def encoded(*fields: Column) -> Column:
    """Fields so that no two rows look alike: a hyphen for null, else the number of UTF-8 bytes, a colon and the value."""
    text = [f.cast("string") for f in fields]
    return F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text))


def digest_of(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """Adds idx, the place of a row in its group ``_g`` from 0, and rise, the levels above the leaves of its group."""
    keys = ("_g", *order, "_row")
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    kept = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("_at", 33)
    # a row for each group and range
    runs = kept.groupBy("_g", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy("_g")
    start = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.sum("_n").over(group)
    rise = F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)
    starts = materialize(runs.select(F.col("_g").alias("_of"), F.col("_part").alias("_in"), (start - F.col("_first")).alias("_shift"), rise.alias("rise")), "starts")
    placed = kept.join(starts, (F.col("_g") == F.col("_of")) & (part == F.col("_in")))
    return placed.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("idx"), "rise")


def _subtree(nodes: Column, height: Column) -> Column:
    """The nodes of an aligned run and of ``height`` levels above them, level by level."""
    pair = lambda below, i: digest_of(F.get(below, 2 * i), F.coalesce(F.get(below, 2 * i + 1), F.lit("")))
    above = lambda below: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(below) - 1, 1)), lambda i: pair(below, i))
    level = lambda so_far, k: F.when(k == 0, nodes).otherwise(let(F.element_at(so_far, -1), above))
    empty = F.expr("cast(array() AS array<array<string>>)")
    return F.aggregate(F.sequence(F.lit(0), height), empty, lambda so_far, k: F.concat(so_far, F.array(level(so_far, k))))


def _runs(nodes: DataFrame, levels: int) -> DataFrame:
    """_g, run, rise, height, nodes (with what their rows hold), tree: a row for each aligned run of nodes."""
    row = F.struct("idx", *(c for c in nodes.columns if c not in ("_g", "idx", "rise")))
    runs = nodes.groupBy("_g", F.shiftright("idx", levels).alias("run")).agg(F.max("rise").alias("rise"), F.array_sort(F.collect_list(row)).alias("nodes"))
    runs = runs.withColumn("height", F.least(F.col("rise"), F.lit(levels)))
    return runs.withColumn("tree", _subtree(F.transform("nodes", lambda x: x["hash"]), F.col("height")))


def _grown(leaves: DataFrame, levels: int) -> Tree:
    stored = [leaves]
    tallest = leaves.agg(F.max("rise")).first()[0] or 0
    for _ in range(-(-tallest // levels)):
        root = F.get(F.get("tree", F.col("height")), F.lit(0))
        runs = _runs(stored[-1].select("_g", "idx", "rise", "hash"), levels)
        stored.append(materialize(runs.select("_g", F.col("run").alias("idx"), (F.col("rise") - F.col("height")).alias("rise"), root.alias("hash")), "nodes"))
    return Tree(levels, stored)


def manifest(rows: DataFrame, group: str, order: str, leaf: Column, levels: int = LEVELS, **keep: Column) -> Manifest:
    """The trees of rows whose hash is ``leaf``, by group and order; ``keep`` are columns that proofs carry along."""
    leaves = rows.select(F.struct(F.col(group)).alias("_g"), F.col(order).alias("_order"), leaf.alias("hash"), *(c.alias(k) for k, c in keep.items()))
    groups = _grown(_placed(leaves, "_order", "hash").drop("_order"), levels)
    roots = groups.stored[-1].select(F.struct(F.lit(0)).alias("_g"), "hash", F.col("_g").alias("_group"))
    return Manifest(groups, _grown(_placed(roots, "_group"), levels))


def _down(tree: Tree, above: DataFrame) -> DataFrame:
    """Rows of the lowest stored level with their path up through what ``above`` (_g, idx, path, and more) says of the highest."""
    for nodes in reversed(tree.stored[:-1]):
        runs = _runs(nodes, tree.levels).withColumnRenamed("_g", "_of")
        both = runs.join(above, (F.col("_of") == F.col("_g")) & (F.col("run") == F.col("idx"))).drop("idx")

        def path(at: Column) -> Column:
            def sibling(level: Column, k: Column) -> Column:
                own = F.call_function("shiftright", at, k)
                return F.struct(F.get(level, own.bitwiseXOR(F.lit(1))).alias("hash"), (own.bitwiseAND(F.lit(1)) == 1).alias("left"))

            return F.concat(F.transform(F.slice("tree", F.lit(1), F.col("height")), sibling), F.col("path"))

        carried = [c for c in above.columns if c not in ("_g", "idx", "path")]
        names = [c for c in nodes.columns if c not in ("_g", "rise")]
        rows = F.transform("nodes", lambda x, at: F.struct(*(x[c].alias(c) for c in names), path(at).alias("path")))
        above = both.select("_g", *carried, F.inline(rows))
        if nodes is not tree.stored[0]:
            above = above.drop("hash")
    return above


def proofs(made: Manifest) -> DataFrame:
    """A row for each leaf: hash, what was kept with it, subroot, root, and path, the siblings from the leaf to the root.

    A step of a path is (hash, left): the sibling, null where a node is alone, and whether it stands on the left.
    """
    none = F.expr("cast(array() AS array<struct<hash: string, left: boolean>>)").alias("path")
    root = made.top.stored[-1].select("_g", "idx", F.col("hash").alias("root"), none)
    if len(made.top.stored) > 1:
        groups = _down(made.top, root).select("_group", "root", "path")
    else:
        groups = made.top.stored[-1].select("_group", F.col("hash").alias("root"), none)
    tops = made.groups.stored[-1].withColumnRenamed("hash", "subroot")
    if len(made.groups.stored) > 1:
        tops = tops.select("_g", "idx", "subroot")
        above = tops.join(groups, F.col("_g") == F.col("_group")).drop("_group")
        return _down(made.groups, above).drop("_g", "idx")
    return tops.join(groups, F.col("_g") == F.col("_group")).withColumn("hash", F.col("subroot")).drop("_g", "_group", "idx", "rise")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    step = lambda own, s: F.when(s["hash"].isNull(), own).when(s["left"], F.concat(s["hash"], own)).otherwise(F.concat(own, s["hash"]))
    return F.aggregate(path, leaf, lambda own, s: F.sha2(step(own, s), 256))


def document_proofs(documents: DataFrame, levels: int = LEVELS) -> DataFrame:
    """What the contract asks for: each document's proof, checked against a leaf whose n_chars is tampered with in one of seven."""
    n_chars = F.col("n_chars")
    leaf = lambda n: digest_of(encoded(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")))
    chosen = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & n_chars.isNotNull()
    changed = F.when(chosen, leaf(n_chars.cast("decimal(20,0)") + 1))
    found = proofs(manifest(documents, "lang", "doc_id", leaf(n_chars), levels, doc_id=F.col("doc_id"), changed=changed))
    siblings = F.array_join(F.transform("path", lambda s: s["hash"]), "")
    out = found.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.coalesce("changed", "hash"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The entries of the table by which CRC-32 goes a byte at a time, by its polynomial; for SQL that has no such function.
CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS crc_t FROM (SELECT i, list_reduce(list_prepend(i, CAST(range(8) AS UBIGINT[])), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT CAST(unnest(range(256)) AS UBIGINT) AS i))
)"""


def crc_sql(text: str) -> str:
    """CRC-32 of an ASCII text in a query that joins ``crc_table``."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda j: CAST(ascii(({text})[j]) AS UBIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {codes}), lambda c, b: xor(c >> 8, crc_t[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295)"


def _leaf_sql(n_chars: str) -> str:
    field = lambda f: f"CASE WHEN {f} IS NULL THEN '-' ELSE concat(strlen(CAST({f} AS VARCHAR)), ':', CAST({f} AS VARCHAR)) END"
    return "sha256(concat(" + ", ".join(map(field, ("doc_id", "source", "lang", n_chars, "text"))) + "))"


def _levels_sql(name: str, group: str, base: str) -> str:
    return f"""{name} AS (
  {base}
  UNION ALL SELECT {group}, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY {group}, lvl, idx // 2, n
)"""


SQL = f"""
WITH RECURSIVE {CRC_TABLE}, d AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN n_chars IS NOT NULL AND {crc_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS changed FROM documents, crc_table
), leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM d),
{_levels_sql("nodes", "lang", "SELECT lang, CAST(0 AS BIGINT) AS lvl, idx, leaf AS h, n FROM leaves")},
subroots AS (SELECT lang, h AS subroot, lvl AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx FROM nodes WHERE n = 1),
{_levels_sql("upper_nodes", "g", "SELECT 0 AS g, CAST(0 AS BIGINT) AS lvl, idx, subroot AS h, (SELECT count(*) FROM subroots) AS n FROM subroots")},
tops AS (SELECT h AS root, lvl AS height FROM upper_nodes WHERE n = 1),
steps AS (
  SELECT l.lang, l.idx, k.k AS step, l.idx >> k.k AS own, s.h FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang, unnest(range(r.height)) AS k(k)
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.lvl = k.k AND s.idx = xor(l.idx >> k.k, 1)
  UNION ALL
  SELECT l.lang, l.idx, r.height + k.k, r.idx >> k.k, s.h FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang, tops, unnest(range(tops.height)) AS k(k)
  LEFT JOIN upper_nodes s ON s.lvl = k.k AND s.idx = xor(r.idx >> k.k, 1)
), paths AS (
  SELECT lang, idx, string_agg(h, '' ORDER BY step) AS siblings, list(CASE WHEN h IS NULL THEN 'N' WHEN own % 2 = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY step) AS path FROM steps GROUP BY lang, idx
), folded AS (
  SELECT l.doc_id, l.leaf, r.subroot, tops.root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(l.changed, l.leaf), coalesce(p.path, CAST([] AS VARCHAR[]))), lambda own, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || own WHEN 'R' THEN own || s[2:] ELSE own END)) AS folded_root
  FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang CROSS JOIN tops LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.idx = l.idx
)
SELECT *, folded_root = root AS verified FROM folded
"""
