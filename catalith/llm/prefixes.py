"""The prefix trie of a corpus of conversations, with what shared prefixes would save.

A conversation is the path of its turns; a turn is told by a digest of its role and text.  Equal
paths are merged first (copies cost nothing), and paths are dealt by the digest of their first
turn to buckets of about ``BUCKET`` turns.  A bucket's tries are built inside
``applyInPandas``: nodes are dictionaries from the next turn to the child, and the sums
over subtrees come from an iterative postorder.

A first turn under which there are more than ``LIMIT`` turns is taken out of the buckets: its
paths go to the end of their common prefix, which is one compressed edge, and are dealt again by
their next turn, and so on until no subtrie is oversized.  The split nodes' sums come from their
children's, deepest first.  The root is the first split.  So a task holds a bucket and at the
most one subtrie of ``LIMIT`` turns more, however many conversations share a first turn.

The conversations that end in a node are hashed as one text in the order of their ids; sorted
rows are packed to pieces and stream through the hash, so a node's list is never held.  One
conversation's digests (not its texts) are one row.

Defined results: null turns come before others and equal turns are ordered by the digest of role
and text; null roles and texts are empty; rows with a null conversation id are left out; repeated rows are
turns; other columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.plans.storage import checkpoint, write_table

#: Turns in a bucket on average, turns of a subtrie that is not split, ids in a piece of a node's list.
BUCKET, LIMIT, PIECE = 8_000, 32_000, 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
_TURNS = "array<struct<d: binary, w: int>>"


def turns(df: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, path): the conversation's turns in order, as digests and word counts."""
    of = lambda c: F.coalesce(F.col(c), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(of(role)), F.lit(":"), of(role), of(text)), 256), 1, 32))
    words = F.regexp_count(of(text), F.lit(r"[^\x20\x09-\x0D]+"))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.struct(F.col(turn).cast("long").alias("t"), digest.alias("d"), words.alias("w")).alias("s"))
    return rows.groupBy("conv").agg(F.transform(F.sort_array(F.collect_list("s")), lambda x: F.struct(x["d"].alias("d"), x["w"].alias("w"))).alias("path"))


def rebuilt(paths: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """Conversations that start with the first turns of their block's first one: crc32(id) mod ``most`` of them."""
    h = (F.crc32(F.col("conv").cast("string")) % most).cast("int")
    base = F.col("conv") - F.pmod(F.col("conv"), F.lit(block))
    heads = paths.where(F.pmod(F.col("conv"), F.lit(block)) == 0).select(F.col("conv").alias("_base"), F.slice("path", 1, most).alias("_head"))
    own = F.slice("path", h + 1, F.size("path"))
    head = F.coalesce(F.slice("_head", F.lit(1), h), F.array().cast(_TURNS))
    return paths.join(heads, base == F.col("_base"), "left").select("conv", F.when(F.size("path") > h, F.concat(head, own)).otherwise(head).alias("path"))


def _hashed_lists(ends: DataFrame) -> DataFrame:
    """(same, ends_sha256) of rows (same, conv): the hash of each group's ids, ascending and comma-joined."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal groups as pieces of text."""
        for b in batches:
            same, conv = b.column("same").to_pylist(), b.column("conv").to_pylist()
            out, s = [], 0
            for i in range(1, len(same) + 1):
                if i == len(same) or same[i] != same[s] or i - s == PIECE:
                    out.append((same[s], conv[s], ",".join(map(str, conv[s:i]))))
                    s = i
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["same", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for b in batches:
            out = []
            for same, ids in zip(b.column("same").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if same == now:
                    sha.update(b"," + ids.encode())
                    continue
                if sha is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = same, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.string()))], names=["same", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_pydict({"same": pa.array([now], pa.binary()), "ends_sha256": pa.array([sha.hexdigest()])})

    pieces = ends.select("same", "conv").repartitionByRange("same", "conv").sortWithinPartitions("same", "conv").mapInArrow(pack, "same binary, first long, ids string")
    return pieces.repartition("same").sortWithinPartitions("same", "first").select("same", "ids").mapInArrow(digest, "same binary, ends_sha256 string")


def _merged(paths: DataFrame) -> DataFrame:
    """A row per distinct path: its copies, smallest conversation, and the hash of them all."""
    keyed = write_table(paths.withColumn("same", F.unhex(F.sha2(F.array_join(F.transform("path", lambda x: F.hex(x["d"])), "").cast("binary"), 256))), "paths")
    once = write_table(keyed.groupBy("same").agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.first("path").alias("path")), "merged")
    several = checkpoint(once.where("n > 1").select("same"))
    lists = checkpoint(_hashed_lists(keyed.select("same", "conv").join(several, "same")).withColumnRenamed("same", "_s"))
    alone = F.sha2(F.col("conv").cast("string").cast("binary"), 256)
    return once.join(lists, F.col("same") == F.col("_s"), "left").select("conv", "n", F.coalesce("ends_sha256", alone).alias("ends_sha256"), "path")


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def build(group: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a bucket's subtries; ``split`` of a top names the node above it.

    ``d`` and ``w`` start with the turn of the subtrie's top, which is at depth ``at``.
    """
    # A node is [children, conv_id, members, words, hash of its ends, parent, depth, leaves, saved].
    nodes: list[list] = []
    tops: dict[bytes, list] = {}
    up: dict[int, tuple[bytes, int]] = {}

    def made(above: list | None, depth: int, words: int) -> list:
        nodes.append([{}, None, 0, int(words), NO_ENDS, above, depth, 0, 0])
        return nodes[-1]

    for conv, n, ends, at, top, split, above, d, w in group[["conv", "n", "ends_sha256", "at", "top", "split", "above", "d", "w"]].itertuples(index=False):
        node = tops.get(top)
        if node is None:
            up[len(nodes)] = (split, above)
            node = tops[top] = made(None, at, w[0])
        for i in range(1, len(d) + 1):
            node[1] = conv if node[1] is None or conv < node[1] else node[1]
            node[2] += n
            if i < len(d):
                below = node[0].get(d[i])
                if below is None:
                    below = node[0][d[i]] = made(node, at + i, w[i])
                node = below
        node[4] = ends
    # Nodes are made after their parents, so the reverse order is a postorder.
    for node in reversed(nodes):
        node[7] += not node[0]
        node[8] += (node[2] - 1) * node[3]
        if (parent := node[5]) is not None:
            parent[7] += node[7]
            parent[8] += node[8]
    out = []
    for k, x in enumerate(nodes):
        split, above = up.get(k, (None, None))
        out.append((x[1], x[6], above if x[5] is None else x[5][1], x[2], len(x[0]), x[7], x[8], x[4], split))
    return pd.DataFrame(out, columns=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "split"])


def _common(a: str, b: str) -> Column:
    """How many turns two paths share from the start."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x["d"].eqNullSafe(y["d"])), F.lit(False))
    return F.when(differs == 0, F.least(F.size(a), F.size(b))).otherwise(differs - 1).cast("int")


def _onward(rows: DataFrame) -> DataFrame:
    """Paths that go beyond the split at depth ``_to``, under the name of their next subtrie."""
    next_ = F.unhex(F.sha2(F.concat("top", F.get("path", F.col("_to"))["d"]), 256))
    kept = rows.where(F.size("path") > F.col("_to"))
    return kept.select("conv", "n", "ends_sha256", "path", (F.col("_to") + 1).alias("at"), next_.alias("top"), F.col("top").alias("split"), F.col("_least").alias("above"))


def _passing() -> list[Column]:
    """Of the paths that pass a split node at depth ``_to``: the smallest conversation, all members, and the hash of those that end there."""
    ends = F.max(F.when(F.size("path") == F.col("_to"), F.col("ends_sha256")))
    return [F.min("conv").alias("conv_id"), F.sum("n").alias("n_convs"), F.coalesce(ends, F.lit(NO_ENDS)).alias("ends_sha256")]


def _split_root(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The root, and all paths under their first turns."""
    at_root = paths.withColumns({"_to": F.lit(0), "top": F.lit(b"")})
    root = checkpoint(at_root.groupBy().agg(*_passing()).where("n_convs IS NOT NULL").select(F.lit(b"").alias("top"), F.lit(None).cast("binary").alias("split"), F.lit(None).cast("long").alias("above"), F.lit(0).alias("at"), "*", F.array(F.lit(0)).alias("_words")))
    least = root.select("conv_id").first()
    return root, _onward(at_root.withColumn("_least", F.lit(least and least["conv_id"]).cast("long")))


def _split_large(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Oversized subtries cut at the end of their common prefix."""
    mine = write_table(rows, "oversized")
    lead = checkpoint(mine.groupBy("top").agg(F.min_by("path", "conv").alias("_lead")))
    cut = checkpoint(mine.join(lead, "top").groupBy("top").agg(F.min(_common("path", "_lead")).alias("_to"), F.min("conv").alias("_least")))
    reached = mine.join(cut, "top")
    nodes = reached.groupBy("top", "split", "above", "at", "_to").agg(*_passing())
    words = F.transform(F.slice("_lead", F.col("at"), F.col("_to") - F.col("at") + 1), lambda x: x["w"])
    return checkpoint(nodes.join(lead, "top").select("top", "split", "above", "at", "conv_id", "n_convs", "ends_sha256", words.alias("_words"))), _onward(reached)


def _chains(splits: DataFrame, below: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of split edges, and their tops' sums for the split above; ``below`` has the sums of the children."""
    sums = below.groupBy("split").agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"), F.count("*").alias("_children")).withColumnRenamed("split", "_of")
    known = splits.join(sums, F.col("top") == F.col("_of"), "left").withColumns({"_leaves": F.coalesce("_leaves", F.lit(1)), "_saved": F.coalesce("_saved", F.lit(0)), "_children": F.coalesce("_children", F.lit(0))})
    saved = lambda pos: F.col("_saved") + (F.col("n_convs") - 1) * F.aggregate(F.slice("_words", pos + 1, F.size("_words")), F.lit(0).cast("long"), lambda a, x: a + x)
    known = checkpoint(known)
    nodes = known.select("*", F.posexplode("_words").alias("_pos", "_w"))
    last = F.col("_pos") == F.size("_words") - 1
    nodes = nodes.select(
        "conv_id",
        (F.col("at") + F.col("_pos")).cast("long").alias("depth"),
        F.when(F.col("_pos") == 0, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("_children")).otherwise(1).cast("long").alias("n_children"),
        F.col("_leaves").alias("n_leaves"),
        saved(F.col("_pos")).alias("saved_tokens"),
        F.when(last, F.col("ends_sha256")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return nodes, known.select("split", F.col("_leaves").alias("n_leaves"), saved(F.lit(0)).alias("saved_tokens"))


def trie(df: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per node of the trie of all rebuilt conversations."""
    paths = write_table(_merged(rebuilt(turns(df, id_col, turn, role, text))), "distinct")
    left = F.sum((F.size("path") - F.col("at") + 1).cast("long"))
    root, todo = _split_root(paths)
    splits, small = [root], []
    while True:
        todo = write_table(todo, "subtries")
        sizes = checkpoint(todo.groupBy("top").agg(left.alias("_turns")))
        large = checkpoint(sizes.where(F.col("_turns") > LIMIT).select("top"))
        if large.isEmpty():
            small.append(todo)
            break
        small.append(todo.join(large, "top", "left_anti"))
        more, todo = _split_large(todo.join(large, "top", "left_semi"))
        splits.append(more)
    ready = reduce(DataFrame.unionByName, small)
    total = ready.agg(left).first()[0] or 0
    dealt = ready.select("conv", "n", "ends_sha256", "at", "top", "split", "above", *(F.slice(F.col(f"path.{c}"), F.col("at"), F.size("path")).alias(c) for c in ("d", "w")))
    bucket = F.pmod(F.xxhash64("top"), F.lit(max(1, -(-total // BUCKET)))).alias("bucket")
    built = write_table(dealt.groupBy(bucket).applyInPandas(build, f"{_NODE}, split binary"), "nodes")
    tops = built.where("split IS NOT NULL").select("split", "n_leaves", "saved_tokens")
    out, deeper = built.drop("split"), None
    for level in reversed(splits):
        nodes, deeper = _chains(level, tops if deeper is None else tops.unionByName(deeper))
        out = out.unionByName(nodes)
    return out
