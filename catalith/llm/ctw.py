r"""Context-tree weighting over bytes, learned and applied as distributed joins.

The next byte is coded in eight binary decisions (most significant bit first), which form
a tree of 255 nodes.  Every node has a context tree of its own over the ``DEPTH`` bytes
before: at each context the Krichevsky-Trofimov estimate of the counts found there is
mixed, half and half, with the product of the contexts one byte longer, from the longest
up to none.  With counts frozen after training, the probability of a bit is the mixture of
the estimates along its context path, weighted by how well each depth coded the training
corpus.  Texts end with byte 0xFF, which UTF-8 never uses, so a text's probability is
proper; before the text stand ``DEPTH`` zero bytes.

Distribution:

1. documents are dealt to blocks of about ``BLOCK_BYTES`` by their place in the input, so no
   id or text gathers; each block gives its distinct (DEPTH + 1)-byte grams and its distinct
   words with training counts, and its documents, compressed;
2. counts are summed per gram and per word over all blocks;
3. grams meet by the two latest context bytes, where the deeper part of the trees is
   local, and stream by in that order: a task holds ``CONTEXT_ROWS`` of them, or one context's
   (at most 256 to the power of three, whatever the corpus); what lies above is at most
   256 x 255 sums, which the driver mixes and broadcasts;
4. each gram gets the log-probability of its byte; blocks get back the values of the grams
   and words they hold, and score their documents.

No table of the whole corpus is ever broadcast or collected, and nothing is truncated.
Texts are shuffled once.

Defined results: null text is empty (its end symbol is scored, and it has no bits a byte); a
null id counts as the empty text in the hold-out rule; repeated rows are scored, and learned
from, as often as they occur; a very long text is in one block, whole; other columns of the
table, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.plans.storage import checkpoint, write_table

DEPTH = 4
BLOCK_BYTES = 24_000_000
CONTEXT_ROWS = 150_000
HOLD_OUT, FOLDS = 2, 7
_END = b"\xff"


def _tidy(step: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """``step``, with what it freed given back to the system: Python workers outlive a block, and would hold it while others run."""

    @wraps(step)
    def run(*tables: pa.Table) -> pa.Table:
        out = step(*tables)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):
            ctypes.CDLL(None).malloc_trim(0)
        return out

    return run


def grams(text: bytes) -> np.ndarray:
    """The (DEPTH + 1)-byte codes that end at each byte of the text and its end symbol."""
    b = np.frombuffer(bytes(DEPTH) + text + _END, dtype=np.uint8).astype(np.int64)
    n = len(b) - DEPTH
    code = b[:n].copy()
    for i in range(1, DEPTH + 1):
        code <<= 8
        code |= b[i : i + n]
    return code


class GramCounts:
    """Distinct codes with their counts; at most ``FLUSH`` codes wait uncounted."""

    FLUSH = 1_000_000

    def __init__(self) -> None:
        self.keys, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, codes: np.ndarray) -> None:
        self.waiting.append(codes)
        self.size += len(codes)
        if self.size >= self.FLUSH:
            self.flush()

    def flush(self) -> GramCounts:
        if self.waiting:
            new = np.concatenate(self.waiting)
            new.sort()
            at = np.flatnonzero(np.r_[True, new[1:] != new[:-1]])
            keys, n = np.concatenate([self.keys, new[at]]), np.concatenate([self.n, np.diff(np.r_[at, len(new)])])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            self.keys, self.n, self.waiting, self.size = keys[at], np.add.reduceat(n, at), [], 0
        return self


def _profile_block(table: pa.Table) -> pa.Table:
    """Distinct grams and words of a block with their training counts (0: held out only), and a row with its documents."""
    train, other = GramCounts(), GramCounts()
    words: Counter[bytes] = Counter()
    unseen: set[bytes] = set()
    for t, learn in zip(table.column("_text"), table.column("_train").to_pylist(), strict=True):
        text = t.as_py()
        own = text.lower().split()
        if learn:
            words.update(own)
            train.add(grams(text))
        else:
            unseen.update(own)
            other.add(grams(text))
    key, n = train.flush().keys, train.n
    extra = np.setdiff1d(other.flush().keys, key, assume_unique=True)
    unseen.difference_update(words)
    rows_g, rows_w = len(key) + len(extra), len(words) + len(unseen)
    sink = pa.BufferOutputStream()
    docs = table.drop_columns(["_block", "_train"])
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(docs)
    return pa.table(
        {
            "_block": pa.array([table.column("_block")[0].as_py()] * (rows_g + rows_w + 1), pa.int32()),
            "gram": pa.concat_arrays([pa.array(np.r_[key, extra], pa.int64()), pa.nulls(rows_w + 1, pa.int64())]),
            "word": pa.concat_arrays([pa.nulls(rows_g, pa.binary()), pa.array([*words, *unseen, None], pa.binary())]),
            "n": pa.array(np.r_[n, np.zeros(len(extra), np.int64), np.fromiter(words.values(), np.int64, len(words)), np.zeros(len(unseen) + 1, np.int64)], pa.int64()),
            "docs": pa.concat_arrays([pa.nulls(rows_g + rows_w, pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]),
        }
    )


def _profiled(table: pa.Table) -> pa.Table:
    return _tidy(_profile_block)(table)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x >= 0.5: Stirling's series after shifting to x + 8."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a block with these counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - math.log(math.pi)


def _mix(estimate: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log-probability of a node, and the weight of its own estimate."""
    weighted = np.logaddexp(estimate, below) - math.log(2)
    return weighted, np.exp(estimate - math.log(2) - weighted)


class Subtrees:
    """The context trees from depth 2 down for grams whose two latest context bytes are complete here."""

    def __init__(self, code: np.ndarray, n: np.ndarray) -> None:
        x = code & 0xFF
        level = np.arange(8)
        node = (1 << level)[None, :] | (x[:, None] >> (8 - level)[None, :])
        self.bit = ((x[:, None] >> (7 - level)[None, :]) & 1).astype(bool)
        self.node, self.latest = node, (code >> 8) & 0xFF
        weight = np.repeat(n, 8).astype(float)
        ones = np.where(self.bit.ravel(), weight, 0.0)
        below, keys_below, inverse_below = None, None, None
        self.path: list[tuple[np.ndarray, np.ndarray]] = []  # from the deepest: weight of own estimate, probability of the bit
        for depth in range(DEPTH, 1, -1):
            # the context's latest `depth` bytes, then the node; unique per tree position
            context = (code >> 8) & ((1 << (8 * depth)) - 1)
            key = ((context[:, None] << 8) | node).ravel()
            keys, inverse = np.unique(key, return_inverse=True)
            total, one = np.bincount(inverse, weight, len(keys)), np.bincount(inverse, ones, len(keys))
            estimate = kt(total - one, one)
            if below is None:
                weighted, own = estimate, np.ones(len(keys))
            else:
                parent = np.empty(len(keys_below), dtype=np.int64)
                parent[inverse_below] = inverse
                weighted, own = _mix(estimate, np.bincount(parent, below, len(keys)))
            p1 = (one + 0.5) / (total + 1.0)
            self.path.append((own[inverse].reshape(-1, 8), np.where(self.bit, p1[inverse].reshape(-1, 8), 1 - p1[inverse].reshape(-1, 8))))
            below, keys_below, inverse_below = weighted, keys, inverse
        self.keys, self.total, self.one, self.weighted = keys, total, one, weighted

    def probability(self) -> np.ndarray:
        """Of each gram's bits, the mixture of depths 2 to DEPTH."""
        p = np.full(self.bit.shape, 0.5)
        for own, estimate in self.path:
            p = own * estimate + (1 - own) * p
        return p


def whole_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts, sorted by their two latest context bytes, in parts that end where a context ends."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append((b.column("gram").to_numpy(), b.column("n").to_numpy()))
        size += b.num_rows
        if size >= CONTEXT_ROWS:
            code, n = (np.concatenate(c) for c in zip(*held, strict=True))
            context = (code >> 8) & 0xFFFF
            last = int(np.flatnonzero(context != context[-1])[-1]) + 1 if (context != context[-1]).any() else 0
            if last:
                yield code[:last], n[:last]
            held, size = [(code[last:], n[last:])], len(code) - last
    if size:
        code, n = (np.concatenate(c) for c in zip(*held, strict=True))
        yield code, n


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Depth-2 nodes: latest byte, decision node, counts and weighted log-probability."""
    for code, n in whole_contexts(batches):
        trees = Subtrees(code, n)
        yield pa.RecordBatch.from_arrays(
            [pa.array((trees.keys >> 8) & 0xFF, pa.int64()), pa.array(trees.keys & 0xFF, pa.int64()), pa.array(trees.total), pa.array(trees.one), pa.array(trees.weighted)],
            names=["latest", "node", "total", "one", "below"],
        )


def top_of_trees(rows: list) -> dict[str, np.ndarray]:
    """Depths 1 and 0 from at most 256 x 255 sums: own weights and probabilities of a one."""
    total, one, below = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
    for r in rows:
        total[r["latest"], r["node"]], one[r["latest"], r["node"]], below[r["latest"], r["node"]] = r["total"], r["one"], r["below"]
    weighted, own1 = _mix(kt(total - one, one), below)
    _, own0 = _mix(kt((total - one).sum(0), one.sum(0)), weighted.sum(0))
    return {"own1": own1, "p1": (one + 0.5) / (total + 1), "own0": own0, "p0": (one.sum(0) + 0.5) / (total.sum(0) + 1)}


def gram_scores(counts: DataFrame) -> DataFrame:
    """(gram, value): log10 probability of each gram's last byte after its context."""
    by_context = counts.withColumn("_c", F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))).repartition("_c").sortWithinPartitions("_c").select("gram", "n")
    deep = by_context.mapInArrow(_summaries, "latest long, node long, total double, one double, below double")
    top = top_of_trees(deep.groupBy("latest", "node").agg(*(F.sum(c).alias(c) for c in ("total", "one", "below"))).collect())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, n in whole_contexts(batches):
            trees = Subtrees(code, n)
            p = trees.probability()
            at = (trees.latest[:, None], trees.node)
            for own, one in ((top["own1"][at], top["p1"][at]), (top["own0"][trees.node], top["p0"][trees.node])):
                p = own * np.where(trees.bit, one, 1 - one) + (1 - own) * p
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(np.log10(p).sum(1))], names=["gram", "value"])

    return by_context.mapInArrow(score, "gram long, value double")


def _scorer(unknown: float, end: float, end_known: bool):
    def score(blobs: pa.Table, model: pa.Table) -> pa.Table:
        docs = pa.concat_tables(pa.ipc.open_stream(x.as_buffer()).read_all() for x in blobs.column("docs"))
        is_gram = model.column("gram").is_valid()
        g = model.filter(is_gram)
        order = np.argsort(g.column("gram").to_numpy(), kind="stable")
        keys, values = g.column("gram").to_numpy()[order], g.column("value").to_numpy()[order]
        w = model.filter(model.column("word").is_valid())
        words = dict(zip(w.column("word").to_pylist(), w.column("value").to_pylist(), strict=True))
        n_tokens, n_known, base, total = [], [], [], []
        for t in docs.column("_text"):
            text = t.as_py()
            own = [words[x] for x in text.lower().split()]
            missing = own.count(unknown)  # the value of a word that was never seen in training
            n_tokens.append(len(own) + 1)
            n_known.append(len(own) - missing + end_known)
            base.append(math.fsum(own) + end)
            codes = grams(text)
            codes.sort()
            total.append(float(values[np.searchsorted(keys, codes)].sum()))
        return pa.table({**{k: docs.column(k) for k in ("_id", "held_out", "n_bytes")}, "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(total, pa.float64())})

    def tidied(blobs: pa.Table, model: pa.Table) -> pa.Table:
        return _tidy(score)(blobs, model)

    return tidied


def score_documents(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte (the code length of a byte)."""
    c = F.col
    body = F.coalesce(c(text).cast("binary"), F.lit(b""))
    fold = F.crc32(F.coalesce(c(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    docs = df.select(
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("_block"), body.alias("_text"), (fold != HOLD_OUT).alias("_train"), c(id_col).alias("_id"), (fold == HOLD_OUT).alias("held_out"), F.octet_length(body).cast("long").alias("n_bytes")
    )
    held = write_table(docs.groupBy("_block").applyInArrow(_profiled, "_block int, gram long, word binary, n long, docs binary"), "block-counts")
    of_grams, of_words = held.where("gram IS NOT NULL"), held.where("word IS NOT NULL")

    words = write_table(of_words.groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    seen = words.agg(F.sum("c").alias("n"), F.count_if(c("c") > 0).alias("v")).first()
    n_docs = df.where(fold != HOLD_OUT).count()
    total, distinct = (seen["n"] or 0) + n_docs, seen["v"] + (1 if n_docs else 0)
    log = lambda n: F.log10((n + 1.0) / F.lit(float(total + distinct + 1)))
    unknown = df.sparkSession.range(1).select(log(F.lit(0.0))).first()[0]
    end = math.log10((n_docs + 1) / (total + distinct + 1))

    counts = write_table(of_grams.groupBy("gram").agg(F.sum("n").alias("n")), "gram-counts")
    scores = checkpoint(gram_scores(counts))
    word_values = words.select("word", log(c("c")).alias("value"))
    model = of_grams.select("_block", "gram").join(scores, "gram").select("_block", "gram", F.lit(None).cast("binary").alias("word"), "value")
    model = model.unionByName(of_words.select("_block", "word").join(word_values, "word").select("_block", F.lit(None).cast("long").alias("gram"), "word", "value"))

    kind = docs.schema["_id"].dataType.simpleString()
    texts = held.where("docs IS NOT NULL").select(c("_block").alias("_own"), "docs").groupBy("_own")
    scored = texts.cogroup(model.groupBy("_block")).applyInArrow(_scorer(unknown, end, n_docs > 0), f"_id {kind}, held_out boolean, n_bytes long, n_tokens long, n_known long, base_score double, score double")
    return scored.select(c("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", F.when(c("n_bytes") > 0, -c("score") / math.log10(2) / c("n_bytes")).alias("bits_per_byte"))
