"""Spelling variants: words within one edit, found by automata over compact trie shards.

The words of a corpus are counted, and sorted into trie shards: per node the first child, per
child its letter, per end the word's number and count, all in flat arrays.  Shards are
broadcast, as many at a time as ``WAVE`` bytes hold (so what is broadcast has a fixed bound,
whatever the vocabulary), and every word's Levenshtein automaton of distance one is
intersected with every shard.  A state is (trie node, letters of the word read, whether the edit was
made); an automaton that has made no edit tries all children, one that has made its edit follows
single letters.  States of a block of words are advanced together and depth-first: the block that
was reached last goes on first, and the states that have made their edit are followed to their
ends whenever ``STATES`` of them are waiting, so memory is bounded.

A shard returns, per word, how many neighbours it accepts and the best form among them; the sums
and the best of all shards are an ordinary aggregation.  Pairs are never written.

Words are made of letters up to U+00FF, so a letter is a byte of Latin-1 in all arrays.

Defined results: a null text holds no words; a null id is written as nothing before the colon of
the checksum; repeated rows count again; very long runs are words like any other; other columns,
whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.graph import _ends
from catalith.plans.storage import checkpoint, write_table

#: Letters of words in one shard, and bytes of shards broadcast at a time.
SHARD, WAVE = 2_000_000, 64 * 2**20
#: States advanced together, words matched by a task, and distinct words that a task counts before it hands them on.
STATES, TASK, HELD = 400_000, 20_000, 200_000
#: A-Z to a-z, other letters up to U+00FF as they are, all else to a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def variants(doc_id: int | None, text: str, modulus: int) -> Counter[bytes]:
    """Counts of a text's lower-cased runs (as Latin-1); runs whose checksum ``modulus`` divides lose the letter that it names."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter[bytes] = Counter()
    for run, n in Counter(text.encode("latin-1", "replace").translate(LETTERS).split()).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
        if h % modulus == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def words(df: DataFrame, modulus: int = 97, least_length: int = 5, least: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words of at least so many letters and occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for i, t in zip(b.column("_id").to_pylist(), b.column("_text"), strict=True):
                for w, n in variants(i, t.as_py(), modulus).items():
                    if len(w) >= least_length:
                        held[w] += n
                if len(held) >= HELD:
                    yield handed()
                    held.clear()
        yield handed()

    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text")).where("_text IS NOT NULL")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Trie:
    """A trie in flat arrays: children of node i are ``start[i]`` to ``start[i + 1]``, with ascending letters; node 0 is the root."""

    def __init__(self, start: np.ndarray, letter: np.ndarray, end: np.ndarray, n: np.ndarray, text: list[bytes]):
        self.start, self.letter, self.end, self.n, self.text = start, letter, end, n, text
        # Of child i of a node, the node's number and the letter; the child itself is node i + 1.
        self.edge = np.repeat(np.arange(len(start) - 1, dtype=np.int64), np.diff(start)) * 256 + letter

    @classmethod
    def of(cls, text: list[bytes], n: np.ndarray) -> Trie:
        """From sorted, distinct, non-empty words; level by level, so children follow their parents' order."""
        flat = np.frombuffer(b"".join(text), np.uint8)
        size = np.array([len(w) for w in text], np.int64)
        first = np.cumsum(size) - size
        at, parent, firsts, letters, ends = np.arange(len(text)), np.zeros(len(text), np.int64), [], [], [np.array([-1])]
        total, depth = 1, 0
        while len(at):
            now = flat[first[at] + depth]
            fresh = np.ones(len(at), bool)
            fresh[1:] = (parent[1:] != parent[:-1]) | (now[1:] != now[:-1])
            node = total + np.cumsum(fresh) - 1
            firsts.append(parent[fresh])
            letters.append(now[fresh])
            done = size[at] == depth + 1
            end = np.full(int(fresh.sum()), -1)
            end[node[done] - total] = at[done]
            ends.append(end)
            total += int(fresh.sum())
            at, parent, depth = at[~done], node[~done], depth + 1
        of = np.concatenate(firsts) if firsts else np.empty(0, np.int64)
        start = np.concatenate([np.searchsorted(of, np.arange(total), "left"), [len(of)]])
        return cls(start.astype(np.int32), np.concatenate(letters) if letters else np.empty(0, np.uint8), np.concatenate(ends).astype(np.int32), n, text)

    def packed(self) -> dict[str, bytes]:
        return {"start": self.start.astype("<i4").tobytes(), "letter": self.letter.tobytes(), "end": self.end.astype("<i4").tobytes(), "n": self.n.astype("<i8").tobytes(), "text": b"\n".join(self.text)}

    @classmethod
    def unpacked(cls, start: bytes, letter: bytes, end: bytes, n: bytes, text: bytes) -> Trie:
        return cls(np.frombuffer(start, "<i4"), np.frombuffer(letter, np.uint8), np.frombuffer(end, "<i4"), np.frombuffer(n, "<i8"), text.split(b"\n"))

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child by a letter, 0 where there is none."""
        if not len(self.edge):
            return np.zeros(len(node), np.int64)
        key = node * 256 + letter
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where(self.edge[at] == key, at + 1, 0)


def neighbours(trie: Trie, text: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``text``, word of the trie) of all pairs that differ by exactly one edit, each once.

    A letter is inserted behind, and deleted at the end of, a run of equal letters, so no pair is found twice.
    """
    flat = np.frombuffer(b"".join(text) + b"\0\0", np.uint8)
    size = np.array([len(w) for w in text], np.int64)
    first = np.cumsum(size) - size
    found: list[tuple[np.ndarray, np.ndarray]] = []
    edited: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def finish() -> None:
        """Follow all states that have made their edit, letter by letter."""
        word, node, read = (np.concatenate(x) for x in zip(*edited, strict=True))
        edited.clear()
        while len(word):
            done = read == size[word]
            hit = done & (trie.end[node] >= 0)
            found.append((word[hit], trie.end[node[hit]].astype(np.int64)))
            word, node, read = word[~done], node[~done], read[~done]
            node = trie.child(node, flat[first[word] + read])
            alive = node > 0
            word, node, read = word[alive], node[alive], read[alive] + 1

    step = max(1, STATES // 128)
    stack = [(np.arange(s, min(s + step, len(text))), np.zeros(min(step, len(text) - s), np.int64), 0) for s in range(0, len(text), step)]
    while stack:
        word, node, read = stack.pop()  # words that are letter for letter at a node of their own
        more = read < size[word]
        letter = np.where(more, flat[first[word] + np.minimum(read, size[word])], 0)
        last = more & ((read + 1 == size[word]) | (flat[first[word] + np.minimum(read + 1, size[word])] != letter))
        after = [(word[last], node[last], read + 1)]
        n = (trie.start[node + 1] - trie.start[node]).astype(np.int64)
        by = np.repeat(np.arange(len(word)), n)
        kid = np.arange(len(by)) - np.repeat(np.cumsum(n) - n, n) + trie.start[node][by] + 1
        same = more[by] & (trie.letter[kid - 1] == letter[by])
        swap = more[by] & ~same
        after += [(word[by[~same]], kid[~same], read), (word[by[swap]], kid[swap], read + 1)]
        for w, to, at in after:
            if len(w):
                edited.append((w, to, np.full(len(w), at)))
                waiting += len(w)
        if same.any():
            stack.append((word[by[same]], kid[same], read + 1))
        if edited and (waiting >= STATES or not stack):
            finish()
            waiting = 0
    return (np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def _shards(counted: DataFrame) -> DataFrame:
    """Tries over ranges of the sorted words."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text: list[bytes] = []
        n: list[int] = []
        letters = 0

        def shard() -> pa.RecordBatch:
            parts = Trie.of(text, np.array(n, np.int64)).packed()
            return pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary()) for k, v in parts.items()} | {"size": pa.array([sum(map(len, parts.values()))], pa.int64()), "least": pa.array([text[0].decode("latin-1")])})

        for b in batches:
            for w, c in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                text.append(w.encode("latin-1"))
                n.append(c)
                letters += len(w)
                if letters >= SHARD:
                    yield shard()
                    text, n, letters = [], [], 0
        if text:
            yield shard()

    ranged = counted.select("word", "n").repartitionByRange("word").sortWithinPartitions("word")
    return ranged.mapInArrow(build, "start binary, letter binary, end binary, n binary, text binary, size long, least string")


def _waves(shards: DataFrame) -> Iterator[list[str]]:
    """The shards' first words, in runs of WAVE bytes at the most (a larger shard is a run of its own)."""
    run, held = [], 0
    for r in shards.select("least", "size").orderBy("least").toLocalIterator():
        if run and held + r["size"] > WAVE:
            yield run
            run, held = [], 0
        run.append(r["least"])
        held += r["size"]
    if run:
        yield run


def _near(counted: DataFrame, shards: DataFrame, wave: list[str]) -> DataFrame:
    """Per word with a neighbour in the wave's shards: (word, n_near, best), best being the most frequent, ties the smallest."""
    parts = ("start", "letter", "end", "n", "text")
    kept = shards.where(F.col("least").isin(wave)).select(*parts).collect()
    sent = counted.sparkSession.sparkContext.broadcast([tuple(bytes(r[p]) for p in parts) for r in kept])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [w.encode("latin-1") for w in b.column("word").to_pylist()]
            n_near, best = np.zeros(len(text), np.int64), [None] * len(text)
            for packed in sent.value:
                trie = Trie.unpacked(*packed)
                i, j = neighbours(trie, text)
                n_near += np.bincount(i, minlength=len(text))
                # Numbers of words follow their order, so the first of each word in (word, -n, number) is its best.
                order = np.lexsort((j, -trie.n[j], i))
                i, j = i[order], j[order]
                lead = np.ones(len(i), bool)
                lead[1:] = i[1:] != i[:-1]
                for w, k in zip(i[lead].tolist(), j[lead].tolist(), strict=True):
                    mine = (-int(trie.n[k]), trie.text[k])
                    best[w] = mine if best[w] is None else min(best[w], mine)
            has = np.flatnonzero(n_near)
            forms = [{"less": best[w][0], "form": best[w][1].decode("latin-1")} for w in has.tolist()]
            kind = pa.struct([("less", pa.int64()), ("form", pa.string())])
            yield pa.RecordBatch.from_arrays([b.column("word").take(pa.array(has)), pa.array(n_near[has]), pa.array(forms, kind)], names=["word", "n_near", "best"])

    return counted.select("word").mapInArrow(match, "word string, n_near long, best struct<less: long, form: string>")


def group_variants(df: DataFrame, modulus: int = 97, least_length: int = 5, least: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root of every word; see the module's docstring."""
    found = words(df, modulus, least_length, least, id_col, text)
    counted = write_table(found, "words")
    many = counted.count()
    counted = write_table(counted.repartition(max(1, -(-many // TASK)), "word"), "dealt-words")
    shards = write_table(_shards(counted), "tries")
    parts = counted.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<less: long, form: string>").alias("best"))
    for wave in _waves(shards):
        parts = parts.unionByName(write_table(_near(counted, shards, wave), "near").withColumn("n", F.lit(None).cast("long")))
    summed = parts.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    form_n = F.when(-F.col("best.less") >= 2 * F.col("n"), -F.col("best.less"))
    scored = summed.select("word", "n", "n_near", F.when(form_n.isNotNull(), F.col("best.form")).alias("form"), form_n.alias("form_n"))
    scored = write_table(scored, "forms")
    # All forms have a neighbour, so every chain stays inside these.
    hooks = checkpoint(scored.where("n_near > 0").select(F.col("word").alias("node"), F.coalesce("form", "word").alias("end")))
    ends = _ends(hooks, 64).select(F.col("node").alias("_node"), F.col("end").alias("_end"))
    return scored.join(ends, F.col("word") == F.col("_node"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("_end", "word").alias("root"))
