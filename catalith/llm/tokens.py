"""Token counts and token ids through distinct pre-tokens.

Both tokenizers used here split a text into pre-tokens that never influence each other,
so a tokenizer only has to see each distinct pre-token once; everything else is look-ups
and sums.

Counts (``token_counts``) are made in three steps over tables:

1. texts are cut in chunks of about ``COUNT_BYTES``; a chunk gives its distinct pre-tokens,
   dealt to shards by a hash, and one value with its documents' frequencies of them;
2. a shard meets its pre-tokens of all chunks, counts each distinct one once, and answers
   every chunk;
3. a chunk's counts are joined to its frequencies: each document is a sum of products.

Texts are read once and never shuffled, no document's ids are made, and a pre-token that
is in every text is sent once a chunk.  There are as many shards as chunks, so a shard's
pre-tokens and a chunk's are about as many, whatever the input; a group's memory is bounded
by ``COUNT_BYTES`` or the longest text.  Lists travel compressed.

Ids (``WordIds``) come from a table of words that lives as long as a task, holds at most
``MAX_TABLE`` entries and is only a memo: emptying it changes no result.

Defined results: null text is the empty text; repeated rows give repeated results; texts
are never cut, however long; a null id is kept; other columns of the table, whatever their
names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.plans.storage import write_table

MAX_TABLE = 400_000
#: Characters of text resolved together, and pre-tokens given to a tokenizer in one call.
CHUNK_CHARS = 3_000_000
PER_CALL = 64
#: Bytes of text whose distinct pre-tokens are gathered together for counting.
COUNT_BYTES = 32_000_000


def chunks[T: (str, bytes)](texts: Iterable[T], limit: int = CHUNK_CHARS) -> Iterator[list[T]]:
    """Consecutive texts with about ``limit`` characters (or bytes) together."""
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t)
        if size >= limit:
            yield out
            out, size = [], 0
    if out:
        yield out


class PieceCounts:
    """Pieces of pre-tokens for a SentencePiece BPE model.

    The model writes a space as U+2581, and no piece holds U+2581 after another
    character (checked here), so cutting before each run of it changes no merge.  A
    pre-token stands without its first U+2581, which it always has.
    """

    SPACE = "▁"

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(self.SPACE in p.lstrip(self.SPACE) for p in pieces):
            raise ValueError("pieces of this model cross spaces; its pre-tokens depend on each other")
        self.starts = np.array([p.startswith(self.SPACE) for p in pieces])
        self.pre_token = re.compile(f"{self.SPACE}({self.SPACE}*[^{self.SPACE}]*)")

    def pre_tokens(self, text: str) -> list[str]:
        if not text:
            return []
        if self.SPACE not in text and "" not in (words := text.split(" ")):
            return words
        return self.pre_token.findall(self.SPACE + text.replace(" ", self.SPACE))

    def _one(self, pre_token: str) -> int:
        # encode() puts one U+2581 in front by itself; a lone one is a piece of its own
        return len(self.sp.encode(pre_token)) if pre_token else 1

    def sizes(self, pre_tokens: list[str]) -> list[int]:
        """How many pieces each pre-token has; several go through the model at a time where pieces show their borders."""
        out: dict[str, int] = {}
        plain = [w for w in pre_tokens if w and w[0] != self.SPACE]
        for i in range(0, len(plain), PER_CALL):
            part = plain[i : i + PER_CALL]
            ids = np.asarray(self.sp.encode(" ".join(part)), dtype=np.int64)
            at = np.flatnonzero(self.starts[ids])
            if len(at) == len(part):
                out.update(zip(part, np.diff(at, append=len(ids)).tolist(), strict=True))
        return [out[w] if w in out else self._one(w) for w in pre_tokens]


def _bytes(texts: pa.Array) -> list[bytes]:
    return texts.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist


class WordIds:
    """Ids of whole texts for a ``tokenizers`` model whose pre-tokens never span white space.

    The ids of a word are kept as little-endian unsigned 32-bit bytes, so the ids of a
    text are the joined bytes of its words.  Texts are handled as UTF-8.  A word is cut
    once more into ASCII punctuation before, letters, and ASCII punctuation behind, where
    each part is one pre-token, so words that differ in these only share the letters.
    """

    MARK = "\x01"
    PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        ends = "aZ9.é'"
        if any(ids(f"{x}{gap}{y}") != ids(x) + ids(y) for gap in " \t\n\r\x0b\f" for x in ends for y in ends):
            raise ValueError("pre-tokens of this tokenizer cross white space; its words depend on each other")
        mark = ids(self.MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lowers = all(ids(c) == ids(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        #: Whether each id ends a pre-token; the model shows it by a suffix.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = None
        if suffix and not any(s[:1].isalpha() for s in self.special) and all(ids(f"a{x}b") == ids("a") + ids(x) + ids("b") for x in map(chr, self.PUNCTUATION) if x != "'"):
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.table: dict[bytes, bytes] = {b"": b""}

    def words(self, texts: list[bytes]) -> pa.LargeListArray:
        """Texts cut at ASCII white space, in lower case (A-Z) where that changes no id; words are empty where white space begins or ends a text."""
        given = low = pa.array(texts, pa.large_binary()).view(pa.large_string())
        if self.lowers:
            low = lower = pc.ascii_lower(given)
            for s in self.special:
                low = pc.if_else(pc.match_substring(lower, s.lower().decode()), given, low)
        cut = pc.ascii_split_whitespace(low)
        return pa.LargeListArray.from_arrays(cut.offsets.cast(pa.int64()), cut.values)

    def _cut(self, words: list[bytes]) -> list[list[bytes]]:
        """Words that are punctuation, letters and punctuation (a pre-token each), and these parts of them."""
        marks = self.PUNCTUATION.decode()
        tail = pc.ascii_rtrim(pa.array(words, pa.large_binary()).view(pa.large_string()), characters=marks)
        core = pc.ascii_ltrim(tail, characters=marks)
        letters, end, size = _bytes(core), pc.binary_length(tail).to_pylist(), pc.binary_length(core).to_pylist()
        head = [w[: e - n] for w, e, n in zip(words, end, size, strict=True)]
        whole = [
            (not c or c.isalpha() or c.decode().isalpha()) and (not h or (b"'" not in h and not any(s in w for s in self.special)))
            for w, h, c in zip(words, head, letters, strict=True)
        ]
        return [list(compress(x, whole)) for x in (words, head, letters, [w[e:] for w, e in zip(words, end, strict=True)])]

    def _ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        return (np.array(found.ids, dtype="<u4") for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def _single(self, words: list[bytes]) -> None:
        """Ids of words that are one pre-token each."""
        parts = [words[i : i + PER_CALL] for i in range(0, len(words), PER_CALL)]
        for part, ids in zip(parts, self._ids([b" ".join(p).decode() for p in parts]), strict=True):
            end = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(end) == len(part):
                whole = ids.tobytes()
                self.table.update(zip(part, [whole[a:b] for a, b in zip([0, *end], end, strict=False)], strict=True))
            else:
                self._each(part)

    def _each(self, words: list[bytes]) -> None:
        self.table.update(zip(words, (ids.tobytes() for ids in self._ids([w.decode() for w in words])), strict=True))

    def _marked(self, words: list[bytes]) -> None:
        """Ids of any words, told apart by a mark between them."""
        mark = self.MARK.encode()
        plain = [w for w in words if mark not in w and not any(s in w for s in self.special)] if self.mark is not None else []
        parts = [plain[i : i + PER_CALL] for i in range(0, len(plain), PER_CALL)]
        for part, ids in zip(parts, self._ids([(b" " + mark + b" ").join(p).decode() for p in parts]), strict=True):
            at = np.flatnonzero(ids == self.mark)
            if len(at) + 1 == len(part):
                whole = ids.tobytes()
                begin = [0, *(4 * (at + 1)).tolist()]
                end = [*(4 * at).tolist(), len(whole)]
                self.table.update((w, whole[a:b]) for w, a, b in zip(part, begin, end, strict=True))
        self._each([w for w in words if w not in self.table])

    def resolve(self, new: list[bytes]) -> None:
        """Add words to the table."""
        if self.ends is not None:
            words, *cuts = self._cut([w for w in new if not w.isalpha()])
            parts = set(filter(bytes.isalpha, new)).union(*cuts)
            self._single(list(parts.difference(self.table)))
            get = self.table.__getitem__
            self.table.update(zip(words, [get(a) + get(b) + get(c) for a, b, c in zip(*cuts, strict=True)], strict=True))
        if rest := [w for w in new if w not in self.table]:
            self._marked(rest)

    def encode(self, texts: Iterable[bytes]) -> Iterator[bytes]:
        """Ids of each text.  A chunk's words become numbers of its distinct words, so the table is asked once for each of these."""
        for part in chunks(texts):
            each = self.words(part)
            numbered = each.values.dictionary_encode()
            distinct = _bytes(numbered.dictionary)
            if new := [w for w in distinct if w not in self.table]:
                if len(self.table) + len(new) > MAX_TABLE:
                    self.clear()
                    new = distinct
                self.resolve(new)
            found = list(map(self.table.__getitem__, distinct))
            flat = np.frombuffer(b"".join(found), dtype="<u4")
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            first = np.cumsum(size) - size
            word = numbered.indices.to_numpy()
            n = size[word]
            upto = np.cumsum(n)
            ids = flat[np.repeat(first[word] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)].tobytes()
            at = 0
            for last in each.offsets.to_numpy()[1:].tolist():
                end = 4 * int(upto[last - 1]) if last else 0
                yield ids[at:end]
                at = end


@contextmanager
def one_task(memo):
    """Empty a memo table when its task ends: Python workers outlive tasks, and would hold it while others run."""
    try:
        yield memo
    finally:
        memo.clear()
        pa.default_memory_pool().release_unused()


@lru_cache(maxsize=2)
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _packed(values: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values)


def _unpacked(values: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(values)


def _chunk_rows(counter: PieceCounts, rows: list[pa.RecordBatch], number: int, shards: int) -> pa.RecordBatch:
    """A chunk's distinct pre-tokens by shard (parted by spaces, which none holds), and a row (shard null) with its documents' frequencies."""
    index: dict[str, int] = {}
    upto, slots, times = [0], array("I"), array("I")
    for t in chain.from_iterable(b.column("_text").to_pylist() for b in rows):
        freq = Counter(counter.pre_tokens(t or ""))
        slots.extend([index.setdefault(w, len(index)) for w in freq])
        times.extend(freq.values())
        upto.append(len(slots))
    words = list(index)
    shard = (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(words), dtype=np.uint32)
    place[order] = np.arange(len(words), dtype=np.uint32)
    kept = pa.Table.from_batches(rows).drop_columns(["_text"])
    listed = lambda v: pa.LargeListArray.from_arrays(pa.array(upto, pa.int64()), pa.array(v))
    kept = kept.append_column("_slots", listed(place[np.frombuffer(slots, dtype=np.uint32)])).append_column("_times", listed(np.frombuffer(times, dtype=np.uint32)))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(kept)
    own, first = np.unique(shard[order], return_index=True)
    parts = [_packed(" ".join([words[i] for i in at]).encode()) for at in np.split(order, first[1:])] if len(words) else []
    n = len(parts)
    return pa.RecordBatch.from_arrays(
        [pa.array([number] * (n + 1), pa.int64()), pa.array([*own.tolist(), None], pa.int32()), pa.array([*parts, None], pa.binary()), pa.array([None] * n + [sink.getvalue().to_pybytes()], pa.binary())],
        names=["chunk", "shard", "words", "docs"],
    )


def _answers(model_path: str):
    """Counts of a shard's pre-tokens, each distinct one counted once, for every chunk that has some."""

    def answer(table: pa.Table) -> pa.Table:
        counter = piece_counts(model_path)
        sizes: dict[str, int] = {}
        counts = []
        for packed in table.column("words"):
            words = _unpacked(packed.as_py()).decode().split(" ")
            new = [w for w in words if w not in sizes]
            sizes.update(zip(new, counter.sizes(new), strict=True))
            counts.append(_packed(np.fromiter(map(sizes.__getitem__, words), np.uint32, len(words)).tobytes()))
        return pa.table({"chunk": table.column("chunk"), "shard": table.column("shard"), "counts": pa.array(counts, pa.binary())})

    return answer


def _sums(kept: list[str]):
    """Documents of a chunk with the sum of frequency times pieces."""

    def add(docs: pa.Table, counts: pa.Table) -> pa.Table:
        order = np.argsort(counts.column("shard").to_numpy(), kind="stable")
        answers = counts.column("counts").to_pylist()
        pieces = np.frombuffer(b"".join(_unpacked(answers[i]) for i in order), dtype=np.uint32).astype(np.int64)
        out = []
        for blob in docs.column("docs"):
            own = pa.ipc.open_stream(blob.as_buffer()).read_all().combine_chunks()
            slots, times = (own.column(c).combine_chunks() for c in ("_slots", "_times"))
            total = np.r_[0, np.cumsum(pieces[slots.values.to_numpy()] * times.values.to_numpy())]
            out.append(own.select(kept).append_column("n_tokens", pa.array(np.diff(total[slots.offsets.to_numpy()]), pa.int64())))
        return pa.concat_tables(out)

    return add


def token_counts(df: DataFrame, keep: list[str | Column], text: str, model_path: str) -> DataFrame:
    """The ``keep`` columns of ``df`` with ``n_tokens``: pieces of the whole ``text``."""
    given = df.select(*keep)
    kept = [f"_k{i}" for i in range(len(given.columns))]
    source = df.select(*[F.col(k).alias(a) if isinstance(k, str) else k.alias(a) for k, a in zip(keep, kept, strict=True)], F.col(text).alias("_text"))
    schema = ", ".join(f"`{a}` {f.dataType.simpleString()}" for a, f in zip(kept, given.schema.fields, strict=True))

    shards = max(1, math.ceil((df.agg(F.sum(F.octet_length(text))).first()[0] or 0) / COUNT_BYTES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, number = piece_counts(model_path), TaskContext.get().partitionId() << 32
        rows: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                rows.append(whole.slice(at, 200))
                size += rows[-1].column("_text").nbytes
                if size >= COUNT_BYTES:
                    yield _chunk_rows(counter, rows, number, shards)
                    rows, size, number = [], 0, number + 1
        if rows:
            yield _chunk_rows(counter, rows, number, shards)

    chunked = write_table(source.mapInArrow(cut, "chunk long, shard int, words binary, docs binary"), "pre-tokens")
    counted = chunked.where("shard IS NOT NULL").select("chunk", "shard", "words").groupBy("shard").applyInArrow(_answers(model_path), "chunk long, shard int, counts binary")
    counted = write_table(counted, "pieces")
    frequencies = chunked.where("shard IS NULL").select(F.col("chunk").alias("own"), "docs")
    summed = frequencies.groupBy("own").cogroup(counted.groupBy("chunk")).applyInArrow(_sums(kept), f"{schema}, n_tokens long")
    return summed.toDF(*given.columns, "n_tokens")
