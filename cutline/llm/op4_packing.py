"""Vector bin packing of training examples.

Each example has a size in several dimensions (tokens, segments, loss-bearing tokens) and each sequence a capacity in
each. The packer fills one sequence at a time: among the examples that still fit, it places the one whose size has the
largest dot product with what is free (both as shares of the capacity). When none fits whole, or the last segment would
not fill the sequence, an example is cut to fill the free tokens. An example of more than a sequence is cut first: where
its loss tokens alone would break their limit, each sequence gets some of its prompt from its front and some of its loss
tokens from its end, in its own proportion. Examples are grouped by size, so a choice looks at size classes and not at
examples.

An example's prompt comes first and bears no loss. Documents have no prompt of their own: the first PROMPT_PERCENT of
their tokens count as one, as in prefix language modelling.

Packing runs within the tasks of the scan: no shuffle, and a lost task is packed again from its own input split. Each
task's window holds a bounded number of tokens; what is left at its end goes into sequences whose lengths are powers of
two, which are not padded. Sequence ids hold the task's number in the upper bits.

Null texts count as empty; an empty text has the end id alone. Of sizes with equal scores the one that came first in the task
is placed. Columns but the id, the text and the loss are ignored, and may have any name. Repeated rows are packed as often as they come. Texts of
any length are cut. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

LENGTH = 1024
#: Most pieces that share a sequence, and most loss-bearing tokens in it.
SEGMENTS, LOSS = 12, 832
PROMPT_PERCENT = 25
#: Chunks that each Python worker remembers: by default, which fits beside the memory that earlier stages of a job have
#: taken (some 80 MB), and in the query, which has the executor to itself (300 MB).
REMEMBERED, REMEMBERED_ALONE = 400_000, 1_500_000
#: Tokens that wait in a task before it packs.
WINDOW = 1 << 20
END = 0
ODD = re.compile(r"\s \s|\s $")
#: A chunk of one or two words: letters end a token before punctuation, and a lone line feed is a token.
WORDS = re.compile(r"( ?[^\W\d_]+)([.,;:!?]*)(?:(\n)([^\W\d_]+)([.,;:!?]*))?")


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    Byte-level BPE never merges across the space before a word, so a text is cut there and the ids of each chunk are
    remembered (at most `most` chunks, of about 200 bytes each). Texts where a space has white space on both sides are encoded whole.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {"": b""}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [pack_ids(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, chunk: str) -> tuple[str, ...]:
        """The chunk's parts that are encoded apart, if it is made of words; else the chunk."""
        m = WORDS.fullmatch(chunk)
        if m is None or not (m[1].lstrip(" ").isalpha() and (m[4] or "a").isalpha()):
            return (chunk,)
        return tuple(filter(None, m.groups()))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if ODD.search(t) else t.replace(" ", "\0 ").split("\0") if "\0" not in t else None for t in texts]
        known = self.known
        new = set().union(*filter(None, cut)).difference(known)
        # one word, or a sign before it, is its own only part
        parted = {c: parts for c in new if not c[1:].isalpha() and len(parts := self._parts(c)) > 1}
        lone = new.difference(parted)
        for parts in parted.values():
            lone.update(parts)
        lone = list(lone.difference(known))
        full = len(known) >= self.most
        known.update(zip(lone, self._ids(lone), strict=True))
        for c, parts in parted.items():
            known[c] = b"".join([known[p] for p in parts])
        whole = iter(self._ids([t for t, chunks in zip(texts, cut, strict=True) if chunks is None]))
        out = [next(whole) if chunks is None else b"".join(map(known.__getitem__, chunks)) for chunks in cut]
        for c in (*lone, *parted):
            if full or len(c) > 48 or "\n" in c:
                del known[c]
        return out


def pack_ids(ids: list[int]) -> bytes:
    own = array("I", ids)
    if sys.byteorder == "big":
        own.byteswap()
    return own.tobytes()


def open_length(n: int) -> bool:
    """Is a sequence of n tokens not padded?"""
    return n & (n - 1) == 0


def pack(items: list[tuple[int, int]], capacity: tuple[int, int, int] = (LENGTH, SEGMENTS, LOSS)) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, tokens) that hold every token of items (tokens, loss tokens) once.

    The loss tokens of an item are its last ones.
    """
    tokens, segments, loss = capacity
    out: list[list[tuple[int, int, int]]] = []
    classes: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def lossy(k: int, start: int, end: int) -> int:
        return max(0, end - max(start, items[k][0] - items[k][1]))

    for k, (n, _) in enumerate(items):
        start, end = 0, n
        while end - start >= tokens:
            left = lossy(k, start, end)
            if min(left, tokens) <= loss:
                out.append([(k, start, tokens)])
                start += tokens
            elif left * tokens <= loss * (end - start) and segments > 1:
                own = -(-left * tokens // (end - start))
                out.append([(k, start, tokens - own), (k, end - own, own)])
                start, end = start + tokens - own, end - own
            else:
                break
        if end > start:
            classes.setdefault((end - start, lossy(k, start, end)), []).append((k, start))

    sizes = sorted(classes)
    table = np.array(sizes, np.int64).reshape(-1, 2)
    left = np.array([len(classes[s]) for s in sizes], np.int64)
    index = {s: i for i, s in enumerate(sizes)}
    waiting = int(left.sum())

    def grow(size: tuple[int, int]) -> None:
        nonlocal table, left
        if size not in index:
            index[size] = len(sizes)
            sizes.append(size)
            table = np.vstack([table, [size]])
            left = np.append(left, 0)
        left[index[size]] += 1

    while waiting:
        free = np.array([tokens, loss], np.int64)
        room, row = segments, []
        while room and free[0] and waiting:
            fits = (left > 0) & (table[:, 0] <= free[0]) & (table[:, 1] <= free[1])
            # shares of the capacity; a piece's share of the segments is the same for all
            score = np.where(fits, table[:, 0] * (free[0] / tokens**2) + table[:, 1] * (free[1] / loss**2), -1.0)
            i = int(score.argmax())
            if fits[i] and (room > 1 or table[i, 0] == free[0]):
                n, used = sizes[i]
                k, start = classes[sizes[i]].pop()
                left[i] -= 1
                waiting -= 1
            else:
                # as much of the front of the largest as fits, if that is more than the best whole one
                j = int(np.where(left > 0, table[:, 0], -1).argmax())
                size = sizes[j]
                n = int(min(free[0], size[0] - size[1] + free[1], size[0]))
                if fits[i] and n <= table[i, 0]:
                    j, size, n = i, sizes[i], sizes[i][0]
                if n <= 0:
                    break
                k, start = classes[size].pop()
                left[j] -= 1
                rest = (size[0] - n, min(size[1], size[0] - n))
                used = size[1] - rest[1]
                if rest[0]:
                    classes.setdefault(rest, []).append((k, start + n))
                    grow(rest)
                else:
                    waiting -= 1
            row.append((k, start, n))
            free -= (n, used)
            room -= 1
        if not row:
            raise ValueError("an example does not fit an empty sequence")
        out.append(row)
    return out


def unpadded(row: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces dealt to sequences whose lengths are powers of two."""
    out, n = [], sum(p[2] for p in row)
    row = list(reversed(row))
    while n:
        size = 1 << (n.bit_length() - 1)
        n -= size
        part = []
        while size:
            k, start, m = row.pop()
            if m > size:
                row.append((k, start + size, m - size))
                m = size
            part.append((k, start, m))
            size -= m
        out.append(part)
    return out


def pack_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", segments: int = SEGMENTS, keep_ids: bool = False, loss_col: str | None = None, loss_tokens: int = LOSS, remembered: int = REMEMBERED) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids). loss_col: how many of an example's last tokens, its end included, bear loss (null, or without loss_col: all but the first PROMPT_PERCENT); a sequence holds loss_tokens of them at most. tokenizer: a file of the tokenizers library, on every executor. remembered: chunks whose ids a Python worker keeps, which changes the speed only."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids

    def task(batches):
        import pyarrow as pa

        encoder = _encoder(tokenizer, remembered)
        base = TaskContext.get().partitionId() << 32
        made, waits, held = 0, [], 0
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * keep_ids

        def rows():
            nonlocal made, waits, held
            cols: list[list] = [[] for _ in names]
            got = pack([(n := len(x[1]) // 4, n - n * PROMPT_PERCENT // 100 if x[2] is None else max(0, min(n, x[2]))) for x in waits], (LENGTH, segments, loss_tokens))
            got = [part for row in got for part in ([row] if sum(p[2] for p in row) == LENGTH else unpadded(row))]
            for row in got:
                offset = 0
                for k, start, n in row:
                    doc, ids, _ = waits[k]
                    own = ids[4 * start : 4 * (start + n)]
                    values = (doc, start, n, zlib.crc32(own), len(ids) // 4, base + made, offset)
                    for col, v in zip(cols, values + ((np.frombuffer(own, "<i4"),) if keep_ids else ()), strict=True):
                        col.append(v)
                    offset += n
                made += 1
            waits, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = encoder.encode(part.column(1).to_pylist())
                for doc, x, lossy in zip(part.column(0).to_pylist(), ids, part.column(2).to_pylist() if loss_col else [None] * len(ids), strict=True):
                    waits.append((doc, x + END.to_bytes(4, "little"), lossy))
                    held += len(x) // 4 + 1
                if held >= WINDOW:
                    yield rows()
        if waits:
            yield rows()

    schema = ", ".join(f"{n} {'array<int>' if n == 'ids' else 'long'}" for n in names)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t"), *([F.col(loss_col).cast("long")] if loss_col else [])).mapInArrow(task, schema)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, most: int) -> Encoder:
    """One for each Python worker, which serves many tasks."""
    if (path, most) not in _ENCODERS:
        _ENCODERS[path, most] = Encoder(path, most)
    return _ENCODERS[path, most]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 1024 tokens, with SEGMENTS pieces and LOSS loss-bearing tokens at most."""
    return pack_texts(table(spark, sf_dir, "documents"), tokenizer_path(), remembered=REMEMBERED_ALONE)
