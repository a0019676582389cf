"""Packing: order-preserving dynamic programming over cut points.

The token stream of a partition, in row order, is cut into windows of at most
``size`` tokens.  A cut may lie at the end of a document (free), at the end of a
sentence (``SENTENCE`` tokens), or at a point of a coarse grid (``INSIDE``
tokens).  With positions p and least costs f,

    f[j] = cut[j] + window + min over p[i] >= p[j] - size of f[i] + size - (p[j] - p[i])

so the minimum runs over f[i] + p[i] in a sliding range, which a monotone queue
gives in constant time.  A window whose length is a power of two needs no
padding; those transitions are tried beside it.

Each partition is packed by itself with a bounded buffer, so only its last
window can be much padded, no rows are shuffled, and a lost executor repeats
only its own tasks.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, parts, table

SIZE = 1024
VOCABULARY = "byte_bpe_50k.json"
#: Costs of a window and of cuts, in tokens of padding.
WINDOW, SENTENCE, INSIDE = 8, 2, 8
GRID = 32
#: Tokens that are packed together; cuts in the last windows of a buffer wait for the next.
BUFFER = 1 << 18


def encoder(vocabulary: str | None = None, added: bool = False):
    """The function from a text to its ids, and which ids end a sentence.

    ``vocabulary`` is the path of a ``tokenizers`` file.  The file of the same
    name for ``tiktoken``, beside it, gives the same ids in a quarter of the time;
    a test holds them together.  Its pattern matcher gives up on some texts, such
    as a million spaces; ``tokenizers`` encodes those.  ``added``: whether a name of
    the file's added tokens in a text is that token, as ``tokenizers`` has it by
    default, or text like any other; ``tokenizers`` encodes the texts that hold one.
    """
    import public_tokenizers
    import tiktoken

    vocabulary = str(vocabulary or public_tokenizers.path(VOCABULARY))
    with open(vocabulary.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    with open(vocabulary, encoding="utf-8") as f:
        names = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]} if added else {}
    holds = re.compile("|".join(map(re.escape, names))).search if names else lambda text: None
    ends = np.zeros(max(*ranks.values(), *names.values()) + 2, bool)
    for token, rank in ranks.items():
        ends[rank] = token.rstrip()[-1:] in (b".", b"!", b"?") or b"\n" in token
    slow = []

    def encode(text: str) -> np.ndarray:
        if not holds(text):
            try:
                return np.frombuffer(coder.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except ValueError:
                pass
        if not slow:
            import tokenizers

            slow.append(tokenizers.Tokenizer.from_file(vocabulary))
            slow[0].encode_special_tokens = not added  # their names in a text are text, unless asked for
        return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode, ends


def best_cuts(total: int, documents: np.ndarray, sentences: np.ndarray, size: int = SIZE) -> tuple[list[int], float]:
    """The cheapest cuts of ``total`` tokens, its end included, and their cost.

    ``documents`` and ``sentences`` are positions at which a document or a
    sentence has just ended.
    """
    grid = min(GRID, size)
    pos = np.unique(np.concatenate([[0, total], documents, sentences, np.arange(0, total, grid)]).astype(np.int64))
    pen = np.full(len(pos), INSIDE)
    pen[np.searchsorted(pos, sentences)] = SENTENCE
    pen[np.searchsorted(pos, documents)] = 0
    pen[-1] = 0
    p, pen = pos.tolist(), pen.tolist()
    index = {x: i for i, x in enumerate(p)}
    powers = [1 << k for k in range(5, size.bit_length()) if 1 << k < size]
    f, g, back = [0.0] * len(p), [0.0] * len(p), [0] * len(p)
    queue = deque([0])
    get = index.get
    for j in range(1, len(p)):
        at = p[j]
        while p[queue[0]] < at - size:
            queue.popleft()
        i = queue[0]
        best = g[i] + size - at
        for k in powers:
            h = get(at - k)
            if h is not None and f[h] < best:
                best, i = f[h], h
        f[j] = best = best + WINDOW + pen[j]
        g[j], back[j] = (best := best + at), i
        while queue and g[queue[-1]] >= best:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(p) - 1
    while j:
        cuts.append(p[j])
        j = back[j]
    return cuts[::-1], f[-1]


class Packer:
    """Packs a stream of documents; yields pieces as columns."""

    def __init__(self, ends: np.ndarray, size: int, first: int, ids: bool):
        self.ends, self.size, self.next, self.keep = ends, size, first, ids
        self.base = self.end = 0
        self.tokens: list[np.ndarray] = []
        self.docs: list[tuple] = []  # id, first position, tokens

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.end, len(ids)))
        self.tokens.append(ids)
        self.end += len(ids)

    def flush(self, last: bool) -> dict | None:
        total = self.end - self.base
        if not total:
            return None
        ids = np.concatenate(self.tokens)
        starts = np.array([d[1] for d in self.docs], np.int64) - self.base
        sentences = np.flatnonzero(self.ends[ids]) + 1
        cuts, _ = best_cuts(total, starts[starts > 0], sentences, self.size)
        if not last:
            cuts = [c for c in cuts if c <= total - 2 * self.size]
            if not cuts:
                self.tokens = [ids]
                return None
        done = cuts[-1]
        edges = np.unique(np.concatenate([[0], cuts, starts[(starts > 0) & (starts < done)]]).astype(np.int64))
        a, b = edges[:-1], edges[1:]
        seq = np.searchsorted(np.array(cuts), a, "right")
        seq_start = np.concatenate([[0], cuts])[seq]
        doc = np.searchsorted(starts, a, "right") - 1
        out = {
            "doc_id": [self.docs[d][0] for d in doc],
            "start": a - starts[doc],
            "length": b - a,
            "ids_crc32": np.fromiter((zlib.crc32(ids[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.int64, len(a)),
            "doc_tokens": np.array([self.docs[d][2] for d in doc], np.int64),
            "sequence_id": seq + self.next,
            "offset": a - seq_start,
        }
        if self.keep:
            out["ids"] = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids[:done].astype(np.int32)))
        self.next += len(cuts)
        self.base += done
        self.tokens = [ids[done:]]
        self.docs = [d for d in self.docs if d[1] + d[2] > self.base]
        return out


def pack(documents: DataFrame, size: int = SIZE, separator: int = 0, with_ids: bool = True, text: str = "text", key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """One row for each piece of a document in a window.

    Columns: the key, ``start`` (tokens of the document before the piece),
    ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and,
    if asked for, ``ids``.  A null or empty text is the separator alone; equal
    rows are packed as often as they occur; other columns are not read; an empty
    table gives no rows.  Sequence ids are unique, not gapless.  ``vocabulary`` is
    a path that every executor can read; the names of its added tokens in a text
    are those tokens.
    """
    schema = f"{key} {dict(documents.dtypes)[key]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = packer = None
        for batch in parts(batches, 256):
            if packer is None:
                encode, ends = encoder(vocabulary, added=True)
                packer = Packer(ends, size, TaskContext.get().partitionId() << 40, with_ids)
                kind = batch.schema.field(0).type
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packer.add(doc_id, np.append(encode(x), np.uint32(separator)) if x else np.array([separator], np.uint32))
                if packer.end - packer.base >= BUFFER and (out := packer.flush(False)):
                    yield made(out, kind)
        if packer and (out := packer.flush(True)):
            yield made(out, kind)

    def made(out: dict, kind) -> pa.RecordBatch:
        out[key] = pa.array(out.pop("doc_id"), kind)
        return pa.RecordBatch.from_pydict({key: out.pop(key)} | out)

    return map_arrow(documents.select(key, text), run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
