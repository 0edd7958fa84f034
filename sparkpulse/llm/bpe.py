"""Byte-level BPE encoding and decoding by monoid tree reduction.

The encodings of byte strings form a monoid: ``join(encode(x), encode(y)) == encode(x + y)``.  ``encode`` halves its
input down to short leaves, which are merged directly, and joins neighbours upwards.  A join re-encodes a window around
the seam and grows it until the tokens outside provably stabilise.  The proof rests on a property of rank-merge BPE: a
token sequence is the encoding of its bytes if, and only if, each pair of neighbours is (``encode(a + b) == [a, b]``).
Pairs left of the window, right of it and inside it hold already, so only the pairs at the window's two edges are tested.

Texts are cut into pieces by the tokenizer's pattern first; each piece is encoded separately and a piece that is itself
in the vocabulary is that token.  Decoding concatenates the tokens' bytes pairwise up a tree.

Nulls are encoded as the empty text (no ids).  Repeated rows and extra columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_FILE = "byte_bpe_multi_50k.tiktoken"
#: The base case of the halving, in bytes.
LEAF = 8
#: Encoded pieces that a worker remembers.
CACHE = 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


#: Splits text before the merges (the public tokenizers' own pattern, a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Unicode white space, as the pattern's \\s has it.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Cuts only where the pattern always cuts: around white space, a last blank going with what follows.  Most chunks recur.
CHUNKS = re.compile(f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+").findall

MARKS = frozenset(".,;:!?|")


def pack(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Codec:
    """Encodes and decodes with a rank file.  ``path`` is read on the executor: every node has the tokenizer files."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.none = len(self.tokens)  # no rank
        self.find = regex.compile(pattern).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.leaves: dict[bytes, list[int]] = {}
        encode, find = self.piece, self.find

        class Memo(dict):
            def __missing__(self, chunk: str) -> bytes:
                if len(self) >= CACHE:
                    self.clear()
                body = chunk[1:] if chunk[0] == " " else chunk
                if body.isalpha():  # one piece
                    out = pack(encode(chunk.encode("utf-8", "replace")))
                elif body[-1:] in MARKS and body[:-1].isalpha():  # two
                    out = self[chunk[:-1]] + self[chunk[-1]]
                elif len(pieces := find(chunk)) == 1:
                    out = pack(encode(chunk.encode("utf-8", "replace")))
                else:
                    out = b"".join(map(self.__getitem__, pieces))
                self[chunk] = out
                return out

        self.memo = Memo()

    def leaf(self, data: bytes) -> list[int]:
        """The encoding of a short string; leaves and seams recur far more often than words do."""
        known = self.leaves.get(data)
        if known is None:
            if len(self.leaves) >= CACHE:
                self.leaves.clear()
            known = self.leaves[data] = self.merged(data)
        return known

    def merged(self, data: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until no pair is in the vocabulary."""
        n = len(data)
        get, no = self.ranks.get, self.none
        parts = [data[i : i + 1] for i in range(n)]
        ranks = [get(data[i : i + 2], no) for i in range(n - 1)]
        while ranks and (best := min(ranks)) < no:
            at = ranks.index(best)
            parts[at] += parts.pop(at + 1)
            ranks.pop(at)
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], no)
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], no)
        return [self.ranks[p] for p in parts]

    def stable(self, a: int, b: int) -> bool:
        """Whether these neighbours stay as they are when merged together."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join(self, x: list[int], y: list[int]) -> list[int]:
        """The encoding of x's bytes followed by y's."""
        if not x or not y:
            return x or y
        if self.stable(x[-1], y[0]):
            return x + y
        left, right = 1, 1
        while True:
            a, b = max(0, len(x) - left), min(len(y), right)
            window = b"".join(self.tokens[t] for t in x[a:]) + b"".join(self.tokens[t] for t in y[:b])
            middle = self.leaf(window) if len(window) <= 12 * LEAF else self.window(x[a:], y[:b])
            left_ok = a == 0 or self.stable(x[a - 1], middle[0])
            right_ok = b == len(y) or self.stable(middle[-1], y[b])
            if left_ok and right_ok:
                return x[:a] + middle + y[b:]
            left, right = left if left_ok else 2 * left, right if right_ok else 2 * right

    def window(self, x: list[int], y: list[int]) -> list[int]:
        return self.merge(b"".join(self.tokens[t] for t in x) + b"".join(self.tokens[t] for t in y))

    def merge(self, data: bytes) -> list[int]:
        """Plain merging of a long window with a heap: the seam's worst case, as for runs of one character."""
        import heapq

        n = len(data)
        text: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        get, heap = self.ranks.get, []
        for i in range(n - 1):
            if (r := get(data[i : i + 2])) is not None:
                heap.append((r, i, 2))
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            if text[i] is None or (j := nxt[i]) >= n or len(text[i]) + len(text[j]) != size or get(text[i] + text[j]) != r:
                continue
            text[i], text[j] = text[i] + text[j], None
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if (q := get(text[i] + text[k])) is not None:
                    heapq.heappush(heap, (q, i, len(text[i]) + len(text[k])))
            if (h := prv[i]) >= 0 and (q := get(text[h] + text[i])) is not None:
                heapq.heappush(heap, (q, h, len(text[h]) + len(text[i])))
        return [self.ranks[t] for t in text if t is not None]

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.leaf(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        return self.tree(data)

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids of the whole text."""
        return np.frombuffer(b"".join(map(self.memo.__getitem__, CHUNKS(text or ""))), "<u4")

    def decode(self, ids) -> bytes:
        """Concatenates up the tree: blocks of tokens first, then the blocks."""
        level = list(map(self.tokens.__getitem__, np.asarray(ids).tolist()))
        while len(level) > 1:
            it = iter(level)
            level = [b"".join(chunk) for chunk in iter(lambda: list(islice(it, 1024)), [])]
        return level[0] if level else b""


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str = PATTERN) -> Codec:
    """One per worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode_column(df: DataFrame, *, text: str = "text", keep: list[str] | None = None, path: str | None = None, dtype: str = "<u4") -> DataFrame:
    """The kept columns (all but text by default), ``n_tokens`` and ``token_ids`` (binary, little-endian ids)."""
    path = path or default_path()
    keep = [c for c in df.columns if c != text] if keep is None else keep
    out = df.select(*keep, F.lit(0).cast("long").alias("n_tokens"), F.lit(b"").alias("token_ids")).schema
    arrow_names = [*keep, "n_tokens", "token_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            ids = [c.encode(t.as_py()) for t in batch.column(len(keep))]
            cols = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype(dtype).tobytes() for x in ids], pa.binary())], names=arrow_names)

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, out)


def digests(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode each whole text; ids and decoded bytes as digests.  ``ok``: the decoded bytes are the text's."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            n, a, b, ok = [], [], [], []
            for t in batch.column(1):
                t = t.as_py() or ""
                ids = c.encode(t)
                back = c.decode(ids)
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                b.append(hashlib.sha256(back).hexdigest())
                ok.append(back == t.encode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(ok, pa.bool_())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ok"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ok boolean")
