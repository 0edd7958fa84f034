"""Language identification by cross-parsing entropy.

A suffix automaton is built over labelled text of each language.  A text is parsed against it: each phrase is the longest
match that the automaton has from the current position on, so the number of phrases estimates the cross entropy (Ziv and
Merhav).  The language that needs the fewest phrases wins; the score is its margin, 1 - fewest / next fewest, turned into
[0, 1] by a logistic curve over the phrases.

Each automaton covers a bounded sample: ``sample_docs`` labelled texts per language (``sample``), joined and cut at ``sample_bytes``.  Every text is parsed
whole, in segments of ``SEGMENT`` bytes (no phrase crosses the end of a segment), so the automata run over many segments
in step as table lookups.

Null texts and texts without a letter are ``und`` with score 0.  Ties go to the language that sorts first.  Without any
labelled text every document is ``und``.  Labels of the predicted rows, their source and id are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 512
#: Byte values folded into others: A-Z become a-z; runs of other ASCII controls and blanks are not merged.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[9:14] = 32


def automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of data."""
    nxt: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for c in data:
        cur = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return nxt


class Model:
    """Dense tables: table[state * width + symbol] is the next state, doubled, plus 1 where a phrase ends before symbol."""

    def __init__(self, texts: dict[str, bytes]):
        self.langs = sorted(texts)
        folded = {k: FOLD[np.frombuffer(texts[k], np.uint8)].tobytes() for k in self.langs}
        used = sorted(set().union(*folded.values())) if folded else []
        self.symbol = np.full(256, len(used), np.int32)  # the last symbol occurs in no sample
        self.symbol[used] = np.arange(len(used))
        self.symbol = self.symbol[FOLD]
        self.width = len(used) + 1
        code = {b: i for i, b in enumerate(used)}
        self.tables = []
        for k in self.langs:
            nxt = automaton(folded[k])
            dead = len(nxt)  # after a symbol that the sample lacks, which is a phrase of its own
            root = np.full(self.width, dead, np.int32)
            for c, s in nxt[0].items():
                root[code[c]] = s
            table = np.tile(2 * root + 1, (len(nxt) + 1, 1))
            for i, row in enumerate(nxt):
                for c, s in row.items():
                    table[i, code[c]] = 2 * s
            table[0, :] = 2 * root
            self.tables.append(table.reshape(-1))

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        segments = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), segments)
        total = np.zeros((len(texts), len(self.langs)), np.int64)
        if not len(owner):
            return total
        grid = np.full((len(owner), SEGMENT), -1, np.int32)
        starts = np.concatenate([[0], np.cumsum(segments)])
        for i, t in enumerate(texts):
            row = self.symbol[np.frombuffer(t, np.uint8)]
            flat = grid[starts[i] : starts[i + 1]].reshape(-1)
            flat[: len(row)] = row
        length = (grid >= 0).sum(axis=1)
        order = np.argsort(-length, kind="stable")
        grid, owner, length = np.ascontiguousarray(grid[order].T), owner[order], length[order]
        alive = np.searchsorted(-length, -np.arange(1, SEGMENT + 1), side="right")
        for k, table in enumerate(self.tables):
            state = np.zeros(len(owner), np.int32)
            count = np.ones(len(owner), np.int32)
            for step in range(SEGMENT):
                n = alive[step]
                if not n:
                    break
                found = table[state[:n] * self.width + grid[step, :n]]
                state[:n] = found >> 1
                count[:n] += found & 1
            total[:, k] = np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)
        return total


def sample(labelled: DataFrame, *, text: str = "text", lang: str = "lang", sample_docs: int = 128, sample_bytes: int = 24_000, piece: int = 200, max_langs: int = 200) -> dict[str, bytes]:
    """Up to sample_bytes of text per language, on the driver: bounded by the parameters (max_langs languages, the first in order).

    Of each language sample_docs different texts with a letter are fitted, those of ``piece`` characters or more first, then by
    hash of the text, with ``piece`` characters each: many short pieces outweigh a few wrong labels.  Null labels and texts are left
    out, ids aren't read."""
    n = F.length(text)
    h = F.xxhash64(text)
    keyed = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    ranked = keyed.select(F.col(lang).alias("lang"), (n < piece).alias("late"), h.alias("h")).groupBy("lang", "late", "h").agg(F.lit(1).alias("one"))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("late", "h"))).where(F.col("r") <= sample_docs)
    chosen = {(r.lang, r.h): r.r for r in ranked.orderBy("lang", "r").limit(sample_docs * max_langs).collect()}
    if not chosen:
        return {}
    picked = keyed.where(h.isin(sorted({k for _, k in chosen}))).select(F.col(lang).alias("lang"), h.alias("h"), F.substring(text, 1, piece).alias("text"))
    parts: dict[str, list] = {}
    for r in picked.groupBy("lang", "h").agg(F.min("text").alias("text")).collect():  # a row for each chosen text
        if (r.lang, r.h) in chosen:
            parts.setdefault(r.lang, []).append((chosen[r.lang, r.h], r.text))
    return {k: "\n".join(t for _, t in sorted(v)).encode("utf-8", "replace")[:sample_bytes] for k, v in parts.items()}


def predict(df: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), batch: int = 500) -> DataFrame:
    """The kept columns, lang_pred and score."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # tables of a bounded sample
    schema = df.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                texts = [t.as_py() or "" for t in b.column(len(keep))]
                lettered = [any(map(str.isalpha, t)) for t in texts]
                langs, scores = [], []
                counts = m.phrases([t.encode("utf-8", "replace") if ok else b"" for t, ok in zip(texts, lettered, strict=True)]) if m.langs else np.zeros((len(texts), 0), np.int64)
                for c, ok in zip(counts, lettered, strict=True):
                    if not ok or not len(c):
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    best = int(c.argmin())
                    rest = np.delete(c, best)
                    gap = float(rest.min() - c[best]) if len(rest) else float(c[best])
                    langs.append(m.langs[best])
                    scores.append(1 - 0.5 * float(np.exp(-gap / 4)))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
