"""Quality rules by distribution divergence, in DataFrame functions only.

Two histograms of each document are compared with references of every language by Jensen-Shannon distance (base 2, 0 to 1):
characters by class, and the language's commonest words, of any length, against all other words.  The nearest language decides,
so a wrong label does no harm.

References are counted over the words of all documents by their language label (null is a label of its own), but for texts of
under ten words or with more than ``max_symbols`` symbols.  Every label of ``min_reference`` words gets one, however many labels
there are; its ``top`` commonest words have a bin each and all others share the last.  Documents whose label has none pass the
divergence test: there is nothing to hold them against.  Each document is held against every reference, so the work grows with
documents times references, and the driver holds ``top`` words of each.

Guards.  A document is judged on characters only from ``min_chars`` on and on words only from ``min_words`` on.  A sample of n
words strays from its own source by (bins - 1) / (8 n ln 2) in squared distance on average; this much is taken off.  The first
``free_digits`` digits beyond a language's share are not held against a document.

Base rules come first: too few words, or too large a share of words in repeated five-word windows.

Null and empty texts have no words and fail the base rules.  Repeated rows are judged alike.  An empty table gives no rows.
Other columns, whatever their names, are ignored by ``verdicts`` and kept by ``passing``.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
DIGITS = "0123456789"
WINDOW = 5
#: Word characters by class: lower-case and other letters, upper-case letters, ASCII digits, symbols, the rest.
CLASSES = ("letters", "upper", "digits", "symbols", "rest")
#: Largest share of symbols in a text that counts for a reference.
MAX_SYMBOLS = 0.02


@dataclass
class Reference:
    """A label's class shares (in the order of CLASSES) and its commonest words with their shares."""

    lang: str | None
    classes: list[float]
    words: list[str]
    shares: list[float]


def bind(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE))


def repeated_words(w: Column) -> Column:
    """Words of w that stand in a window of WINDOW words which occurs more than once."""

    def positions(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, p, k: F.coalesce(F.get(s, k)["h"] == p["h"], F.lit(False))
        return bind(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda p, k: same(s, p, k - 1) | same(s, p, k + 1)), lambda p: p["i"])))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])

    def whole(ws: Column) -> Column:
        windows = F.slice(F.transform(ws, lambda w, i: F.xxhash64(w, *(F.get(ws, i + k) for k in range(1, WINDOW)))), F.lit(1), F.greatest(F.size(ws) - (WINDOW - 1), F.lit(0)))
        return bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(positions(h))))

    return F.when(F.size(w) < WINDOW, F.lit(0).cast("long")).otherwise(whole(w))


def classes(joined: Column) -> Column:
    """Counts in the order of CLASSES of a text without white space; one pass over it, the rest over what that leaves."""
    left = lambda x, pattern: F.regexp_replace(x, pattern, "")
    size = lambda x: F.length(x).cast("long")

    def others(n: Column, m: Column) -> Column:
        digits, symbols = size(left(n, f"[^{DIGITS}]+")), size(left(n, f"[^{SYMBOLS}]+"))
        return F.array(size(joined) - size(m), size(m) - size(n), digits, symbols, size(n) - digits - symbols)

    return bind(left(joined, r"[\p{L}&&[^\p{Lu}]]+"), lambda m: bind(left(m, r"\p{Lu}+"), lambda n: others(n, m)))


def among(label: Column, labels: list) -> Column:
    """Whether label is one of labels, of which null may be one."""
    given = [x for x in labels if x is not None]
    return (F.coalesce(label.isin(given), F.lit(False)) if given else F.lit(False)) | (label.isNull() if None in labels else F.lit(False))


def references(docs: DataFrame, *, text: str = "text", lang: str = "lang", top: int = 30, min_reference: int = 2000) -> list[Reference]:
    """The references of docs, that with most words first: one of each label that has min_reference words, of top words at most."""
    t = F.coalesce(F.col(text), F.lit(""))
    symbols = F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", ""))
    d = docs.where(symbols <= MAX_SYMBOLS * F.length(t)).select(F.col(lang).alias("lang"), words(F.col(text)).alias("w"))
    counts = d.where(F.size("w") >= 10).select("lang", F.explode("w").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    sums = counts.select("lang", "n", classes(F.col("word")).alias("c")).groupBy("lang").agg(F.sum("n").alias("total"), *(F.sum(F.col("n") * F.get("c", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))))
    chosen = sums.where(F.col("total") >= min_reference).withColumnRenamed("lang", "label")
    folded = counts.groupBy("lang", F.lower("word").alias("word")).agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    best = folded.withColumn("r", rank).where(F.col("r") <= top)
    # One job: both sides read the shuffled counts, and nothing is written.  It returns top rows of each chosen label.
    out: dict = {}
    for r in chosen.join(best, F.col("label").eqNullSafe(F.col("lang")), "left").orderBy(F.desc("total"), "label", "r").collect():
        n = sum(r[f"c{i}"] for i in range(len(CLASSES))) or 1
        ref = out.setdefault(r["label"], Reference(r["label"], [r[f"c{i}"] / n for i in range(len(CLASSES))], [], []))
        if r["word"] is not None:
            ref.words.append(r["word"])
            ref.shares.append(r["n"] / r["total"])
    return list(out.values())


def jsd(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence (the squared distance) of two arrays of shares."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2)


def held(refs: list[Reference]) -> Column:
    """The references as one constant, an array that expressions go through: they don't grow with the number of references."""
    rows = [{"classes": r.classes, "words": r.words, "shares": r.shares, "total": sum(r.shares), "rest": max(0.0, 1 - sum(r.shares)), "noise": len(r.words) / (8 * math.log(2))} for r in refs]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<classes:array<double>,words:array<string>,shares:array<double>,total:double,rest:double,noise:double>>")


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < 10) | (100 * n_repeat > 20 * n_words)


def judged(refs: list[Reference], *, text: str = "text", lang: str = "lang", min_chars: int = 200, min_words: int = 50, max_class: float = 0.2, max_word: float = 0.23, free_digits: int = 60) -> Column:
    """One struct per document: base counts, base_failed, kept and the two distances (null without references or counts)."""
    common = sorted({w for r in refs for w in r.words})
    digit = CLASSES.index("digits")
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    least = lambda refs, distance: F.array_min(F.transform(held(refs), distance)) if refs else F.lit(None).cast("double")

    def counted(ws: Column) -> Column:
        found = F.filter(F.transform(ws, F.lower), lambda w: w.isin(common)) if common else F.array().cast("array<string>")
        joined = F.array_join(ws, "")
        fields = [F.size(ws).cast("long").alias("n_words"), F.length(joined).cast("long").alias("word_chars"), bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"), repeated_words(ws).alias("n_repeat_words")]
        count = lambda found: F.transform(F.array_distinct(found), lambda w: F.struct(w.alias("w"), (F.size(found) - F.size(F.array_remove(found, w))).alias("c")))
        return F.struct(*fields, bind(joined, classes).alias("classes"), bind(found, count).alias("found"))

    def by_classes(f: Column, q: Column) -> Column:
        n, usual = F.get(f["classes"], F.lit(digit)), F.get(q, F.lit(digit))
        own = F.greatest(F.least(n, usual * f["word_chars"]), n - free_digits)
        share = lambda own: F.transform(f["classes"], lambda c, i: F.when(i == digit, own).otherwise(c) / F.greatest(F.lit(1), f["word_chars"] - n + own))
        return bind(bind(own, share), lambda p: F.sqrt(jsd(p, q)))

    def by_words(f: Column, r: Column) -> Column:
        # Words that the text lacks add their share each; only those that it has need a term of their own.
        n = F.greatest(F.lit(1), f["n_words"])
        part = lambda a, b: a * F.log2(2 * a / (a + b))
        start = F.struct(F.lit(0.0).alias("terms"), F.lit(0.0).alias("own"), F.lit(0.0).alias("ref"))

        def term(s: Column, x: Column) -> Column:
            p = x["c"] / n
            share = F.get(r["shares"], F.array_position(r["words"], x["w"]).cast("int") - 1)
            return bind(share, lambda q: F.when(q.isNull(), s).otherwise(F.struct((s["terms"] + part(p, q) + part(q, p)).alias("terms"), (s["own"] + p).alias("own"), (s["ref"] + q).alias("ref"))))

        def total(s: Column) -> Column:
            other = F.greatest(F.lit(0.0), 1 - s["own"])
            last = F.when(other > 0, part(other, r["rest"])).otherwise(0.0) + F.when(r["rest"] > 0, part(r["rest"], other)).otherwise(0.0)
            return (s["terms"] + (r["total"] - s["ref"]) + last) / 2

        return bind(F.aggregate(f["found"], start, term), lambda s: F.sqrt(F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), total(s)) - r["noise"] / n)))

    def measured(f: Column) -> Column:
        return F.struct(f.alias("f"), least(refs, lambda r: by_classes(f, r["classes"])).alias("c"), least([r for r in refs if r.words], lambda r: by_words(f, r)).alias("w"))

    known = among(F.col(lang), [r.lang for r in refs])

    def verdict(m: Column) -> Column:
        f = m["f"]
        failed = base_failed(f["n_words"], f["n_repeat_words"])
        diverges = ((f["word_chars"] >= min_chars) & (m["c"] > max_class)) | ((f["n_words"] >= min_words) & (m["w"] > max_word))
        counts = [f[c].alias(c) for c in ("n_words", "word_chars")] + [F.get(f["classes"], F.lit(CLASSES.index("symbols"))).alias("n_symbols")] + [f[c].alias(c) for c in ("n_dup_lines", "n_repeat_words")]
        return F.struct(*counts, failed.alias("base_failed"), (~failed & ~(known & F.coalesce(diverges, F.lit(False)))).alias("kept"), m["c"].alias("class_distance"), m["w"].alias("word_distance"))

    return bind(bind(bind(words(F.col(text)), counted), measured), verdict)


def verdicts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", reference: dict | None = None, **limits) -> DataFrame:
    """doc_id, base counts, base_failed, kept and distances of every document."""
    refs = references(docs, text=text, lang=lang, **(reference or {}))
    return docs.select(F.col(doc_id).alias("doc_id"), judged(refs, text=text, lang=lang, **limits).alias("__v")).select("doc_id", "__v.*")


def passing(docs: DataFrame, *, text: str = "text", lang: str = "lang", reference: dict | None = None, **limits) -> DataFrame:
    """The rows of docs that are kept, all columns."""
    refs = references(docs, text=text, lang=lang, **(reference or {}))
    return docs.where(judged(refs, text=text, lang=lang, **limits)["kept"])
