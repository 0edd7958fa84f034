import hashlib
import html
import io
import random
import re
import wave
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpulse.llm import bpe, components, language_id, media, mixing, ngram_join, pii, quality, training_order, warc, wrapper
from sparkpulse.llm.common import shared_dir
from sparkpulse.llm.feistel import permute, seeds
from sparkpulse.llm.spans import with_offsets

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a b"), (5, "a b"), (6, "Ein Satz, é 日本 😀 it's"), (7, "w " * 9000), (8, "x" * 30000)]


@pytest.fixture
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, a null id, and extra columns with clashing names."""
    rows = [(i, t, None if (i or 0) % 2 else "en", None if (i or 0) % 3 else "s", 0, "r", 5) for i, t in [*ODD, (5, "a b"), (None, "a b")]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, size int")


@pytest.fixture
def empty(odd):
    return odd.where("false")


def test_feistel():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        assert sorted(permute(np.arange(n), n, "k")) == list(range(n))
        both = permute(np.tile(np.arange(n), 2), n, seeds("k", np.repeat([1, 2], n)))
        assert sorted(both[:n]) == sorted(both[n:]) == list(range(n))


def test_bpe_equals_the_library():
    import tiktoken

    c = bpe.Codec(bpe.default_path())
    lib = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(1)
    parts = ["a", "the", "ing", " ", "  ", "\n", "é", "ß", "12", "!!", "日本", "😀", "'s", "\t", "$$", "----", "tion", " ", "\x1c"]
    texts = ["", "a" * 5000, "ab" * 4000, "=-" * 3000, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000))]
    for t in texts:
        ids = c.encode(t)
        assert ids.tolist() == lib.encode_ordinary(t), t[:50]
        assert c.decode(ids) == t.encode()


def test_op9_edges(odd, empty):
    rows = bpe.digests(odd).collect()
    assert len(rows) == 10 and all(r.ok for r in rows)
    assert all(r.n_tokens == 0 and r.ids_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if r.doc_id in (1, 2))
    assert bpe.digests(empty).count() == 0


def test_op1(odd, empty):
    for r in media.fingerprint_column(media.wav_column(odd)).collect():
        t = dict(ODD).get(r.doc_id, "a b") or ""
        p = t.encode()
        p += bytes(-len(p) % 64 or (0 if p else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        w = media.to_wav(p)
        assert r.media_sha256 == hashlib.sha256(w).hexdigest() and wave.open(io.BytesIO(w)).readframes(10**6) == p
        if len(p) < 2000:
            assert list(r.fingerprint) == pairs_by_force(p)
        assert list(r.fingerprint) == sorted(r.fingerprint) and r.n_pairs == len(r.fingerprint)
    assert media.fingerprint_column(media.wav_column(empty)).count() == 0


def pairs_by_force(payload):
    """Frames of 256 samples every 128, the strongest bin of each band by the transform's definition."""
    import cmath

    x = list(payload)
    frames = 1 + max(0, -(-(len(x) - 256) // 128))
    x += [128] * (256 + (frames - 1) * 128 - len(x))
    window = np.hanning(256)
    best = []
    for f in range(frames):
        y = np.array(x[f * 128 : f * 128 + 256], float)
        y = (y - y.mean()) * window
        m = [abs(sum(v * cmath.exp(-2j * cmath.pi * k * i / 256) for i, v in enumerate(y))) ** 2 for k in range(129)]
        best.append([lo + int(np.argmax(m[lo:hi])) if max(m[lo:hi]) > 1e-3 else 0 for lo, hi in media.BANDS])
    return sorted(f << 32 | band << 24 | best[f][band] << 16 | best[f + d][band] << 8 | d for d in (1, 2) for f in range(frames - d) for band in range(4) if best[f][band] and best[f + d][band])


def test_op2(spark):
    big = "é" * 600
    rows = [(9, big), (7, big), (9, big), (5, "short"), (4, "short"), (3, None), (2, ""), (1, "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\n"), (None, "n")]
    pages = spark.createDataFrame([(i, f"http://h/{i} x\r\n", h) for i, h in rows], "page_id long, url string, html string")
    path = shared_dir(spark, "t")
    warc.write(pages, path)
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.captures(spark, path).collect()), key=str)
    want = sorted(((i or 0, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if i == 7 else "response", 9 if i == 7 else None) for i, h in rows), key=str)
    assert got == want
    nested = warc.assemble(warc.read(spark, path, payloads=True)).collect()
    assert len(nested) == 9 and all(r.request and r.metadata for r in nested)
    path = shared_dir(spark, "t")
    warc.write(pages.where("false"), path)
    assert warc.captures(spark, path).count() == 0


def test_op3(spark, odd, empty):
    rows = training_order.order(odd, length=128, per_shard=50).collect()
    size = sum(len((dict(ODD).get(r.doc_id, "a b") or "").encode()) + 1 for r in odd.collect())
    n = -(-size // 128)
    assert sorted(r.slot for r in rows) == list(range(n)) and sum(r.n_tokens for r in rows) == size and all(r.intact for r in rows)
    assert all(r.slot == permute(np.array([r.sequence]), n, "epoch-0")[0] and r.offset == r.slot % 50 * (24 + 128) for r in rows)
    assert training_order.order(empty).count() == 0
    # the tokens in sequence order are the texts, whole, however the rows are dealt
    want = sorted((dict(ODD).get(r.doc_id, "a b") or "").encode() for r in odd.collect())
    for d in (odd, odd.repartition(5, "text").distinct().unionByName(odd.where("doc_id = 5").limit(1))):
        path = shared_dir(spark, "t")
        training_order.write(d, path, key="k", length=100, per_shard=7).count()
        got = sorted(training_order.read(spark, path, length=100, per_shard=7).collect(), key=lambda r: r.sequence)
        stream = b"".join(r.tokens for r in got)
        assert sorted(stream.split(b"\xff")[:-1]) == want
    assert [r.slot for r in sorted(training_order.read(spark, path, length=100, per_shard=7, start=30).collect())] == list(range(30, len(got)))


def test_op3_places_token_ids(spark, odd):
    ids = bpe.encode_column(odd.select("doc_id", "text"), dtype="<u2")
    path = shared_dir(spark, "t")
    training_order.write(ids, path, key="k", ids="token_ids", width=2, end=50256, pad=50256, length=64, per_shard=9).count()
    got = sorted(training_order.read(spark, path, length=64, width=2, per_shard=9).collect(), key=lambda r: r.sequence)
    stream = np.frombuffer(b"".join(r.tokens for r in got), "<u2")
    c = bpe.Codec(bpe.default_path())
    docs = [c.decode(x[: -1]).decode() for x in np.split(stream, np.flatnonzero(stream == 50256) + 1)[:-1]]
    assert sorted(docs) == sorted(r.text or "" for r in odd.collect())


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(g)
    cov = {k for i, x in enumerate(g) if c[x] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text or ""), len(lines) - len(set(lines)), len(cov)


def test_op4(spark, odd, empty):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefg") + rng.choice(["", "\n", "#"]) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    texts = dict(rows)
    for r in quality.verdicts(docs).collect():
        b = base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0]) and not (r.base_failed and r.kept)
    assert quality.verdicts(odd).count() == 10 and quality.verdicts(empty).count() == 0
    prose, junk = english(rng), None
    rows = [(i, prose(120), "en") for i in range(60)]
    # other letters' classes, none of the common words
    salad = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(300))
    junk = " ".join(w + "###$$$" for w in prose(200).split())
    docs = spark.createDataFrame([*rows, (98, salad, "en"), (99, junk, "en"), (100, salad, "xx")], "doc_id long, text string, lang string")
    refs = quality.references(docs)
    assert [r.lang for r in refs] == ["en"]
    for r in quality.verdicts(docs).collect():
        text = {k: t for k, t, _ in rows}.get(r.doc_id, junk if r.doc_id == 99 else salad)
        c, w = distances_by_force(text, refs[0])
        assert abs(r.class_distance - c) < 1e-9 and abs(r.word_distance - w) < 1e-9
        # no reference for xx: kept
        assert r.kept == (r.doc_id not in (98, 99))
        if r.doc_id == 98:
            assert r.class_distance < 0.2 and r.word_distance > 0.23
    assert {r.doc_id for r in quality.passing(docs).collect()} == {*range(60), 100} and quality.passing(odd).columns == odd.columns


def english(rng):
    """Prose in which common words have the share they have in English."""
    rare = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    common = "the of and to a in is that it for on with as was by".split()
    return lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(n))


def distances_by_force(text, ref):
    import math
    import unicodedata

    def jsd(p, q):
        part = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0.0
        return max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, q, strict=True)) / 2)

    w = text.split()
    chars = [c for x in w for c in x]
    kind = lambda c: "digits" if c in quality.DIGITS else "symbols" if c in quality.SYMBOLS else "upper" if unicodedata.category(c) == "Lu" else "letters" if unicodedata.category(c)[0] == "L" else "rest"
    n = Counter(map(kind, chars))
    digit = quality.CLASSES.index("digits")
    own = max(min(n["digits"], ref.classes[digit] * len(chars)), n["digits"] - 60)
    total = max(1, len(chars) - n["digits"] + own)
    c = math.sqrt(jsd([(own if k == "digits" else n[k]) / total for k in quality.CLASSES], ref.classes))
    f = Counter(x.lower() for x in w)
    p = [f[x] / len(w) for x in ref.words]
    d = jsd([*p, max(0.0, 1 - sum(p))], [*ref.shares, max(0.0, 1 - sum(ref.shares))])
    return c, math.sqrt(max(0.0, d - len(ref.words) / (8 * math.log(2)) / len(w)))


def test_op4_keeps_short_texts_with_numbers(spark):
    rng = random.Random(5)
    one = english(rng)
    prose = [one(60) for _ in range(40)]
    numbers = f"{prose[0]} 4111111111111111 +1 (826) 555-4081 190.137.223.204"
    digits = " ".join(str(rng.randint(1000, 99999)) for _ in range(70))
    rows = [*enumerate(prose), (98, numbers), (99, digits)]
    d = {r.doc_id: r for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))).collect()}
    assert d[0].kept and d[98].kept and d[98].word_chars >= 200 and not d[99].kept


def test_op4_holds_references_of_every_label(spark):
    rng = random.Random(7)
    # 40 labels, one of them null; the last ones have the fewest words
    labels = [None, *(f"l{i:02d}" for i in range(39))]
    rows = [(f"{label}-{k}", english(rng)(500 + 2 * (40 - i)), label) for i, label in enumerate(labels) for k in range(4)]
    salad = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(300))
    bad = [(f"bad {label}", salad, label) for label in ("l00", "l38", None)]
    docs = spark.createDataFrame([*rows, *bad, ("other", salad, "xx")], "doc_id string, text string, lang string")
    refs = quality.references(docs)
    assert {r.lang for r in refs} == set(labels)
    got = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    assert {k for k, r in got.items() if not r.kept} == {k for k, _, _ in bad}
    for k, text, _ in [*rows[::16], *bad]:
        c, w = map(min, zip(*(distances_by_force(text, r) for r in refs), strict=True))
        assert abs(got[k].class_distance - c) < 1e-9 and abs(got[k].word_distance - w) < 1e-9


def test_op4_references_write_nothing(spark, monkeypatch):
    def refuse(*a):
        raise AssertionError("a folder was asked for")

    monkeypatch.setattr("sparkpulse.llm.common.shared_dir", refuse)
    rng = random.Random(11)
    docs = spark.createDataFrame([(i, english(rng)(600), lang) for i, lang in enumerate(["en"] * 4 + [None] * 5 + ["few"])], "doc_id long, text string, lang string")
    assert [(r.lang, len(r.words)) for r in quality.references(docs)] == [(None, 30), ("en", 30)]


def test_op5(spark):
    def page(i, paras, title):
        ps = "".join(f"<p>{p}" for p in paras)
        return f'<html><head><title>{title}</title><style>p{{}}</style><script>var x="</p>";</script></head><body><nav><a href=x>Menu {i}</a></nav><div class="cookie-notice">We use cookies</div><div class=box><p>Constant banner text</p></div><article><h1>{title}</h1>{ps}</article><div id="comments"><p>I liked it {i}</p></div><form><input name=q>Go</form><footer>&copy; {i}</footer>'

    pages = [page(i, [f"First &amp; <b>bold</b>{i}\n  para&nbsp;{i}", f"Second<br>line {i}"], f"T {i}") for i in range(6)]
    rows = [(i, "http://h.example/a", p) for i, p in enumerate(pages)] + [(10, None, None), (11, "http://h.example/b", ""), (12, "http://o/", "plain <b>text"), (12, "http://o/", "plain <b>text")]
    got = {r.page_id: r for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i].text == f"T {i}\nFirst & bold{i} para {i}\nSecond line {i}" and got[i].n_chars == len(got[i].text)
    assert got[10].text == got[11].text == "" and got[12].text == "plain text"
    divs = [f"<body><div><p>Constant banner</p><p>Body {html.escape('<' + str(i) * 30)}</p></div>" for i in range(6)]
    assert wrapper.extract(divs[0], divs[1:4]) == "Body <" + "0" * 30


def test_op5_class_noise_is_a_hint():
    p = "Words of the story that go on for a while. " * 4
    get = lambda body: wrapper.extract(f"<html><body>{body}</body></html>", [])
    assert get(f'<div class="layout has-sidebar"><article><p>{p}</p></article><div class="sidebar">links</div></div>') == p.strip()
    assert get(f'<div class="no-comments"><p>{p}</p></div><div class="comments">me too</div>') == p.strip()
    assert get(f'<article><div class="entry-header"><h1>Title</h1></div><p>{p}</p><div class="share">tell</div></article>') == f"Title\n{p.strip()}"


def test_op5_deep_and_long(spark):
    deep = "<div>" * 5000 + "<p>core</p>" + "</div>" * 4990
    other = "<div><span>x</span>" * 3000 + "<p>core two</p>"
    rows = [(i, "http://h/", x, "clash") for i, x in enumerate([deep, other, deep.replace("core", "more"), "<p>" + "word " * 200000, None])]
    got = {r.page_id: r for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert got[0].text == "core" and got[3].text.count("word") == 200000 and got[4].n_chars == 0 and len(got) == 5


def weight_by_force(a, b):
    if a.tag != b.tag or a.noise != b.noise:
        return 0

    def best(x, y):
        return max(best(x[1:], y), best(x, y[1:]), weight_by_force(x[0], y[0]) + best(x[1:], y[1:])) if x and y else 0

    return 1 + best(a.kids, b.kids)


def test_stm_weight():
    rng = random.Random(4)
    make = lambda d: f"<{(t := rng.choice(['div', 'span', 'b']))}>" + "".join(make(d - 1) for _ in range(rng.randint(0, 3) if d else 0)) + f"</{t}>"
    for _ in range(60):
        m, a, b = wrapper.Matcher(), wrapper.tree(make(3)), wrapper.tree(make(3))
        wrapper.shapes(a, m.shapes)
        wrapper.shapes(b, m.shapes)
        assert m.weight(a, b) == weight_by_force(a, b)
    m = wrapper.Matcher()
    a, b = wrapper.tree("<ul><li>x<li>y</ul>"), wrapper.tree("<ul><li>x<li>y<li>z</ul>")
    wrapper.shapes(a, m.shapes)
    wrapper.shapes(b, m.shapes)
    assert m.weight(a, b) == 6 and m.weight(b, b) == b.size


def phrases(text: bytes, ref: bytes) -> int:
    text, ref, n = text.lower(), ref.lower(), 0
    for lo in range(0, len(text), language_id.SEGMENT):
        seg, at = text[lo : lo + language_id.SEGMENT], 0
        while at < len(seg):
            size = 0
            while at + size < len(seg) and seg[at : at + size + 1] in ref:
                size += 1
            at += max(1, size)
            n += 1
    return n


def test_op6(spark, odd, empty):
    model = language_id.Model({"de": b"der die das und ist nicht ein eine haus", "en": b"the and is not a an house of to"})
    text = b"The house is not an Apfel. " * 30
    counts = model.phrases([text, b"", b"the"])
    for k, ref in enumerate((b"der die das und ist nicht ein eine haus", b"the and is not a an house of to")):
        assert (counts[0, k], counts[1, k], counts[2, k]) == (phrases(text, ref), 0, phrases(b"the", ref))
    got = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.predict(empty, model).count() == 0
    none = language_id.Model({})
    assert {r.lang_pred for r in language_id.predict(odd, none).collect()} == {"und"}
    assert set(language_id.sample(odd)) == {"en"} and language_id.sample(empty) == {}
    long = spark.createDataFrame([(None, "wort " * 4000, "de"), (None, "kurz", "nl"), (1, "wort " * 4000, "de")], "doc_id long, text string, lang string")
    assert set(language_id.sample(long)) == {"de", "nl"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")), F.lit(5)) == 0
    p = language_id.predict(docs.where(held), language_id.Model(language_id.sample(docs.where(~held))), keep=("doc_id", "lang")).toPandas()
    assert (p.lang == p.lang_pred).mean() > 0.97


def components_by_force(texts):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, up = [grams(t) for t in texts], list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def test_op7(spark, empty, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 5, 6, 8, 9, 12, 20, 40, 80]))] for _ in range(25)]
    shared = [rng.choice(words) for _ in range(60)]
    texts = [None, "", " \n", "a b", "A  B", "x " * 5000]
    for _ in range(300):
        b = list(rng.choice(bases))
        for _ in range(rng.randint(0, 2)):
            b[rng.randrange(len(b))] = rng.choice(words)
        texts.append(" ".join(b + (shared[: rng.choice([10, 30, 60])] if rng.random() < 0.4 else [])))
    sizes, roots = components_by_force(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("row", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs).collect()}
    assert got == {i: (sizes[i], roots[i]) for i in range(len(texts))}
    assert ngram_join.link(empty).count() == 0
    # dealt anew, with repeated rows and null ids, and no broadcast
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", 8)
    more = docs.unionByName(docs.where("doc_id % 7 = 0")).unionByName(docs.where("doc_id = 20").withColumn("doc_id", F.lit(None).cast("long"))).repartition(9, "doc_id")
    rows = ngram_join.link(more).collect()
    assert len(rows) == more.count() and all((r.n_shingles, r.component_id) == (sizes[r.doc_id], roots[r.doc_id]) for r in rows if r.doc_id is not None)
    assert {r.component_id for r in rows if r.doc_id is None} == {roots[20]}
    want = Counter({i: 1 for i in range(len(texts)) if sizes[i] and roots[i] == i}) + Counter({i: 1 + (i % 7 == 0) for i in range(len(texts)) if not sizes[i]})
    kept = ngram_join.representatives(more)
    assert Counter(r.doc_id for r in kept.collect()) == want and kept.columns == docs.columns
    # of two components with one id, and two with none, each keeps a row
    odd_ids = spark.createDataFrame([(1, "a b c d e f"), (1, "u v w x y z"), (None, "k l m n o p"), (None, "q r s t u v"), (None, "q r s t u v")], "doc_id long, text string")
    assert sorted(r.text for r in ngram_join.representatives(odd_ids).collect()) == ["a b c d e f", "k l m n o p", "q r s t u v", "u v w x y z"]


def test_op7_crowds(spark):
    """Many heavily edited copies of one text, which rarely link, and unlike texts around one passage."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    base, passage = [rng.choice(words) for _ in range(120)], [rng.choice(words) for _ in range(60)]
    texts = []
    for _ in range(160):
        b = list(base)
        for _ in range(rng.randint(0, 9)):
            b[rng.randrange(len(b))] = rng.choice(words)
        texts.append(" ".join(b))
        texts.append(" ".join([*(rng.choice(words) for _ in range(rng.randint(1, 30))), *passage]))
    sizes, roots = components_by_force(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: (sizes[i], roots[i]) for i in range(len(texts))} and len(set(roots)) > 40


def test_components_in_chunks(spark, monkeypatch):
    """Several tasks and rounds: a long path, a star, a clique, random edges, loops and repeats."""
    monkeypatch.setattr(components, "CHUNK", 12)
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(30)] + [(a, b) for a in range(200, 207) for b in range(200, a)]
    edges += [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(45)] + [(400, 400), (59, 60)]
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    rng.shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in up.items() if x in got} and set(up) - set(got) <= {x for a, b in edges if a == b for x in (a,)}
    assert components.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_neighbourhoods_meet():
    """Any pair at the threshold meets at threshold 1, or by prefix tokens."""
    rng, sch = np.random.default_rng(7), ngram_join.Schemes()
    for n in [4, 5, 6, 7, 9, 12, 20, 50, 200, 1000]:
        for _ in range(30):
            s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            k = (len(s) - -(-8 * len(s) // 10)) // 2
            t = np.unique(np.concatenate([s[k:], rng.integers(0, 2**63, k).astype(np.uint64)]))
            if not sch.linked(s, t) or not k:
                continue
            ks = set(sch.of(len(s))) & set(sch.of(len(t)))
            assert any(len(np.intersect1d(ngram_join.neighbourhoods(s, j, sch), ngram_join.neighbourhoods(t, j, sch))) for j in ks)


def luhn(x):
    d = [int(c) for c in x][::-1]
    return sum(d[0::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])


def test_op8(spark, odd, empty):
    text = "card 4111 1111 1111 1111 bad 4111111111111112 on 2024-02-29, 12/31/1999 31/12/1999 01.02.2003 no 2024-02-30 ssn 123-45-6789 ip 97.51.17.173. not 300.1.1.1 tel +1 (017) 555-7713 m a.b@c.example.com end"
    x = pii.pseudonymise(spark.createDataFrame([(1, text), (2, "same 2024-02-29"), (3, None)], "doc_id long, text string"), count="n").collect()
    got = {r.doc_id: r.text for r in x}
    for value in ("4111 1111 1111 1111", "2024-02-29", "12/31/1999", "31/12/1999", "01.02.2003", "123-45-6789", "97.51.17.173", "+1 (017) 555-7713", "a.b@c.example.com"):
        assert value not in got[1]
    assert all(v in got[1] for v in ("4111111111111112", "2024-02-30", "300.1.1.1")) and got[3] is None
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", got[1])[0]
    assert luhn(card.replace(" ", "")) % 10 == 0
    assert got[2].split()[1] in got[1] and re.sub(r"\d+|\S+@\S+", "0", got[1]) == re.sub(r"\d+|\S+@\S+", "0", text)
    rows = pii.pseudonymise(odd).collect()
    assert [(r.doc_id, r.text, r.n_chars, r.row) for r in rows] == [(r.doc_id, r.text, r.n_chars, r.row) for r in odd.collect()]
    assert pii.pseudonymise(empty).count() == 0
    n = 189 * 773
    d = spark.range(0, n, 1, 4).select(pii.feistel(F.col("id"), F.lit(189), F.lit(773), "k", F.lit("t")).alias("y")).where("y >= 0").limit(5000)
    assert d.distinct().count() == 5000 and d.agg(F.max("y")).first()[0] < n


def test_op8_adjacent_values(spark):
    lone = {1: "+1 (826) 555-4081", 2: "190.137.223.204", 3: "4111111111111111", 4: "2024-01-15", 5: "378282246310005", 6: "4111 1111 1111 1111", 7: "+44 20 7946 0958", 8: "123-45-6789"}
    pairs = [(1, "{} {}", 2), (1, "{} {}", 4), (1, "{} 190 men, {}", 3), (3, "{} 123 {}", 2), (3, "123 {} {}", 4), (3, "{} {}", 5), (6, "2024 {} 987 {}", 3), (5, "{} {}", 2), (4, "{}T10:00 and {}T10:00:00Z", 4), (7, "{} {}", 2), (3, "{} {}", 8), (7, "{} {}", 4)]
    rows = [*lone.items(), *((100 + i, f.format(lone[a], lone[b])) for i, (a, f, b) in enumerate(pairs)), (900, "1 " * 9000 + lone[3])]
    x = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), count="n").collect()}
    assert all(x[k].n == 1 and x[k].text != v for k, v in lone.items())
    for i, (a, f, b) in enumerate(pairs):
        assert (x[100 + i].text, x[100 + i].n) == (f.format(x[a].text, x[b].text), 2)
    assert x[1].text.startswith("+1 (") and x[7].text.startswith("+44 ") and x[900].text == "1 " * 9000 + x[3].text


def water(sizes):
    """Targets by repeated sharing out."""
    out, free = {}, {k: i % 3 + 1 for i, k in enumerate(sorted(sizes))}
    left = sum(sizes.values())
    while True:
        share = left / sum(free.values()) if free else 0
        over = [k for k in free if free[k] * share > 3 * sizes[k]]
        if not over:
            return out | {k: free[k] * share for k in free}
        for k in over:
            out[k] = 3 * sizes[k]
            left -= out[k]
            del free[k]


def test_op10(spark, odd, empty):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 400))), rng.choice("aaaaabcdef")) for i in range(600)] + [(1000, "tiny " * 50, "b0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, block=32).toPandas()
    again = mixing.mix(docs, block=32).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = water(sizes)
    m = got.merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    assert (m.taken <= 3 * m["size"]).all()
    for s, g in m.groupby("source"):
        assert abs(g.target.iloc[0] - want[s]) < 1e-6 * want[s] + 1e-6 and abs(g.taken.sum() - want[s]) <= 40
    texts = mixing.mixed_documents(docs, block=32).select("doc_id", F.size(mixing.words(F.col("text"))).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n")).toPandas()
    assert dict(zip(texts.doc_id, texts.n, strict=True)) == {r.doc_id: r.taken for r in got.itertuples() if r.taken}
    assert mixing.mix(odd).count() == 10 and mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    # however the rows are dealt, and with repeated rows
    again = mixing.mix(docs.repartition(13, "doc_id"), block=32).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    twice = docs.unionByName(docs.where("doc_id < 200")).repartition(7, "text")
    m = mixing.mix(twice, block=32).toPandas()
    assert len(m) == 801 and (m.taken <= 3 * m["size"]).all()
    texts = mixing.mixed_documents(twice, block=32).select("doc_id", F.size(mixing.words(F.col("text"))).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n")).toPandas()
    assert dict(zip(texts.doc_id, texts.n, strict=True)) == {k: v for k, v in m.groupby("doc_id").taken.sum().items() if v}


def test_offsets(spark):
    d = spark.range(500).select((F.col("id") % 2).alias("g"), "id", (F.col("id") % 7).alias("n"))
    rows = with_offsets(d, "n", by=["g"], order=["id"]).collect()
    for g in (0, 1):
        r = sorted((x.offset, x.n) for x in rows if x.g == g)
        assert sum(n for _, n in r) == max(o + n for o, n in r) and len({o for o, n in r if n}) == len([1 for _, n in r if n])


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r.doc_id for r in quality.verdicts(docs).where("kept").collect()}
    assert len(kept) > 100
    d = corpus_pipeline.quality_rules(spark, docs, "")
    assert {r.doc_id for r in d.collect()} == kept and d.columns == docs.columns
    rows = sorted((r.doc_id, r.text) for r in d.collect())
    _, roots = components_by_force([t for _, t in rows])
    e = corpus_pipeline.near_duplicates(spark, d, "")
    assert {r.doc_id for r in e.collect()} == {rows[i][0] for i in set(roots)} and e.columns == docs.columns
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "n_tokens", "token_ids"} <= set(out.columns)
