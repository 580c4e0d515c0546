"""The training-data operators against brute force on small fixtures, and on the odd rows every table may hold."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lattix.llm import decontam, gru, hnsw, html_extract, langid, neardup, pieces, pii, quality, simhash, suffix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa la mu nu xi omikron pi rho sigma tau".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", ".", "en", "ing"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    out = [prose(rng, rng.choice([3, 30, 120, 300])) for _ in range(60)]
    out += [out[5]] * 3 + [out[7].replace(" ", " \n", 3), out[9] + " mu", " ".join(out[11].split()[:90] + out[13].split()[:90])]
    return [*out, "", "   \n\t ", "one", "One two", "ÉTÉ İstanbul ẞ", "x" * 5000, ("word " * 3000).strip()]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], "s", len(t)) for i, t in enumerate(texts)] + [(900, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark, texts):
    """Null ids, repeated rows, and extra columns whose names clash with those used inside."""
    rows = [(None, "no id here", "en"), (1, texts[0], "en"), (1, texts[0], "en"), (2, None, None), (3, "", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in ("key", "n", "w", "id", "score", "spans", "ids", "fp", "doc", "row", "token", "p", "stats", "y", "quality_score"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def items(spark, texts):
    rows = [(1, " ".join(texts[0].split()[5:40])), (2, texts[11][:200]), (3, "One two"), (4, ""), (5, None), (None, " ".join(texts[1].split()[:20])), (6, "one"), (10, texts[0])]
    return spark.createDataFrame(rows, "item_id long, text string")


# 9 -----------------------------------------------------------------------------------------------------------------


def words9(t):
    lower = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute9(docs, items):
    wins = []
    for i, t in items:
        w = words9(t)
        k = min(len(w), 10)
        wins += [(i, k, tuple(w[a : a + k])) for a in range(len(w) - k + 1)] if k else []
    out = {}
    for d, t in docs:
        w, hit, found = words9(t), set(), set()
        for i, k, win in wins:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) == win:
                    hit.update(range(a, a + k))
                    if i is not None:
                        found.add(str(i))
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_decontaminate(docs, items, broadcast_rows):
    want = brute9([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    rows = decontam.decontaminate(docs, items, broadcast_rows=broadcast_rows).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in rows} == want
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in rows)


def test_decontaminate_long_text(spark, texts):
    rng = random.Random(8)
    body = prose(rng, 9000).split()
    item = body[4090:4102]
    df = spark.createDataFrame([(1, "... " + " ".join(body))], "doc_id long, text string")
    got = decontam.decontaminate(df, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).first()
    want = brute9([(1, " ".join(body))], [(7, " ".join(item))])[1]
    assert (got["n_words"], got["n_hit"]) == want[:2] and got["spans"][0]["start"] == 4090


def test_decontaminate_odd(odd, none, items, spark):
    assert decontam.decontaminate(none, items).count() == 0
    assert all(r["n_hit"] == 0 for r in decontam.decontaminate(odd, items.limit(0)).collect())
    got = {r["doc_id"]: r["n_words"] for r in decontam.decontaminate(odd, items).collect()}
    assert got[None] == 3 and got[2] == 0 and len(got) == 4


# 5 -----------------------------------------------------------------------------------------------------------------


def brute_fp(t, k=3):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    rows = docs.collect()
    fp = {r["doc_id"]: brute_fp(r["text"]) for r in rows}
    comp = {d: d for d in fp}
    changed = True
    while changed:
        changed = False
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 2 and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.components(docs).collect()}
    assert got == {d: (fp[d], comp[d]) for d in fp}


@pytest.mark.parametrize("limit", [4096, 2, 40])
def test_gray_index_dense_cluster(spark, limit):
    """Fingerprints within few bits of a centre force the second and third dealing when the limit is small."""
    rng = random.Random(6)
    codes = {rng.getrandbits(64) for _ in range(40)}
    for centre in list(codes)[:3]:
        codes |= {centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 5))) for _ in range(120)}
    codes = sorted(c & ((1 << 64) - 1) for c in codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    i, j = (np.array(v) for v in zip(*[(a, b) for a in range(len(codes)) for b in range(a + 1, len(codes)) if (codes[a] ^ codes[b]).bit_count() <= 2]))
    want = simhash.forest([(i, j)], len(codes))
    place = {c: k for k, c in enumerate(signed)}
    e = simhash.links(spark.createDataFrame([(c,) for c in signed], "fp long"), limit=limit).collect()
    assert all((codes[place[r["src"]]] ^ codes[place[r["dst"]]]) >= 0 for r in e)
    got = simhash.forest([(np.array([place[r["src"]] for r in e]), np.array([place[r["dst"]] for r in e]))], len(codes))
    assert (got == want).all()


def test_simhash_odd(odd, none):
    assert simhash.components(none).count() == 0
    got = simhash.components(odd).collect()
    assert len(got) == 5 and {r["component_id"] for r in got if r["doc_id"] in (2, 3)} == {2}


# 8 -----------------------------------------------------------------------------------------------------------------


def test_repeated_passages(docs):
    w = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    first, multi = {}, set()
    for d, x in w.items():
        for a in range(len(x) - 49):
            if first.setdefault(tuple(x[a : a + 50]), d) != d:
                multi.add(tuple(x[a : a + 50]))
    want = {}
    for d, x in w.items():
        c = {k for a in range(len(x) - 49) if tuple(x[a : a + 50]) in multi for k in range(a, a + 50)}
        if c:
            want[d] = c
    got = {r["doc_id"]: {k for s in r["spans"] for k in range(s["start"], s["end"])} for r in suffix.repeated(docs).collect()}
    assert got == want and want


def test_neighbours_in_suffix_order():
    """What alike() leaves, whatever the batches: runs of several documents, and those at the ends."""
    rng = random.Random(3)
    for _ in range(200):
        rows = sorted((rng.randrange(8), rng.randrange(3), rng.randrange(4), k) for k in range(rng.randrange(1, 40)))
        cols = {"doc": [r[2] for r in rows], "p": [r[3] for r in rows], "first": [0] * len(rows), "last": [0] * len(rows), "hp": [r[0] for r in rows]}
        t, size = pa.table(cols), rng.randrange(1, 12)
        got = [p for b in suffix.alike(iter(t.to_batches(max_chunksize=size))) for p in b.column("p").to_pylist()]
        docs = {h: {r[2] for r in rows if r[0] == h} for h, *_ in rows}
        want = [r[3] for r in rows if len(docs[r[0]]) > 1 or r[0] == rows[0][0] or r[0] == rows[-1][0]]
        sure = [r[3] for r in rows if len(docs[r[0]]) > 1]
        assert set(sure) <= set(got) <= set(want) and got == [p for p in want if p in set(got)]
    assert list(suffix.alike(iter([]))) == []


def test_repeated_odd(odd, none):
    assert suffix.repeated(none).count() == 0
    assert suffix.repeated(odd).count() == 0


# 3 -----------------------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_pii_emails_match_the_pattern():
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice("ab.@-_ 1%") for _ in range(rng.randrange(40)))
        assert [(a, b) for k, a, b, _ in pii.find(t) if k == "email"] == [m.span() for m in EMAIL.finditer(t)], t


def test_pii_kinds():
    t = "mail a.b@c.de, card 4111 1111 1111 1111, bad 4111111111111112, ip 10.0.0.256 10.0.0.255 1.2.3.4.5.6.7.8 call +1 (555) 010-9999 +12 iban GB82 WEST 1234 5698 7654 32 ssn 219-09-9999"
    got = [(k, t[a:b]) for k, a, b, _ in pii.find(t)]
    assert got == [("email", "a.b@c.de"), ("ip", "10.0.0.255"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 010-9999"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "219-09-9999")]
    assert pii.redact("x a@b.c y", pii.find("x a@b.c y")) == "x [EMAIL] y"


def test_pii_is_linear():
    assert pii.find("a" * 300_000 + "@" + "b" * 10) == []
    assert [k for k, *_ in pii.find("@" * 100_000 + "é a@b.cc")] == ["email"]


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _brute_spans(t: str) -> list[tuple[str, int, int]]:
    """The base kinds, straight from their patterns and rules."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if max(map(int, m[0].split("."))) <= 255:
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in _digits(m[0])]
        if 13 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(_digits(m[0])) <= 15]


def test_pii_base_kinds_match_brute_force(spark):
    rng = random.Random(4)
    atoms = ["1", "22", "255", "256", "0003", "4111", "1111", ".", ".", ".", " ", "-", "+", "+1", "(", ")", "a", "@", "b.c", "é", "4111 1111 1111 1111", "٣", "²", "1.2.3.4", "\n"]
    texts = ["".join(rng.choices(atoms, k=rng.randrange(1, 40))) for _ in range(4000)]
    found = 0
    for t in texts:
        want = _brute_spans(t)
        found += len(want)
        assert [s[:3] for s in pii.find(t) if s[0] in pii.BASE] == want, t
    assert found > 1000
    # the query's digest columns, on whole rows
    rows = [*enumerate(texts[:300]), (500, None), (500, ""), (None, "1.2.3.4")]
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).write.parquet(f"{d}/documents.parquet")
        got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.query(spark, d).collect())
    want = Counter()
    for i, t in rows:
        s = _brute_spans(t or "")
        want[(i, *(sum(k == x[0] for x in s) for k in pii.BASE), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest())] += 1
    assert got == want


def test_pii_digit_runs_are_linear():
    import time

    began = time.time()
    assert pii.find("7" * 2_000_000) == [] and len(pii.find("1." * 200_000)) == 50_000
    assert len(pii.find("1.2.3.4 219-09-9999 ssn " * 20_000)) == 40_000
    assert time.time() - began < 20


def test_pii_odd(odd, none, docs):
    assert pii.annotate(none).count() == 0
    assert pii.annotate(odd).count() == 5
    r = pii.annotate(docs, redacted_as="r").where("doc_id = 900").first()
    assert r["spans"] == [] and r["r"] is None


# 4 -----------------------------------------------------------------------------------------------------------------


def test_pieces_scan_equals_whole():
    p = pieces.load(pieces.default_model())
    rng = random.Random(1)
    for _ in range(120):
        t = "".join(rng.choice("the andof in  \n éñ▁😀xyz.,qu") for _ in range(rng.randrange(1, 400)))
        ids = p.encode(t)
        assert p.decode(ids) == t
        cs = pieces.chunks(" " + t, 40, p.longest)
        mats = [p.transfer(s, c) for _, s, c in cs]
        assert all((p.chunk_matrix(s, c) == m).all() for (_, s, c), m in zip(cs, mats))
        if len(mats) > 2:
            a, b, c = mats[:3]
            assert (pieces.combine(pieces.combine(a, b), c) == pieces.combine(a, pieces.combine(b, c))).all()
        st = pieces.border_states(mats)
        got = [x for (_, s, c), i, o in zip(cs, st, st[1:]) for x in p.encode_span(s[c - i : len(s) - o]).tolist()]
        assert p.decode(got) == t and got == ids


def dealt_ids(p, t, chunk):
    cs = pieces.chunks(" " + t, chunk, p.longest)
    st = pieces.border_states([p.chunk_matrix(s, c) for _, s, c in cs])
    return [x for (_, s, c), i, o in zip(cs, st, st[1:]) for x in p.encode_span(s[c - i : len(s) - o]).tolist()]


def test_pieces_ids_do_not_depend_on_chunks():
    """Equal ids for every chunk size, also below the longest piece, with many ties, and in words of 64 characters or more."""
    p = pieces.load(pieces.default_model())
    rng = random.Random(4)
    for t in ("aaaa aaaaaaa  aa", "nananananan", "".join(rng.choice("aan ") for _ in range(60)), prose(rng, 12)):
        ids = p.encode(t)
        assert all(dealt_ids(p, t, chunk) == ids for chunk in range(1, len(t) + 2))
    for _ in range(200):
        t = "".join(rng.choice("esstttaanno  ") for _ in range(rng.randrange(1, 300)))
        assert dealt_ids(p, t, rng.randrange(1, 80)) == p.encode(t)
    for n in (50, 63, 64, 65, 300):
        w = "".join(rng.choice("estan") for _ in range(n))
        assert tuple(p.encode(w)) == p.solve(" " + w) == tuple(dealt_ids(p, w, 17))


def test_pieces_product_is_associative():
    p = pieces.load(pieces.default_model())
    cs = pieces.chunks(" " + "tastenantest" * 30, 23, p.longest)
    mats = [p.transfer(s, c) for _, s, c in cs]
    left = mats[0]
    for m in mats[1:]:
        left = pieces.combine(left, m)
    assert (left[0] == pieces.product(mats)[0]).all()
    assert (left[0] == p.transfer(" " + "tastenantest" * 30, 0)[0])[0].all()


def test_pieces_match_the_library():
    """The library's own unigram search over the same pieces and weights finds no better path."""
    sentencepiece = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    m.ParseFromString(open(pieces.default_model(), "rb").read())
    p = pieces.load(pieces.default_model())
    m.trainer_spec.model_type = 1
    for x in m.pieces:
        if x.piece.replace("▁", " ") in p.weight and x.type == 1:
            x.score = p.weight[x.piece.replace("▁", " ")] / pieces.SCALE
    sp = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    for t in ("The quick brown fox", "zusammengesetzte Wörter und mehr", prose(random.Random(2), 200)):
        assert p.score(p.encode(t)) == pytest.approx(p.score(sp.encode(t)), rel=1e-6)


def test_pieces_giant_and_odd(spark, odd, none, texts):
    rng = random.Random(9)
    big = [(1, prose(rng, 3000)), (1, "y" * 9000), (2, "  ".join(texts[:40])), (3, None), (4, "")]
    df = spark.createDataFrame(big, "doc_id long, text string")
    p = pieces.load(pieces.default_model())
    got = pieces.encode(df, chunk=700, decoded_as="back").collect()
    assert sorted((r["doc_id"], r["back"]) for r in got) == sorted((d, t or "") for d, t in big)
    assert all(r["ids"] == p.encode(r["text"] or "") for r in got)
    assert pieces.decode(pieces.encode(odd)).count() == 5 and pieces.encode(none).count() == 0


# 6, 2 --------------------------------------------------------------------------------------------------------------


def two_langs(spark, n=240):
    rng = random.Random(5)
    syl = {"aa": ["ka", "mo", "ti", "ru"], "bb": ["sch", "ung", "ein", "ver"]}
    rows = []
    for i in range(n):
        lang = ["aa", "bb"][i % 2]
        rows.append((i, " ".join("".join(rng.choice(syl[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(30)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_langid_held_out(spark):
    df = two_langs(spark)
    got = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in got)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_langid_odd(odd, none, docs):
    assert langid.identify(none).count() == 0
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert got[900]["lang_pred"] == "und" and got[900]["score"] == 0 and got[66]["lang_pred"] == "und"
    assert langid.identify(odd).count() == 5


def test_presence_is_whole_text():
    t = "ab " * 600_000 + "qzx"
    assert set(langid.presence("qzx")) - set(langid.presence("ab")) <= set(langid.presence(t))


def test_quality_held_out(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = prose(rng, 60)
        rows.append((i, t.upper().replace(" ", "!! ") if bad else t))
        labels.append((i, 0 if bad else 1))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.classify(d, lab).join(lab, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.97 * len(got)


def test_quality_odd(odd, none, docs, spark):
    lab = spark.createDataFrame([(1, 1), (1, 0), (7, None), (None, 1)], "doc_id long, quality int")
    assert quality.classify(none, lab).count() == 0
    assert all(r["score"] == 0.5 for r in quality.classify(docs, lab.limit(0)).collect())
    assert quality.classify(odd, lab).count() == 5


def test_pool_is_isotonic():
    x, y = quality.pool(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [1, 2.5, 4]


def test_language_needs_a_letter_and_a_fold(spark):
    from lattix.llm import langid as li

    assert li.letters("a²b ½ Ⅷ x1y é") == ["a", "b", "x", "y", "é"]
    rows = [(i, "the cat sat on the mat" if i % 2 else "le chat est sur la table", "en" if i % 2 else "fr") for i in range(60)]
    rows += [(100, "²", "en"), (101, "½ 12", "en"), (102, "Ⅷ", None), (None, "the cat", "en")]
    got = {r["doc_id"]: r for r in li.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [got[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3 and got[None]["held_out"] is False and got[None]["lang_pred"] == "en"
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in range(60))


# 7 -----------------------------------------------------------------------------------------------------------------


def test_knn_recall(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    v = v.astype(np.float32).astype(float)
    got: dict = {}
    for r in hnsw.knn(df, F.col("id") % 20 == 0, shard_rows=400).collect():
        got.setdefault(r["query_id"], []).append(r)
    hit = 0
    for q, rows in got.items():
        s = v @ v[q]
        s[q] = -np.inf
        hit += len({r["vec_id"] for r in rows} & set(np.argsort(-s)[:20].tolist()))
        rows.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, 21)) and all(r["score"] == pytest.approx(s[r["vec_id"]]) for r in rows)
    assert len(got) == 75 and hit >= 0.97 * 1500


def _recall(spark, v: np.ndarray, **how) -> float:
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in hnsw.knn(df, F.col("id") % 20 == 0, **how).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, len(v), 20):
        s = v @ v[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    return hit / (20 * len(range(0, len(v), 20)))


@pytest.mark.parametrize("clumps", [0, 40])
def test_knn_routing_recall(spark, clumps):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(6000, 32))
    if clumps:
        v = v * 0.2 + rng.normal(size=(clumps, 32))[rng.zipf(1.5, 6000) % clumps]
    assert _recall(spark, v / np.linalg.norm(v, axis=1, keepdims=True), shard_rows=500, block=64) >= 0.95


def test_probes_follow_the_structure_of_the_vectors():
    rng = np.random.default_rng(4)
    plain = rng.normal(size=(4000, 32))
    clumped = plain * 0.1 + rng.normal(size=(100, 32))[rng.integers(0, 100, 4000)]
    need = []
    for v in (plain, clumped):
        x = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
        mids = hnsw.centroids(x, 40)
        need.append(hnsw.needed_probes(x, mids, x[:200], 20))
        ranks = np.argsort(hnsw.nearest_cells(x[:200], mids, 40), axis=1)
        top = np.argsort(-(x[:200] @ x.T), axis=1)[:, :20]
        assert (np.take_along_axis(ranks, hnsw.nearest_cells(x, mids, 1)[:, 0][top], 1) < need[-1]).mean() >= 0.97
    assert need[1] <= 6 < need[0] <= 40


def test_graph_is_reachable_in_clumps():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(20, 16))[rng.integers(0, 20, 3000)] + 0.01 * rng.normal(size=(3000, 16))
    x = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    levels = hnsw.build(x)
    assert all(t.shape == (n, hnsw.WIDTH) and t.max() < n for t, n in zip(levels, (len(t) for t in levels)))
    found = hnsw.search(x, levels, x[:300], 256)[0][:, :20]
    want = np.argsort(-(x[:300] @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(found, want)]) >= 0.95


def test_knn_large_group_of_equal_vectors(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(1500, 8)).astype(np.float32).astype(float)
    order = rng.permutation(1500)
    v[order[:700]] = v[order[0]]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(2000, v[order[0]].tolist())] * 2, "vec_id long, embedding array<float>")
    ids, every = np.r_[np.arange(1500), 2000, 2000], np.r_[v, v[order[:1]], v[order[:1]]]
    got = {}
    for r in hnsw.knn(df, F.col("id") % 20 == 0, shard_rows=400, ef=100).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in [int(i) for i in order[:700] if i % 20 == 0]:
        s = np.where(ids == q, -np.inf, every @ v[q])
        assert got[q] == ids[np.lexsort((ids, -s.round(9)))[:20]].tolist()


def test_knn_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (20, [0.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("v", F.lit(1))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in hnsw.knn(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 1), (0, 3, 20), (20, 1, 0), (20, 2, 1), (20, 3, 1)]
    assert hnsw.knn(df.limit(0), F.col("id") % 20 == 0).count() == 0


# 1 -----------------------------------------------------------------------------------------------------------------


def test_html_roles():
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><div class="cookie-notice">We use cookies</div><header>Site</header><nav><a href=x>Home</a></nav>
    <article class="post"><h1>Head &amp; line</h1><p>First <b>bold</b>\n para<br>more.<p>Second&nbsp;one<form>Sign up<input></form><div class="share-buttons">Share</div><!-- no --><ul><li>a<li>b</ul></article>
    <section id="comments"><p>Great post</p></section><aside>Side</aside><footer>&copy; me</footer></body></html>"""
    assert html_extract.main_text(page) == "Head & line\nFirst bold para more.\nSecond one\na\nb"
    assert html_extract.main_text(None) == "" and html_extract.main_text("plain < text") == "plain < text"
    assert html_extract.main_text("<p>cut off <a hre") == "cut off"


def test_html_template(spark):
    rng = random.Random(1)
    body = {i: [prose(rng, 12), prose(rng, 9)] for i in range(14)}
    rows = [(i, "http://h.example/a", f"<div><span>Daily Post</span><div><p>{a}</p><p>{b}</p></div><span>All rights held</span></div>") for i, (a, b) in body.items()]
    rows += [(100, None, None), (101, "not a url", "<p>x</p>"), (102, "http://h.example/a", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit("t"))
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert all(got[i]["text"] == "\n".join(body[i]) and got[i]["n_chars"] == len(got[i]["text"]) for i in body)
    assert got[100]["text"] == "" and got[101]["text"] == "x" and got[102]["text"] == got[0]["text"]
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_keeps_every_article_and_text_after_a_loose_mark():
    assert html_extract.main_text("<article><p>one</p></article><div>x</div><article><p>two two</p></article>") == "one\ntwo two"
    assert html_extract.main_text("<div class=content>a</div><div class=content>b c</div>") == "a\nb c"
    assert html_extract.main_text("<p>if a <b and c then stop") == "if a <b and c then stop"
    assert html_extract.main_text('<p>cut <a href="x y') == "cut"
    assert html_extract.main_text("<p>" + "word " * 400_000 + "</p>") == "word " * 399_999 + "word"


@pytest.mark.parametrize("named", [False, True])
def test_html_slots_without_telling_markup(spark, named):
    """Meaningless class names or none: the slots of the host's template alone tell the article from menu, notice, advert and foot."""
    rng = random.Random(7)
    name = (lambda k: f' class="q{k}x"') if named else (lambda k: "")
    rows, want = [], {}
    for i in range(40):
        notice, ad, foot = (prose(rng, 4) for _ in range(3))
        paras = [prose(rng, rng.randrange(5, 60)) for _ in range(rng.randrange(1, 6))]
        menu = "".join(f"<li><a href=/{w}>{w}</a></li>" for w in prose(rng, 5).split())
        want[i] = "\n".join([f"Head {i} of all", *paras])
        html = f"<html><body><div{name(1)}><ul>{menu}</ul></div><div{name(2)}>{notice}</div><div{name(3)}>{ad}</div>"
        html += f"<div{name(4)}><h1>Head {i} of all</h1>{''.join(f'<p>{x}' for x in paras)}</div><div{name(5)}>Copyright {foot}</div></body></html>"
        rows.append((i, "http://plain.example/x", html))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()} == want


def test_html_spread_text_keeps_all_its_elements():
    """Text in several like elements is the article's in all of them; a small one beside them is not."""
    template = [(1, 0, html_extract.OPEN, 1000), (2, 1, html_extract.OPEN, 480), (3, 1, html_extract.OPEN, 470), (4, 1, html_extract.OPEN, 50), (5, 4, html_extract.TEXT, 0)]
    assert html_extract.region(template) == (frozenset([5]), 1, frozenset([4]))
    assert html_extract.region([]) == (frozenset(), None, frozenset())


# 10 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [gru.HOT, 5])
def test_lm_base(docs, hot):
    from lattix.llm.common import fold

    rows = docs.collect()
    split = lambda t: (t or "").encode().lower().split()
    c: Counter = Counter()
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            c.update(split(r["text"]))
            c[b"\n"] += 1
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in gru.score_texts(docs, fold("doc_id", 7) != 2, hot=hot).collect()}
    for r in rows:
        w = [*split(r["text"]), b"\n"]
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(w), sum(x in c for x in w), n)
        assert g["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert g["score"] < 0


def test_lm_gradient_and_state():
    rng = np.random.default_rng(0)
    net = gru.Net([w.astype(np.float64) for w in gru.Net.fresh().w])
    x = rng.integers(0, gru.VOCAB, 40)
    whole = net.score([x])[0]
    h, total = np.zeros((1, gru.SIZE)), 0.0
    prev = gru.END
    for t in [*x, gru.END]:
        h, _ = net.step(np.array([prev]), h)
        total += net.output(h, np.array([t]))[0][0]
        prev = t
    assert whole == pytest.approx(total, rel=1e-5)
    assert net.score([x, x[:7], x[:0]])[1:] == pytest.approx([net.score([x[:7]])[0], net.score([x[:0]])[0]], rel=1e-5)
    h, y = rng.normal(size=(3, gru.SIZE)), np.array([0, 5, 700])
    grads = [np.zeros_like(w) for w in net.w]
    _, dh = net.output(h, y, grads)
    step = 1e-6
    for k in (0, 3):
        e = np.zeros_like(h)
        e[1, k] = step
        assert dh[1, k] == pytest.approx(-(net.output(h + e, y)[0].sum() - net.output(h - e, y)[0].sum()) / (2 * step), abs=1e-4)
    assert np.exp(net.output(np.repeat(h[:1], gru.VOCAB, 0), np.arange(gru.VOCAB))[0]).sum() == pytest.approx(1, abs=1e-4)


def test_lm_weight_gradients_through_time():
    rng = np.random.default_rng(2)
    net = gru.Net([w.astype(np.float64) + 0.05 * rng.normal(size=w.shape) for w in gru.Net.fresh().w])
    x, y = rng.integers(0, 40, (7, 3)), rng.integers(0, gru.VOCAB, (7, 3))
    real = np.ones((7, 3))
    real[5:, 2] = 0
    h = rng.normal(size=(3, gru.SIZE)) * 0.3
    grads, entries, _, loss = net.gradients(x, y, h, real)
    step = 1e-5
    for k, g in enumerate(grads):
        for flat in np.argsort(-np.abs(g).ravel())[[0, 3, 20]]:  # places with a gradient
            at = list(np.unravel_index(flat, g.shape))
            if k == 0:
                at[0] = entries[at[0]]
            at = tuple(at)
            old = net.w[k][at]
            net.w[k][at] = old + step
            up = net.gradients(x, y, h, real)[3]
            net.w[k][at] = old - step
            down = net.gradients(x, y, h, real)[3]
            net.w[k][at] = old
            assert g.ravel()[flat] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-5), (k, at)


def test_lm_learns_every_token_once(monkeypatch):
    seen = []
    inner = gru.Net.gradients
    monkeypatch.setattr(gru.Net, "gradients", lambda self, x, y, h, real: seen.extend(y[real > 0].tolist()) or inner(self, x, y, h, real))
    for n in (2, 3, 40, 1001):
        seen.clear()
        assert gru.Net.fresh().learn(np.arange(n)) == n - 1 and sorted(seen) == list(range(1, n))


def test_lm_beats_the_unigram_and_a_bigram():
    """On held-out text whose words depend on the words before: better than add-one unigrams and than an interpolated bigram."""
    rng = np.random.default_rng(3)
    n, v = 120_000, 40
    nexts = rng.integers(2, v, (v, v, 2))
    ids = np.zeros(n, np.int64)
    for i in range(2, n):  # the second last word counts as well, which a bigram cannot see
        ids[i] = nexts[ids[i - 2], ids[i - 1] % 2, int(rng.random() < 0.2)] if i % 30 else gru.END
    train, held = ids[: n * 5 // 6], ids[n * 5 // 6 :]
    counts = np.bincount(train, minlength=gru.VOCAB)
    net = gru.Net.fresh(counts)
    untrained = net.score([held[:-1]])[0]
    for _ in range(6):
        net.learn(train, streams=32, rate=0.1)
    one = (counts + 1) / (counts.sum() + v + 1)
    two = np.zeros((v, v))
    np.add.at(two, (train[:-1], train[1:]), 1)
    mixed = 0.9 * two / np.maximum(two.sum(axis=1, keepdims=True), 1) + 0.1 * one[:v]
    unigram, bigram = np.log(one[held]).sum(), np.log(mixed[np.r_[gru.END, held[:-1]], held]).sum()
    got = net.score([held[:-1]])[0]
    assert untrained == pytest.approx(unigram, rel=0.02) and got > 0.95 * bigram > 0.95 * unigram


def test_lm_learns():
    net = gru.Net.fresh()
    ids = np.tile(np.array([5, 9, 700, 33, 0]), 3000)
    before = net.score([ids[:200]])[0]
    net.learn(ids, rate=0.1)
    assert net.score([ids[:200]])[0] > 0.5 * before


def test_lm_learns_from_all_training_texts(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, "alpha beta gamma" if i % 3 == 0 else prose(rng, 30)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    given = []
    train = gru.train
    monkeypatch.setattr(gru, "train", lambda texts, *a, **b: given.append(sorted(r["text"] for r in texts.collect())) or train(texts, *a, **b))
    assert gru.score_texts(df, F.col("doc_id") % 7 != 2).count() == 300
    assert given == [sorted(t for i, t in rows if i % 7 != 2)]


def test_lm_odd(odd, none):
    assert gru.score_texts(none, F.lit(True)).count() == 0
    assert gru.score_texts(odd, F.lit(True)).count() == 5
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in gru.score_texts(odd, F.lit(False)).collect())


# pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    base = [prose(rng, 80) for _ in range(12)]
    item = " ".join(base[3].split()[10:30])
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)] + [(20, base[0], "en", "s", 1), (21, "123 456", "en", "s", 7), (22, base[5] + " write to a.b@c.de today", "en", "s", 1), (23, None, "en", "s", 0), (24, prose(rng, 80) + " write to a.b@c.de today", "en", "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # near copies are texts whose five-word shingles have a similarity of 0.8 or more; the least id of a component stays
    texts = {d: t.lower().split() for d, t, *_ in rows if d not in (21, 23)}
    sets = {d: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for d, w in texts.items()}
    want = {d for d in sets if not any(e < d and 5 * len(sets[d] & sets[e]) >= 4 * len(sets[d] | sets[e]) for e in sets)} - {3}
    assert set(got) == want == {0, 1, 2, *range(4, 12), 24}
    assert got[24]["text"].endswith("write to [EMAIL] today")
    p = pieces.load(pieces.default_model())
    assert all(p.decode(r["ids"]) == r["text"] and r["n_pieces"] == len(r["ids"]) for r in got.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "pii", "encode"]


@pytest.mark.parametrize("limit", [None, 3])
def test_near_dedup_is_exact_jaccard(spark, limit):
    import corpus_pipeline

    rng = random.Random(21)
    line = prose(rng, 25)
    texts = [prose(rng, 90) if i % 3 else prose(rng, 60) + " " + line for i in range(40)]
    for i in range(90):  # edited copies, of one text most of all, with similarities on both sides of 0.8
        words = texts[0 if i < 50 else rng.randrange(40)].split()
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = f"new{rng.random()}"
        texts.append(" ".join(words[rng.randrange(4) :]))
    texts += [texts[3], texts[3].upper(), "alpha beta", "alpha  Beta", line]
    order = rng.sample(range(len(texts)), len(texts))
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    pairs = 0
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                pairs += sets[i] != sets[j]
                root[find(i)] = find(j)
    want = {}
    for i, d in enumerate(order):
        want[find(i)] = min(d, want.get(find(i), d))
    df = spark.createDataFrame([(d, texts[i], "en", "s", 1) for i, d in enumerate(order)], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in neardup.components(df, limit=limit).collect()}
    assert pairs > 30 and got == {d: want[find(i)] for i, d in enumerate(order)}
    if limit is None:
        assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == sorted(want.values())


def test_near_dedup_by_blocks(spark, monkeypatch):
    """Pairs that no pivot joins are found in blocks, whatever the size of a chunk."""
    rng = random.Random(5)
    base = prose(rng, 120).split()
    texts = []
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randrange(3, 9)):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        texts.append(" ".join(words))
    sets = [neardup.shingles(t) for t in texts]
    root = np.arange(60)
    for i in range(60):
        for j in range(i):
            if neardup.alike(sets[i], sets[j]):
                root[root == root[i]] = root[j]
    want = Counter(root.tolist()).values()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    inner = neardup.links
    for chunk in (7, 1024):
        monkeypatch.setattr(neardup, "links", lambda s, shingle, limit, c=chunk: inner(s, shingle, limit, c))
        got = Counter(r["component_id"] for r in neardup.components(df).collect()).values()
        assert sorted(got) == sorted(want) and len(want) > 5


def test_parity_bitmaps_bound_the_difference():
    rng = np.random.default_rng(7)
    for n in (1, 5, 16, 17, 200, 3000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.r_[a[: n - n // 10], rng.integers(0, 1 << 63, n // 5, dtype=np.uint64)]
        x, y = neardup.parity(a)[None], neardup.parity(b)[None]
        assert x.size * 64 >= max(512, n)
        while x.size != y.size:
            x, y = (neardup.folded(x), y) if x.size > y.size else (x, neardup.folded(y))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
    rows = [(0, 0, 0, 0, 10), (0, 1, 0, 1, 10), (0, 0, 0, 2, 20), (1, 0, 0, 3, 10), (1, 0, 1, 4, 10), (1, 0, 1, 5, 10)]
    key, chunk, cross, comp, n = (np.array(c) for c in zip(*rows))
    pairs = [(int(min(p)), int(max(p))) for i, j in neardup.close_pairs(key, chunk, cross.astype(bool), comp, n, [neardup.parity(np.arange(10).astype(np.uint64)).tobytes()] * 6, piece=2) for p in zip(i, j)]
    assert sorted(pairs) == [(0, 1), (3, 4), (3, 5)]


def test_near_dedup_odd_rows(spark):
    import corpus_pipeline

    rng = random.Random(9)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(None, a, "en", "s", 1), (1, b, "en", "s", 1), (None, b, "en", "s", 1), (2, c, "en", "s", 1), (2, a + " and more", "en", "s", 1), (2, c, "en", "s", 1), (7, None, "en", "s", 1), (8, "", None, None, None), (9, " ", "en", "s", 1)]
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect())
    assert got == sorted([("2", a + " and more"), ("1", b), ("2", c), ("7", "None")])
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame([], DOCS), "").count() == 0
    only = [(None, a, "en", "s", 1), (None, a, "de", "t", 2), (None, c, "en", "s", 1)]
    assert sorted(r["text"] for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(only, DOCS), "").collect()) == sorted([a, c])


def test_decontaminate_stage_judges_rows_by_their_text(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(10)
    a, b = prose(rng, 40), prose(rng, 40)
    spark.createDataFrame([(1, " ".join(a.split()[5:25]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, a, "en", "s", 1), (None, b, "en", "s", 1), (3, a, "en", "s", 1), (3, b, "en", "s", 1), (4, None, "en", "s", 1)]
    got = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, DOCS), str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted([("None", b), ("3", b), ("4", "None")])


def test_decontaminate_query_equals_its_sql_on_repeated_and_null_ids(spark, tmp_path):
    import duckdb

    rng = random.Random(31)
    a, b, c = (prose(rng, 40) for _ in range(3))
    rows = [(1, a), (1, b), (1, a + " " + c), (None, b), (None, c), (2, None), (3, ""), (4, c), (4, c)]
    items = [(1, " ".join(a.split()[5:25])), (2, " ".join(b.split()[:12])), (3, "tiny " + c.split()[0])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(str, ((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.query(spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    cur = con.execute(decontam.SQL)
    names = [d[0] for d in cur.description]
    want = sorted(str(tuple(dict(zip(names, r))[k] for k in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))) for r in cur.fetchall())
    assert got == want and len(got) == 5


def test_digest_of_query_columns(spark, docs):
    spans = [(k, a, b) for k, a, b, _ in pii.find("a@b.cc 10.0.0.1")]
    assert hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest() == hashlib.sha256(b"email:0:6,ip:7:15").hexdigest()
