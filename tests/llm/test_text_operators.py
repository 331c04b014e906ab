"""Repeated lines, distinctive words, encoding, leakage, stuffing: small fixtures and brute force."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from storyweft.llm import leakage, lines, stuffing, terms, tokenize

# --- repeated lines


def articles(spark, rows):
    df = spark.createDataFrame(rows, "id string, site_name string, content string")
    return df.withColumn("line", F.lit("clash")).withColumn("k", F.lit(1)).withColumn("n1", F.lit(2))


def site(name, n, share, line="Share  <b>THIS</b> 2026"):
    own = lambda i: "".join(chr(97 + int(d)) for d in str(i))  # noqa: E731 - digits would be alike
    return [(f"{name}{i}", name, f"<p>{line}</p>\nUnique text of {name} and {own(i)}x\n" if i < share else f"Unique words {name} number {own(i)}") for i in range(n)]


def test_lines_against_counts(spark):
    rows = site("A", 40, 4) + site("B", 40, 5) + site("C", 20, 20, "Only here") + site("D", 6, 4) + [("n1", None, "Only here"), (None, "C", "x"), ("m", "C", None), ("B0", "B", site("B", 1, 1)[0][2]), ("e", "E", "")]
    got = {tuple(r) for r in lines.found_lines(articles(spark, rows), fdr=1.0).collect()}
    assert got == {("B", "share this #"), ("C", "only here")}
    assert {tuple(r) for r in lines.found_lines(articles(spark, rows)).collect()} == {("C", "only here")}  # four of A's forty hold B's line
    clean = {r["id"]: r["content"] for r in lines.without_repeated_lines(articles(spark, rows)).collect()}
    assert clean["C3"] == "Unique text of C and dx\n" and clean["n1"] == "Only here" and clean["m"] == "" and clean["A0"].startswith("<p>Share")
    assert lines.found_lines(articles(spark, rows).where("false")).count() == 0


def test_chance_lines_are_no_excess(spark):
    """A line as frequent in one site as outside is no excess."""
    assert lines.upper_tail(3.841) == pytest.approx(0.05, abs=1e-3)
    df = spark.createDataFrame([(5.0, 50.0, 50.0, 500.0), (5.0, 50.0, 0.5, 500.0)], "a double, b double, c double, d double")
    r = [x[0] for x in df.select(lines._ratio(*(F.col(c) for c in "abcd"))).collect()]
    assert r[0] == pytest.approx(0.0) and r[1] > 15


def test_ratio_decides(spark):
    """A line that reaches the counts but is as frequent on other sites is only taken if the ratio may not decide; hot keys are cut into parts."""
    rows = site("A", 30, 5) + [r for k in range(8) for r in site(f"B{k}", 30, 4 + k % 2)] + site("C", 30, 9, "Own notice")
    got = {tuple(r) for r in lines.found_lines(articles(spark, rows), hot=3).collect()}
    assert got == {("C", "own notice")}
    every = {tuple(r) for r in lines.found_lines(articles(spark, rows), fdr=1.0).collect()}
    assert ("A", "share this #") in every and got < every


def test_compared_form(spark):
    df = spark.createDataFrame([("<p>A  B</p>12,345 &amp; < c",)], "s string")
    assert df.select(lines.compared(F.col("s"))).first()[0] == "a b #,# &amp; < c"


# --- distinctive words


def test_terms_against_formula(spark):
    rows = [("a", "owl owl mill"), ("a", "owl"), ("b", "owl tower"), ("c", ""), ("d", None), (None, "owl"), ("e", "mill tower tower tower long " * 50)]
    df = spark.createDataFrame(rows, "id string, title_norm string").withColumn("term", F.lit(1)).withColumn("tf", F.lit(1))
    got = {(r["id"], r["term"]): r for r in terms.distinctiveness(df).collect()}
    assert set(got) == {("a", "owl"), ("a", "mill"), ("b", "owl"), ("b", "tower"), ("e", "mill"), ("e", "tower"), ("e", "long")}
    n, avg = 5, (3 + 2 + 0 + 0 + 250) / 5
    tfn = 2 * math.log2(1 + avg / 3)
    lam = 3 / n
    assert got["a", "owl"]["score"] == pytest.approx((math.log2(1 + lam) + tfn * math.log2((1 + lam) / lam)) / (tfn + 1)) and got["a", "owl"]["df"] == 2
    assert {(r["id"], r["term"]) for r in terms.distinctive(df, most=2).collect()} == {(i, w) for i, w in got if w != "long"}
    assert terms.distinctiveness(df.where("false")).count() == 0
    assert {tuple(r) for r in terms.distinctiveness(df, hot=1).collect()} == {tuple(r) for r in got.values()}
    assert {tuple(r) for r in terms.distinctive(df, most=2, hot=1).collect()} == {tuple(r) for r in terms.distinctive(df, most=2).collect()}


def test_information_cuts_words(spark):
    """What a word tells falls with its records, so its bounds and those of the records are the same cut; without the model none is made."""
    rows = [(f"{n}-{i}", f"w{n}") for n in range(1, 8) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, title_norm string")
    told = {r["term"]: r["bits"] for r in terms.distinctive(df, most=5).groupBy("term").agg(F.first(terms.information(F.col("df") / F.lit(28.0))).alias("bits")).collect()}
    assert sorted(told, key=told.get) == ["w5", "w4", "w3", "w2"]
    assert terms.distinctive(df.where("false")).count() == 0


# --- encoding


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokenize.PATTERN, mergeable_ranks=tokenize.load_ranks(), special_tokens={})


def test_encoding_against_a_library(reference):
    rng = random.Random(2)
    texts = ["", None, "<|endoftext|>", "a" * 50_000, " " * 3000 + "x", "".join(rng.choice("abcdefgh") for _ in range(3000)), "\x00\x01 é漢🙂​", "It's we'll DON'T"]
    texts += ["".join(chr(rng.randrange(1, 0x2FFF)) for _ in range(rng.randrange(60))) for _ in range(300)] + ["".join(rng.choice("etaoin shrdlu'\n") for _ in range(rng.randrange(300))) for _ in range(300)]
    got = tokenize.Encoder(tokenize.load_ranks()).encode(texts)
    assert [list(g) for g in got] == [reference.encode_ordinary(t) if t else [] for t in texts]
    for t, ids in zip(texts, got):  # there and back
        assert not t or reference.decode(list(ids)) == t


@pytest.mark.parametrize("size", [1, 255, 256, 257, 1023, 1024, 1025, 4000])
def test_folded_pieces_are_encoded_like_rows(reference, size):
    """A piece folded into blocks gives what one row gives, at each side of every bound."""
    rng = random.Random(size)
    encoder = tokenize.Encoder(tokenize.load_ranks())
    for text in ("a" * size, "".join(rng.choices("abet hin".replace(" ", ""), k=size)), "".join(rng.choices("théñüß漢字", k=size)), "=" * size, "".join(rng.choices("=-_*", k=size))):
        raw = text.encode()
        want = reference.encode_ordinary(text)
        assert [int(x) for x in encoder._folded(raw)] == [int(x) for x in encoder._rows([raw], len(raw))[0]]
        assert [int(x) for x in encoder.encode([text])[0]] == want


def test_a_very_long_piece(reference):
    text = "".join(random.Random(5).choices("aeinrst", k=60_000))
    assert [int(x) for x in tokenize.Encoder(tokenize.load_ranks()).encode([text])[0]] == reference.encode_ordinary(text)


def test_encoding_of_a_table(spark, reference):
    df = spark.createDataFrame([(1, "Owls at the mill"), (2, None), (3, ""), (3, ""), (4, "x y")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = sorted((r["doc_id"], list(r["ids"])) for r in tokenize.encode(df).collect())
    assert got == [(1, reference.encode_ordinary("Owls at the mill")), (2, []), (3, []), (3, []), (4, reference.encode_ordinary("x y"))]
    assert tokenize.encode(df).schema["ids"].dataType.simpleString() == "array<int>" and tokenize.encode(df.where("false")).count() == 0


# --- leakage


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def brute_leaks(docs, items):
    out = set()
    for i, u in items:
        w = words(u or "")
        n = min(13, len(w))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for d, t in docs:
            x = words(t or "")
            if any(tuple(x[k : k + n]) in grams for k in range(len(x) - n + 1)) and grams:
                out.add((d, i))
    return out


@pytest.mark.parametrize(("bits", "hot"), [(leakage.BITS, 500_000), (32, 3)])
def test_leaks_against_brute_force(spark, bits, hot):
    """Also with a filter too small to drop anything, and with each fingerprint of over three places joined in parts."""
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(15)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 8, 12, 13, 14, 40])))) for i in range(40)] + [(90, None), (91, ""), (92, "?!"), (None, "w1 w2"), (1, "w3 w4")]
    docs = [(9, None), (10, ""), (11, "…"), (None, "w1 w2")]
    for d in range(100, 160):
        body = rng.choices(vocabulary, k=rng.randrange(60))
        if rng.random() < 0.7:
            w = words(rng.choice(items[:40])[1])
            a = rng.randrange(len(w))
            cut = w[a : a + rng.choice([11, 12, 13, 14, 20])]
            body[len(body) // 2 : len(body) // 2] = cut
        docs.append((d, ", ".join(body).upper()))
    df = spark.createDataFrame(docs + docs[-3:], "doc_id bigint, text string").withColumn("item_id", F.lit(1)).withColumn("t", F.lit("clash"))
    ev = spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in leakage.leaks(df, ev, bits=bits, hot=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_leaks([d for d in docs if d[0] is not None], [i for i in items if i[0] is not None])
    assert leakage.leaks(df.where("false"), ev).count() == 0 and leakage.leaks(df, ev.where("false")).count() == 0


def test_every_span_keeps_a_fingerprint():
    import numpy as np

    rng = random.Random(3)
    from storyweft.llm.shingles import Hasher, runs

    h, ends = Hasher().texts([" ".join(rng.choices("abcdef", k=200))])
    kept = set(leakage.winnow(h, ends, 9, 13).tolist())
    assert all(kept & set(range(s, s + 5)) for s in range(200 - 13 + 1)) and len(kept) < len(runs(h, 9))
    assert not len(leakage.winnow(*Hasher().texts(["too short"]), 9, 13)) and not len(leakage.winnow(np.empty(0, np.uint64), np.zeros(1, np.int64), 9, 13))


# --- stuffing


def prose(rng, n):
    s = ["the keeper of the mill saw an owl in the tower", "nobody at the {} would say what it was that night", "a neighbour from {} heard the wall and the bell", "it was not the first time that {} had seen it"]
    return ". ".join(rng.choice(s).format(f"Town{rng.randrange(999)}") for _ in range(n))


def test_stuffed_pages(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(3, 30)), "en") for i in range(200)]
    bad = {
        1000: " ".join(rng.choice(["cheap ring", "buy ring", "ring price", "emf meter"]) for _ in range(80)),
        1001: "\n".join(f"http://shop{i}.example/ghost-tour/{i * 37}" for i in range(40)),
        1002: "#GhostTour #BuyGhostTour #GhostTourPrice " * 12,
        1003: prose(rng, 1) + "\n" + "\n".join(f"doll | SKU {i * 771} | {i}.99 | M sale" for i in range(40)),
    }
    good = {2000: "\n".join(f"0{i}.05. Town{i}, 1{i}:20 – {prose(rng, 1)}" for i in range(9)), 2001: prose(rng, 12) + "\nMore at https://x.example/1 (our shop has meters).", 2002: (prose(rng, 2) + "\n") * 4}
    rows += [(k, v, "en") for k, v in bad.items()] + [(k, v, rng.choice(["EN", None, "de"])) for k, v in good.items()]
    rows += [(3000, None, "en"), (3001, "", "en"), (3002, " \n ", None), (None, bad[1000], "en"), (1000, bad[1000], "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(3))
    got = {r["doc_id"] for r in stuffing.stuffed(df).collect()}
    assert got == set(bad)
    assert stuffing.stuffed(df.where("false")).count() == 0


@pytest.mark.parametrize("copies", [True, False])
def test_frequent_stuffing_is_no_prose(spark, copies):
    """Copies of one stuffed page, and pages of one keyword set, are found however many they are."""
    rng = random.Random(8)
    stuff = lambda: " ".join(rng.choice(["cheap ring", "buy ring", "ring price", "emf meter"]) for _ in range(80))
    page = stuff()
    rows = [(i, prose(rng, rng.randrange(3, 30)), "en") for i in range(200)] + [(1000 + i, page if copies else stuff(), "en") for i in range(300)]
    got = {r["doc_id"] for r in stuffing.stuffed(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert got == set(range(1000, 1300))


def test_curve_of_a_page(spark):
    import numpy as np

    text = "aa aa aa aa bb bb cc dd"
    got = stuffing.curves(spark.createDataFrame([(1, text, None)], "doc_id bigint, text string, lang string")).first()
    f = np.array([4.0, 2.0, 1.0, 1.0])
    x, y = np.log([1, 2, 3.5, 3.5]), np.log(f)  # words of one frequency share the middle of their ranks
    b, a = np.polyfit(x, y, 1)
    assert got["n"] == 8 and got["slope"] == pytest.approx(-b) and got["residual"] == pytest.approx(np.sqrt(np.mean((y - a - b * x) ** 2)))


def test_curve_flags_alone(spark):
    """Pages of prose words over and over have the usual prose share: only the curve tells them."""
    rng = random.Random(4)
    rows = [(i, prose(rng, 14 + i % 9), "en") for i in range(300)]
    rows += [(1000 + i, " ".join(["mill tower"] * 70 + rng.sample(["the keeper of the mill saw an owl in the tower"] * 3, 3)), "en") for i in range(4)]
    rows += [(2000 + i, w, "en") for i, w in enumerate(["qwx", "qwx zrv", "qwx zrv kkl"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r["doc_id"] for r in stuffing.stuffed(df).collect()} == {1000, 1001, 1002, 1003}
    assert not {r["doc_id"] for r in stuffing.stuffed(df, curve=False).collect()}


def test_page_words():
    assert stuffing.PageWords()("<a href=\"x\">BuyGhostTour</a> Straße ÉLAN a_b") == {"href": 1, "x": 1, "buy": 1, "ghost": 1, "tour": 1, "straße": 1, "élan": 1, "a": 1, "b": 1}
