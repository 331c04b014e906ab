import random

import pytest
from pyspark.sql import functions as F

from storyweft.llm import furniture, pages, residue

SITES = ["Tarn Daily", "Mill Post"]


def prose(rng):
    s = ["The keeper of {} saw a pale shape over the old mill before dawn.", "Nobody at {} would say what it was that night in Harl.", "A neighbour from {} heard the wall and then the bell.", "Old maps of {} show the tower further north than it is."]
    return " ".join(x.format(f"T{rng.choice('abcdefg')}{rng.choice('opqrs')}wick") for x in rng.sample(s, 4))


def page(rng, i):
    site = SITES[i % 2]
    town = f"L{rng.choice('aeiou')}{rng.choice('bcdfg')}ford"
    body = [f"<p>{prose(rng)}</p>" for _ in range(4)]
    body.insert(2, f"<blockquote><p>It waits for {town}.</p></blockquote>")
    body.insert(3, f"<p>Not so {town}.</p>")
    head = [f"<div>By Ann {town} and agencies</div>", f"<p>{rng.randrange(900)} readers are on this page now</p>"]
    foot = [f"<p>Follow {site} for more news from {town}.</p>", f"<span>Listen to this piece, read by {town} ({rng.randrange(9)} min)</span>", "", f"<p>© {2000 + i % 20} {site}. All rights reserved.</p>"]
    return (f"a{i:03d}", site, f"Title {i} of {town}", "\n".join(head + body + foot), foot[0] if i % 3 == 0 else body[0][3:80])


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    rows = [page(rng, i) for i in range(120)]
    errors = [(f"e{i}", SITES[i % 2], "Page not found", "\n".join(rng.sample([f"<p>Access to x{i}.example was denied. Reference #{i}.ab</p>", f"Error {400 + i}: the upstream server closed the connection", "Your session has ended. Log in again."], 2)), None) for i in range(12)]
    odd = [
        ("s1", SITES[0], "Mill of {{town}}", rows[0][3], None), ("s2", SITES[0], "Fine", rows[1][3].replace("keeper", "[INSERT NAME HERE]", 1).replace("Nobody", "[INSERT NAME HERE]", 1).replace("neighbour", "TK WHO TK", 1).replace("Old maps", "%%maps%%", 1), None),
        ("s3", None, "undefined", "null null\nNaN", None), ("f1", SITES[1], "Fine", "<p>" + "lorem vento corda ipsum ferro umbra salix velit " * 5 + "</p>", None), ("f2", SITES[1], "Fine", "sample text body copy " * 9, None),
        ("ok1", SITES[1], "{Sic} Mill [Updated]", rows[2][3] + '\n<p>In the margin stood "insert name here", and sets such as {a, b}.</p>', None), ("nul", None, None, None, None), ("emp", SITES[0], "", "", ""), (None, SITES[0], "{{x}}", "{{x}}", None),
        ("long", SITES[0], "Fine", "<p>" + prose(rng) * 800 + "</p>", None),
    ]
    names = "id string, site_name string, title string, content string, excerpt string"
    return spark.createDataFrame(rows + errors + odd + rows[:3], names).withColumn("k", F.lit("clash")).withColumn("no", F.lit(1)).withColumn("template", F.lit(1))


def test_residue(corpus):
    got = {r["id"]: r for r in residue.residue(corpus).collect()}
    assert set(got) == {f"e{i}" for i in range(12)} | {"s1", "s2", "s3", "f1", "f2"}
    assert got["s1"]["slot"] and got["f1"]["filler"] and got["e3"]["whole_page"] and not got["e3"]["slot"]
    assert residue.residue(corpus.where("false")).count() == 0


def test_furniture(corpus):
    found = {}
    for r in furniture.furniture(corpus).collect():
        found.setdefault(r["id"], set()).add(r["line_no"])
    wrong = 0
    for i in range(120):
        expected = {0, 1, 8, 9, 11} | ({-1} if i % 3 == 0 else set())
        wrong += found.get(f"a{i:03d}", set()) != expected
    assert wrong == 0
    assert not {"nul", "emp", "s1", "e1"} & set(found)
    assert furniture.furniture(corpus.where("false")).count() == 0


def test_main_text(corpus):
    got = {r["id"]: r["content"] for r in furniture.main_text(corpus).collect()}
    assert "readers are on" not in got["a005"] and "Not so" in got["a005"] and "rights reserved" not in got["a005"]
    assert got["emp"] == "" and got["nul"] == "" and "e1" not in got and len(got["long"]) > 100_000


@pytest.mark.parametrize(
    "text,slot",
    [
        ("{{ name }}", True), ("${body}", True), ("#{x.y}", True), ("<%= a %>", True), ("<p>{% block x %}</p>", True), ("@@CITY@@", True), ("__CITY__", True), ("XX_BODY_XX", True), ("[[quote]]", True), ("[summary goes here]", True),
        ("TK BODY TK", True), ("{body|default:none}", True), ("&lt;AUTHOR_NAME&gt;", True), ("[object Object]", True), ("{Sic} x", False), ("[Updated]", False), ("{a, b}", False), ('<a href="x">y</a>', False), ("5 < 6 and TKMaxx", False), ("", False), (None, False),
    ],
)
def test_slots(text, slot):
    assert residue.holds_slot(text) is slot


def test_masks():
    m = pages.Masker()
    assert m("Follow Tarn Daily for more from Skelling Mill.", "Tarn Daily") == ["follow", "Ⓢ", "for", "more", "from", "N"]
    assert m("Reader bob12 wrote: 5 of x.example", None) == ["reader", "U", "wrote:", "#", "of", "H"]
    assert m("TERMS | PRIVACY", None) == ["terms", "|", "privacy"]
    assert pages.visible_lines("<p>a</p>\n\n <br/> \nb  c") == [(0, "<p>a</p>", "a"), (3, "b  c", "b c")]


def test_slots_are_induced(spark):
    """A position that siblings fill with different values is a slot; a variable in any syntax, a blank or a default there isn't filled."""
    rng = random.Random(9)
    rows = []
    for i in range(40):
        town = f"L{rng.choice('aeiou')}{rng.choice('bcdfg')}ford"
        rows.append((f"r{i}", "Tarn Daily", f"Title {'abcdefgh'[i % 8]} words", f"<p>By Ann {town}, staff</p>\n<p>{prose(rng)}</p>\n<p>{prose(rng)}</p>"))
    values = ["[NAME]", "$name$", "<<name>>", "%name%", "____", "", "undefined", "AUTHOR_NAME", "[YOUR NAME]", "&lt;name&gt;", "@name@", "{name}"]
    rows += [(f"u{i}", "Tarn Daily", "Fine", rows[i][3].replace(rows[i][3].split(", staff")[0].split("By ")[1], v, 1)) for i, v in enumerate(values)]
    rows.append(("para", "Tarn Daily", "Fine", rows[20][3].replace("keeper", "$name$", 1)))
    rows += [("ok1", "Tarn Daily", "Fine", rows[21][3].replace("keeper", "[sic]", 1)), ("ok2", "Tarn Daily", "Fine", rows[22][3].replace(", staff", " [sic], staff")), ("ok3", "Tarn Daily", "[Updated] Title a words", rows[23][3])]
    df = spark.createDataFrame(rows, "id string, site_name string, title string, content string")
    got = {r["id"] for r in residue.residue(df).where("slot").collect()}
    assert got == {f"u{i}" for i in range(len(values))} | {"para"}


def test_frequent_filler_is_filler(spark):
    """Filler that a tenth of the records hold is filler, and a report in a language of one in a hundred isn't."""
    rng = random.Random(4)
    latin = "lorem vento corda ipsum ferro umbra salix velit dolor morba amera fusta tenui nulla pelat quisso".split()
    dutch = ["de molenaar van {} zag een vreemd licht boven de oude toren en hij zei dat het een uil was", "niemand in {} wist wat het was maar de buren van de molen hoorden een klok in de nacht"]
    rows = [(f"r{i}", "Tarn Daily", "Fine", "en", f"<p>{prose(rng)}</p>\n<p>{prose(rng)}</p>") for i in range(1500)]
    rows += [(f"f{i}", "Tarn Daily", "Fine", "en", "<p>" + " ".join(rng.choices(latin, k=45)) + "</p>") for i in range(170)]
    rows += [(f"n{i}", "Tarn Daily", "Fine", "nl", "<p>" + " ".join(d.format(f"Dorp{rng.choice('abcde')}") for d in dutch) + "</p>") for i in range(15)]
    df = spark.createDataFrame(rows, "id string, site_name string, title string, lang string, content string")
    assert {r["id"] for r in residue.residue(df).where("filler").collect()} == {f"f{i}" for i in range(170)}


def test_raw_slots():
    """A slot in angle brackets is one without any other sign; markup in capitals is none."""
    assert residue.holds_slot("<HEADLINE>") and residue.holds_slot("<p>By <AUTHOR>.</p>")
    assert not residue.holds_slot("<DIV>Owls</DIV>") and not residue.holds_slot("<P>Owls</P>")


def report(rng, n=5, words=60):
    return [f"<p>{' '.join(rng.choice(['owl', 'mill', 'tower', 'keeper', 'rope', 'bell', 'stone', 'field', 'water']) + rng.choice(['s', '', 'ing', 'ed']) for _ in range(words))}.</p>" for _ in range(n)]


def test_host_classes_decide(spark):
    """A notice as long as a paragraph is furniture by its host's class alone, and an article that a host repeats whole is none."""
    rng = random.Random(2)
    notice = "<p>" + " ".join(f"clause{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(70)) + " as of {}.</p>"
    rows = [(f"n{i:03d}", "Tarn Daily", "T", "\n".join([*report(rng), notice.format(i)])) for i in range(90)]
    again = "\n".join(report(rng))
    rows += [(f"r{i:03d}", "Mill Post", "T", again) for i in range(60)] + [(f"p{i:03d}", "Mill Post", "T", "\n".join(report(rng))) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, site_name string, title string, content string").withColumn("excerpt", F.lit(None).cast("string"))
    line = pages.lines(df).cache()
    off = lambda hosts, hot: {(r["k"], r["no"]) for r in pages.judged(line, hosts, hot).where(F.col("template") >= pages.OUTSIDE).collect()}
    expected = {(f"n{i:03d}", 5) for i in range(90)}
    assert off(True, 500_000) == expected and off(True, 10) == expected and off(False, 10) == set()


def test_occurrence_vectors(spark):
    """Forms of one vector are a class if their order is the same on all pages; the vote of a page counts once for a class."""
    rows = [(f"k{i}", 0, 11, True) for i in range(4)] + [(f"k{i}", 1, 12, True) for i in range(4)]  # one class in order
    rows += [(f"k{i}", 2 + i % 2, 21, False) for i in range(4)] + [(f"k{i}", 3 - i % 2, 22, True) for i in range(4)]  # the same vector as well, so out of order
    rows += [(f"m{i}", 0, 31, True) for i in range(5)] + [(f"m{i}", 1, 31, False) for i in range(2)] + [("m9", 0, 41, True), ("m8", 0, 41, True)]
    met: set = set()
    rows = [(*r, (r[0], r[2]) not in met and not met.add((r[0], r[2]))) for r in rows]
    line = spark.createDataFrame(rows, "k string, no bigint, k0 bigint, outside boolean, first boolean").withColumn("weight", F.lit(1.0))
    assert {r["class"]: (r["out"], r["n"]) for r in pages.host_classes(line).collect()} == {31: (pytest.approx(5 * 5 / 7), 5)}
    ordered = line.where("k0 not in (21, 22)")
    got = {r["class"]: (r["out"], r["n"]) for r in pages.host_classes(ordered, hot=2).collect()}
    assert got == {11: (4.0, 4), 12: (4.0, 4), 31: (pytest.approx(5 * 5 / 7), 5)}


def test_paragraphs_have_the_language_s_length(spark):
    rng = random.Random(3)
    rows = [(f"e{i}", "\n".join(report(rng, 3, 60)), "en-GB") for i in range(30)] + [(f"z{i}", "\n".join(report(rng, 3, 8)), "ZH") for i in range(30)]
    words = pages.vocabulary(spark.createDataFrame(rows, "id string, content string, lang string"))
    assert words.least_words("en") == 30 and words.least_words("zh") == 4 and words.least_words("xx") in (4, 30)


def test_what_a_part_of_a_line_tells_holds_of_the_whole():
    rng = random.Random(3)
    common, rare = [f"c{i}" for i in range(40)], [f"Rß{i}" for i in range(4000)]
    usual, told = frozenset(common), set()
    for _ in range(4000):
        n, share = rng.randint(12, 130), rng.choice([0, 0.03, 0.05, 0.2, 0.25, 0.6])
        pool = rare if rng.random() < 0.7 else rare[: rng.randint(1, 40)]
        w = [rng.choice(common) if rng.random() < share else rng.choice(pool) for _ in range(n)]
        if rng.random() < 0.3:
            w.sort()  # all usual words at one end
        line, low = " ".join(w), [x.casefold() for x in w]
        known = sum(x in usual for x in low)
        assert pages.is_odd(line, usual) == (known < pages.CORE_SHARE * n)
        parts = [low[i : i + 48] for i in range(0, n, 48)]
        if len(parts) > 1 and len(parts[-1]) < 12:
            parts.pop()
        filler = known < 0.2 * n or 2 * sum(len(set(p)) < 0.35 * len(p) for p in parts) > len(parts)
        assert residue.is_filler(line, usual) == filler
        told.add((pages.is_odd(line, usual), filler))
    assert len(told) >= 3


def test_plain_words_are_told_like_all_others():
    words = ["owl", "Owl", "OWL", "owlMill", "None", "null", "nil", "undefined", "NaN", "Null", "x", "X", "ß", "Ǆ", "字", "été", "HEADLINE_A", "N/A", "Ⓢ"]
    unfilled = {w for w in words if pages.MARKED.match(w) or pages.BLANK.fullmatch(w) or pages.NO_VALUE.fullmatch(w) or pages.VARIABLE.fullmatch(w)}
    assert {w for w in words if pages.is_unfilled(w)} == unfilled == {"owlMill", "None", "null", "nil", "undefined", "NaN", "HEADLINE_A", "N/A"}
    assert [pages.token_mask(w, False, False) for w in ("owl", "Owl", "OWL", "ß", "Ⓢ")] == ["owl", "N", "N", "ss", "Ⓢ"]
    assert pages.token_mask("Owl", True, False) == "owl" and pages.token_mask("OWL", False, True) == "owl"
    read = pages.Former(pages.Masker())
    assert read("by Ann Lee for The Owl, 3 pm", None) == (["by", "N", "for", "N", "#", "pm"], "by \0 for \0 pm", ["Ann Lee", "The Owl, 3"])
    assert read("by [name of author] | desk", None)[2] == [None]
    assert list(read("still owls", None)[0]) == ["still", "owls"]


def test_lines_read_at_once_are_told_like_single_ones():
    """Lines are equal in class, form and slots, each taken with thousands of others, where mask, form and values of a line by itself are."""
    rng = random.Random(7)
    words = ["by", "Ann", "Lee", "x.example", "bob12", "5", "The", "owl,", "Note:", "Harl:", "|", "[name]", "$name$", "{a b}", "____", "undefined", "©", "Tarn", "Daily", "TERMS", "ß", "字", "\ud800", "…", "AUTHOR_NAME", "Tarn Daily"]
    known = {"by": True, "the": True, "note:": True, "owl,": True}
    read, former = pages.Reader(pages.Masker(known)), pages.Former(pages.Masker(known))
    lines = [(" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))), rng.choice([None, "Tarn Daily", "daily"])) for _ in range(6000)]
    lines += [("SITE TERMS", None), ("© 2001 TARN DAILY", "Tarn Daily"), ("[name]", None), ("-", None), ("[name of author] wrote 5", None)]
    single, many = [], []
    for start in range(0, len(lines), 1500):
        some = lines[start : start + 1500]
        held = [site if site and site.casefold() in text.casefold() else None for text, site in some]
        for (text, _), site in zip(some, held):
            mask, form, values = former(text, site)
            end, size = "a" if text[-1].isalnum() else text[-1], text.count(" ") // 3
            marks = "0" if text.isascii() and "|" not in text else str(min(text.count(" | "), 3))
            single.append((tuple(mask), (tuple(mask[:2]), size > 0), (marks, any(m[-1:] == ":" for m in mask[:3]), end, size > 0), form, None if form is None else tuple(values)))
            assert read.add(text, text, site, text.count(" ") + 1, "p", pages.MARKS(text) is not None) == (len(single) - 1) % 1500
        k1, k2, k3, forms, slots = read.read()
        many += zip(k1.tolist(), k2.tolist(), k3.tolist(), forms.to_pylist(), (s if s is None else tuple(s) for s in slots.to_pylist()))
    for one, other in zip(zip(*single), zip(*many)):
        assert len(set(one)) == len(set(other)) == len(set(zip(one, other)))
    assert all((f is None) == (g is None) for (*_, f, _), (*_, g, _) in zip(single, many))
    assert [s and [v is None for v in s] for *_, s in single] == [s and [v is None for v in s] for *_, s in many]
    assert [len(x) for x in read.read()] == [0] * 5


def test_residue_reads_and_judges_what_it_needs(corpus, monkeypatch):
    """Paragraphs without variables are no rows for residue, lines of pages with a paragraph aren't judged, and what is judged is the same."""
    plain = corpus.drop("k", "no", "template")
    words = pages.vocabulary(plain)
    whole, less = pages.lines(plain, key="id", words=words).cache(), pages.lines(plain, key="id", words=words, paragraphs=False).cache()
    assert whole.where("no >= 0 and k1 is null").count() > 400 and less.where("no >= 0 and k1 is null and marks is null").count() == 0
    rows = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    assert rows(less.where("k1 is not null"), *less.columns) == rows(whole.where("k1 is not null"), *less.columns)
    judged, bare = pages.judged(whole, False), pages.judged(less, False, bare=True)
    assert rows(judged.where("bare"), *judged.columns) == rows(bare, *judged.columns) and bare.count() < judged.count() / 10
    monkeypatch.setattr(pages, "AT_ONCE", 50)
    small = pages.lines(plain, key="id", words=words)
    assert rows(small, *small.columns) == rows(whole, *small.columns)


def test_wider_classes_are_joined_to_kinds_of_lines(corpus, monkeypatch):
    """Figures of wider classes are those of all their lines, and are joined to the kinds of lines, not to each line."""
    line = pages.lines(corpus.drop("k", "no", "template"), key="id", excerpt="excerpt").cache()
    joined, join = {}, pages.salted_join
    monkeypatch.setattr(pages, "salted_join", lambda rows, stats, keys, *args, **more: joined.update({tuple(keys): rows.count()}) or join(rows, stats, keys, *args, **more))
    got = {(r["k"], r["no"], r["bare"], round(r["shared"], 9), round(r["whole"], 9)) for r in pages.judged(line, False, 3).where("no >= -1").collect()}
    rows = line.where("k1 is not null").collect()
    assert any(r["weight"] < 1 for r in rows) and any(r["no"] == -1 for r in rows) and any(r["bare"] for r in rows)
    sums: dict = {}
    for r in rows:
        for c in (("k1", r["k1"]), ("k2", r["k2"]), ("k3", r["k3"])):
            if r["no"] >= 0:
                of = sums.setdefault(c, [0, 0, 0, 0])
                for i, x in enumerate((r["outside"] is not None, r["outside"], True, r["bare"])):
                    of[i] += r["weight"] * bool(x)
    expected = set()
    for r in rows:
        shared, whole = pages.USUAL_OUTSIDE, pages.USUAL_BARE
        for c in ("k3", "k2", "k1"):
            n, out, m, bares = sums.get((c, r[c]), [0] * 4)
            if m > 1.001:
                shared, whole = (out + 8 * shared) / (n + 8), (bares + 8 * whole) / (m + 8)
        expected.add((r["k"], r["no"], r["bare"], round(shared, 9), round(whole, 9)))
    assert expected <= got and len(got) == len(expected | {(r["k"], r["no"]) for r in line.where("k1 is null and k0 is not null").collect()})
    assert max(joined["k1",], joined["k2",], joined["k3",]) < len(rows) / 4
    assert pages._without_digits("Of 12, 3 owls #") == pages._number("of #, # owls #") != pages._without_digits("Of ##, 3 owls #")


def test_lines_of_a_record_stay_one_row(corpus, monkeypatch):
    """What is cut is a row for each stored record, its lines together and all copies weighed as one."""
    cuts: list = []
    monkeypatch.setattr(pages, "cut", lambda df, cut=pages.cut: cuts.append(cut(df)) or cuts[-1])
    plain = corpus.drop("k", "no", "template")
    words = pages.vocabulary(plain)
    assert len(cuts) == 1
    pages.classified(plain, key="id", words=words)
    held = next(df for df in cuts if "lines" in df.columns)
    stored = plain.where("id is not null and content != ''").groupBy("id").count().collect()
    rows = held.collect()
    assert sorted(r["k"] for r in rows) == sorted(r["id"] for r in stored for _ in range(r["count"])) and len(rows) < len({r["k"] for r in rows}) + 4
    assert {r["k"]: r["weight"] for r in rows} == {r["id"]: 1 / r["count"] for r in stored}
    line = pages.each_line(held)
    assert line.count() == sum(len(r["lines"]) for r in rows) > 10 * len(rows) / 2
    one = line.where("k = 'a050' and no >= 0")
    assert one.select("k0").distinct().count() == one.where("first").count() > 4


def test_lines_below_the_least_share_are_left_out_early(corpus):
    """Lines that no host's class can raise to the least share are left out before host classes are joined; all others are as they were."""
    line = pages.lines(corpus.drop("k", "no", "template"), key="id", excerpt="excerpt").cache()
    rows = lambda df: sorted(str((r["k"], r["no"], r["bare"], round(r["template"], 9), round(r["whole"], 9))) for r in df.where(F.col("bare") | (F.col("template") >= pages.OUTSIDE)).collect())
    every, some = pages.judged(line), pages.judged(line, least=pages.OUTSIDE)
    assert rows(every) == rows(some) and some.count() < every.count()


def test_a_beginning_never_hides_an_odd_line():
    """A stored line that is passed over by what stands before its first inner tag isn't odd, nor is a short one."""
    rng = random.Random(8)
    core, other = ["the", "of", "und"], ["vento", "Umbra", "<b>salix</b>", "a<i>b</i>c", "x y", "5 < 6", "<br/>", '<a href="the of the">', "</a>", "\t", "ß"]
    passed = odd = 0
    for _ in range(4000):
        share = rng.choice([0, 0.04, 0.06, 0.3])
        line = rng.choice(["", "<p>", "<div><p>", " ", "<p"]) + " ".join(rng.choice(core if rng.random() < share else other) for _ in range(rng.randint(4, 60)))
        words = " ".join(next(pages.shown_words(line)))
        real = words.count(" ") + 1 >= pages.FILLER_LINE and pages.is_odd(words, frozenset(core))
        may = pages.may_be_odd(line, frozenset(core))
        assert may or not real
        assert pages.holds_odd(f"<p>a</p>\n{line}\nb", frozenset(core)) == real
        passed, odd = passed + (not may), odd + real
    assert passed > 100 and odd > 100
