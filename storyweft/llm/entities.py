"""Spellings of one outlet or person: merge and rematch until nothing merges any more.

Each spelling becomes a bag of folded words: case, accents, punctuation, order, articles and web forms out; nicknames
as full names; misspelt or shortened common words (learnt from the names themselves) as those words. Spellings of one bag are one record. Records
match if their bags differ by one slip (a letter dropped, doubled, added, or two swapped) in one seldom word, or if they are
the same without spaces. A record with an initial matches a full one if only one *profile* fits. Merged records are one profile: it has the
spellings and the initials of all of them, so it is blocked anew by what they give together (a name of one spelling and a middle
initial of another answer to both initials), and what were several candidates may have become one. Rounds go on until nothing merges.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyweft.operators.components import components
from storyweft.session import cut

COMMON = 0.002  # share of all spellings from which a word is common, so at most words-per-name / 0.002 are
COMMON_LEAST = 8  # and in so many spellings at least
SLIP_LENGTH = 5  # letters of a word in which a slip may be

# Usual short forms of given names.
NICKNAMES = """
alexander: alex al sandy xander lex; anthony: tony ant; andrew: andy drew; benjamin: ben benny; charles: charlie chuck chas; christopher: chris kit topher;
daniel: dan danny; david: dave davy; deborah: deb debbie; dorothy: dot dotty dottie dolly dora; edward: ed eddie ted teddy ned; elizabeth: liz lizzie beth betty bess eliza libby lisa;
frances: fran fanny frankie francie; francis: frank; frederick: fred freddie; gerald: gerry jerry; gregory: greg; harold: harry hal; henry: hank harry hal; james: jim jimmy jamie;
jennifer: jen jenny; john: jack johnny; jonathan: jon; joseph: joe joey; josephine: jo josie; joshua: josh; katherine: kate kathy katie kat kit kitty kay; lawrence: larry; leonard: len lenny;
margaret: maggie meg peggy marge margie greta daisy; matthew: matt; michael: mike mick mickey mikey; nathaniel: nate nat; nicholas: nick nicky; pamela: pam; patricia: pat patty trish; patrick: paddy pat;
peter: pete; philip: phil pip; rebecca: becky becca; richard: rich rick ricky dick richie; robert: rob bob bobby robbie bert; ronald: ron ronnie; samuel: sam sammy; stephen: steve; susannah: sue susie suzy sukie sukey;
theodora: dora thea teddie theo; theodore: theo ted teddy; thomas: tom tommy; timothy: tim; victoria: vicky tori; walter: walt wally; william: will bill billy willie liam
"""  # fmt: skip
# Usual short forms of words in names of bodies.
SHORT = {"st": "saint", "dept": "department", "dep": "department", "univ": "university", "uni": "university", "intl": "international", "natl": "national", "soc": "society", "assoc": "association", "inst": "institute", "govt": "government", "bros": "brothers", "corp": "corporation"}
DROPPED = {"the", "of", "and", "online", "for", "at", "in"}
DOMAIN = re.compile(r"(?:https?://)?(?:www\.)?([a-z0-9-]+)(?:\.[a-z]{2,})+/?", re.I)

_FULL: dict[str, set[str]] = {}
for _line in NICKNAMES.replace("\n", " ").split(";"):
    _name, _, _nicks = _line.partition(":")
    for _nick in _nicks.split():
        _FULL.setdefault(_nick, set()).add(_name.strip())
NAMES = {n.partition(":")[0].strip() for n in NICKNAMES.replace("\n", " ").split(";")}


def fold(name: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", name.casefold()) if not unicodedata.combining(c))


def name_words(name: str) -> list[str]:
    """Folded words of a spelling; of a web address those of its own label. Apostrophes join, other marks part."""
    folded = fold(name).strip()
    m = DOMAIN.fullmatch(folded)
    if m:
        folded = m.group(1)
    return re.findall(r"[^\W_]+", re.sub(r"['’.](?=\w)(?<=\w.)", "", folded) if not m else folded)


def slips(a: str, b: str) -> bool:
    """Whether two words differ by one letter dropped or added, or by two neighbours swapped."""
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) == len(b):
        return i < len(a) - 1 and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :]
    return len(b) == len(a) + 1 and a[i:] == b[i + 1 :]


def edits(a: str, b: str, most: int) -> int:
    """Edits (swaps count one) between two words, or more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and y == a[i - 2]:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        before, last = last, row
    return last[-1]


def _within(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


class Lexicon:
    """Common words with the number of spellings they are in; maps misspelt and shortened words to them."""

    def __init__(self, common: dict[str, int]):
        self.common = common
        self.known: dict[tuple[str, int], str] = {}

    def word(self, w: str, count: int) -> str:
        """The common word that ``w``, in ``count`` spellings, stands for; ``w`` itself if there is none or several."""
        if (w, count) not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[w, count] = self._word(w, count)
        return self.known[w, count]

    def _word(self, w: str, count: int) -> str:
        if w in SHORT:
            return SHORT[w]
        if w in _FULL and len(_FULL[w]) == 1:
            return next(iter(_FULL[w]))
        if w in NAMES or w in _FULL or len(w) < 3:
            return w
        if len(w) <= 5:
            full = [c for c, n in self.common.items() if len(c) > len(w) + 1 and c not in NAMES and c[0] == w[0] and 3 * count <= n and _within(w, c)]
            start = [c for c in full if c.startswith(w)]
            if len(full) == 1 or len(start) == 1:
                return (full if len(full) == 1 else start)[0]
        if len(w) >= 5:
            near = sorted((edits(w, c, 2), c) for c, n in self.common.items() if c[0] == w[0] and len(c) >= 6 and abs(len(c) - len(w)) < 3 and 3 * count <= n)
            near = [x for x in near if x[0] <= (2 if len(x[1]) >= 7 else 1)]
            if near and (len(near) == 1 or near[1][0] > near[0][0]):
                return near[0][1]
            longer = [c for c, n in self.common.items() if len(c) >= 4 and len(w) > len(c) + 2 and w.startswith(c) and c not in NAMES and 3 * count <= n]
            if len(longer) == 1:  # a common word drawn out, as in News and Newsletter
                return longer[0]
        return w


def _bag(words: list[str], lexicon: Lexicon, counts: dict[str, int]) -> list[str]:
    kept = [w for w in words if w not in DROPPED] or words
    out = [lexicon.word(w, counts.get(w, 0)) for w in kept]
    full = [w for w in out if len(w) > 1]
    return sorted(full if len(full) > 1 else out)  # a middle initial goes


def _open(w: str) -> bool:
    """Whether a word may stand for several: an initial, a nickname of several names, a short form that isn't settled."""
    return len(w) == 1 or w in _FULL or (len(w) <= 3 and w.isalpha() and w not in NAMES)


def _variants(words: list[str], lexicon: Lexicon) -> Iterator[str]:
    """Keys of a bag of words: all of them, and for each seldom long word the others with it less a letter."""
    yield "|".join(sorted(words))
    for i, w in enumerate(words):
        if len(w) >= SLIP_LENGTH and w not in lexicon.common and w not in NAMES:
            rest = words[:i] + words[i + 1 :]
            for k in {w, *(w[:j] + w[j + 1 :] for j in range(len(w)))}:
                yield "|".join(sorted(rest)) + "~" + k


def _alike(bag: list[str], plain: list[list[str]], lexicon: Lexicon) -> Iterator[tuple[str, int]]:
    """Keys of records that may be alike as they are (0), and without spaces (3)."""
    for words in plain:
        yield "=" + "".join(words), 3
    for v in _variants(bag, lexicon):
        yield v, 0


def _asked(bag: list[str], lexicon: Lexicon) -> Iterator[tuple[str, bool]]:
    """Keys by which a form with an open word asks for full ones, and those, true, of a form with several initials."""
    letters = [w for w in bag if _open(w)]
    long = [w for w in bag if w not in letters]
    if len(letters) == 1 and long:
        for v in _variants(long, lexicon):
            for full in sorted(_FULL.get(letters[0], letters[0][0])):
                yield f"{full}.{v}", False
    elif len(letters) > 1 and long and all(len(w) == 1 for w in letters):
        yield f"{'.'.join(sorted(letters))}.{'|'.join(sorted(long))}", True


def _offered(bag: list[str], initials: list[str], lexicon: Lexicon) -> Iterator[tuple[str, bool]]:
    """Keys by which a full form answers, given the initials that any spelling of its profile has besides."""
    if len(bag) < 2 or any(_open(w) for w in bag):
        return
    for i, w in enumerate(bag):  # each word may stand as an initial
        rest = bag[:i] + bag[i + 1 :]
        for v in _variants(rest, lexicon):
            yield f"{w[0]}.{v}", False
            if w in NAMES:
                yield f"{w}.{v}", False
        for x in initials:
            yield f"{'.'.join(sorted((w[0], x)))}.{'|'.join(sorted(rest))}", True
        for j in range(i):
            if len(bag) > 2:
                yield f"{'.'.join(sorted((w[0], bag[j][0])))}.{'|'.join(sorted(bag[:j] + bag[j + 1 : i] + bag[i + 1 :]))}", True


def _one_slip(a: list[str], b: list[str]) -> bool:
    """Whether bags are equal, or but for one pair of words that a slip parts."""
    x, y = list(a), list(b)
    for w in list(x):
        if w in y:
            x.remove(w)
            y.remove(w)
    return not x and not y or len(x) == len(y) == 1 and min(len(x[0]), len(y[0])) >= SLIP_LENGTH - 1 and slips(x[0], y[0])


def spellings(names: DataFrame, name: str = "name") -> DataFrame:
    """Columns ``name, entity``: each distinct spelling with the number of the outlet or person it names.

    Null and blank names are left out. A name of which no other spelling is found is an entity of its own. Of two profiles
    that an initial fits neither is taken. Repeated rows change nothing, other columns are not read, an empty table
    gives an empty result.
    """
    distinct = cut(names.select(F.col(name).alias("name")).where("trim(name) != ''").distinct())

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(words=pdf["name"].map(name_words))

    worded = cut(distinct.mapInPandas(split, "name string, words array<string>").where("size(words) > 0"))
    total = worded.count()
    in_names = worded.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("held"))
    # bounded: a name has few words, so few can be in COMMON of all names
    common = {r["word"]: r["held"] for r in in_names.where((F.col("held") >= COMMON_LEAST) & (F.col("held") >= COMMON * total)).collect() if len(r["word"]) > 3 and r["word"] not in DROPPED}
    shared = names.sparkSession.sparkContext.broadcast(common)
    # seldom words' counts come with the rows
    counted = worded.select("name", "words", F.posexplode("words").alias("pos", "word")).join(in_names, "word").groupBy("name").agg(F.first("words").alias("words"), F.map_from_entries(F.collect_set(F.struct("word", "held"))).alias("held"))

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(shared.value)
        for pdf in batches:
            rows = []
            for n, words, held in zip(pdf["name"], pdf["words"], pdf["held"]):
                words = list(words)
                rows.append((n, _bag(words, lexicon, dict(held)), words))
            yield pd.DataFrame(rows, columns=["name", "bag", "plain"])

    bagged = counted.mapInPandas(bags, "name string, bag array<string>, plain array<string>")
    bagged = cut(bagged.withColumn("id", F.xxhash64(F.concat_ws("|", "bag"), F.lit(3))))
    # plain forms that one bag can have are few: words in some order, short or full
    records = cut(bagged.groupBy("id").agg(F.first("bag").alias("bag"), F.collect_set("plain").alias("plain")))

    schema = "key string, {} , id bigint, bag array<string>"

    def keyed(make, kind: str, columns: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lexicon = Lexicon(shared.value)
            for pdf in batches:
                rows = [(k, x, row[0], list(row[1])) for row in pdf[columns].itertuples(index=False) for k, x in set(make(lexicon, *row[1:]))]
                yield pd.DataFrame(rows, columns=["key", kind.split()[0], "id", "bag"])

        return lambda df: df.select(*columns).mapInPandas(run, schema.format(kind)).withColumn("key", F.xxhash64("key"))

    def alike(lexicon, bag, plain):
        lists = [list(p) for p in plain]
        return _alike(list(bag), lists + [[w for w in p if w not in DROPPED] for p in lists], lexicon)

    keys = cut(keyed(alike, "kind int", ["id", "bag", "plain"])(records))
    one_slip = F.udf(lambda a, b: _one_slip(list(a), list(b)), "boolean", useArrow=True)
    same = keys.where("kind = 0")
    left, right = same.select("key", F.col("id").alias("a"), F.col("bag").alias("ba")), same.select("key", F.col("id").alias("b"), F.col("bag").alias("bb"))
    # a key holds all words but one, and that less a letter: so few bags have it as there are letters to put back
    pairs = left.join(right, "key").where("a < b").select("a", "b", "ba", "bb").distinct()
    glued = keys.where("kind = 3")
    first = glued.groupBy("key").agg(F.min("id").alias("a"))
    edges = pairs.where(one_slip("ba", "bb")).select("a", "b").unionByName(glued.join(first, "key").where("id != a").select("a", F.col("id").alias("b")))
    settled = cut(records.select(F.col("id").alias("node")).join(components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("component")))

    fits = F.udf(lambda a, b: _fits(list(a), list(b)), "boolean", useArrow=True)
    asked = cut(keyed(lambda lexicon, bag: _asked(list(bag), lexicon), "several boolean", ["id", "bag"])(records).select("key", "several", F.col("id").alias("a"), F.col("bag").alias("ba")))
    offer = keyed(lambda lexicon, bag, initials: _offered(list(bag), list(initials), lexicon), "several boolean", ["id", "bag", "initials"])
    own = cut(records.join(settled, F.col("id") == F.col("node")).select("id", "bag", "component", F.array_distinct(F.filter(F.flatten("plain"), lambda w: (F.length(w) == 1) & ~w.rlike("[0-9]"))).alias("letters")))
    fitting = None
    changed = settled.select("component").distinct()
    while True:  # each further round joins two profiles at least
        # profiles that have grown are blocked anew, each record with the initials of all; letters are few
        united = own.join(changed, "component", "left_semi").groupBy("component").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("letters")))).alias("initials"))
        offered = offer(own.join(united, "component")).select("key", "several", F.col("id").alias("b"), F.col("bag").alias("bb"))
        met = asked.join(offered, ["key", "several"]).select("a", "b", "several", "ba", "bb").distinct().where(F.col("several") | fits("ba", "bb")).select("a", "b")
        fitting = cut(met if fitting is None else fitting.unionByName(met).distinct())
        at = own.select("id", "component")
        sides = fitting.join(at.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b").join(at.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a")
        # an initial is taken where all full forms that it fits are one profile by now
        more = cut(sides.groupBy("ca").agg(F.min("cb").alias("lo"), F.max("cb").alias("hi")).where("lo = hi and lo != ca").select(F.col("ca").alias("a"), F.col("lo").alias("b")))
        if not more.limit(1).count():
            break
        moved = cut(components(more))
        own = cut(own.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("id", "bag", F.coalesce("to", "component").alias("component"), "letters"))
        changed = moved.select("component").distinct()
    return bagged.join(own.select("id", F.col("component").alias("entity")), "id").select("name", "entity")


def _fits(a: list[str], b: list[str]) -> bool:
    """Whether bag a, with one open word, is bag b with one word so shortened, up to one slip in the rest."""
    letter = next(w for w in a if _open(w))
    rest = [w for w in a if w != letter]
    return any((w in _FULL[letter] if letter in _FULL else len(w) > len(letter) and w[0] == letter[0] and _within(letter, w)) and _one_slip(rest, b[:i] + b[i + 1 :]) for i, w in enumerate(b))


def spelling_pairs(names: DataFrame, name: str = "name") -> DataFrame:
    """Columns ``publisher_a, publisher_b`` (a < b): :func:`spellings` written out as all pairs of different spellings of one entity, which only a report needs."""
    one = cut(spellings(names, name))
    a, b = one.select("entity", F.col("name").alias("publisher_a")), one.select("entity", F.col("name").alias("publisher_b"))
    return a.join(b, "entity").where("publisher_a < publisher_b").select("publisher_a", "publisher_b")
