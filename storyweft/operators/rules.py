"""Rules as data: multi-label classification, ordered first match, flags with guards and rescues, publisher tiers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyweft.functions.text import publisher_key


@dataclass(frozen=True)
class Rule:
    """A label and when it holds: ``match`` but not ``unless``, which ``override`` voids."""

    label: str
    match: str
    unless: str | None = None
    override: str | None = None

    def column(self, text: Column) -> Column:
        hit = text.rlike(ci(self.match))
        if self.unless:
            guard = text.rlike(ci(self.unless))
            hit = hit & ~(guard & ~text.rlike(ci(self.override)) if self.override else guard)
        return F.coalesce(hit, F.lit(False))


def ci(pattern: str) -> str:
    """A pattern without regard to case, for all scripts."""
    return pattern if pattern.startswith("(?") and "i" in pattern[:5] else f"(?iu){pattern}"


def words(*terms: str) -> str:
    """Any of the terms as whole words."""
    return r"\b(?:" + "|".join(terms) + r")\b"


def near(a: str, b: str, most: int = 40) -> str:
    """Two patterns in either order with at most so many characters, and no full stop, between them."""
    return rf"(?:{a})[^.]{{0,{most}}}(?:{b})|(?:{b})[^.]{{0,{most}}}(?:{a})"


def labels(text: Column, rules: list[Rule]) -> Column:
    """Labels of all rules that hold, in the rules' order, each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(r.column(text), F.lit(r.label)) for r in rules)))) if rules else F.array().cast("array<string>")


def first_match(text: Column, rules: list[Rule], default: str | None = None) -> Column:
    """Label of the first rule that holds."""
    return F.coalesce(*(F.when(r.column(text), F.lit(r.label)) for r in rules), F.lit(default))


def any_of(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found; false for null."""
    return F.coalesce(reduce(or_, (text.rlike(ci(p)) for p in patterns), F.lit(False)), F.lit(False))


def cleared(text: Column, clear: str, patterns: list[str]) -> Column:
    """Whether any pattern is found and what clears the text isn't."""
    return ~F.coalesce(text.rlike(ci(clear)), F.lit(False)) & any_of(text, patterns)


def rescued(text: Column, match: str, rescue: str, hard: str | None = None) -> Column:
    """Whether the pattern is found, unless a rescue is found as well; hard cases aren't rescued."""
    saved = F.coalesce(text.rlike(ci(rescue)), F.lit(False))
    if hard:
        saved = saved & ~F.coalesce(text.rlike(ci(hard)), F.lit(False))
    return F.coalesce(text.rlike(ci(match)), F.lit(False)) & ~saved


# A lexicon of this engine's own, over the vocabulary of strange-news headlines; rules are free of lookaround.
TOPIC_RULES = [
    Rule("ufo", words("ufos?", "discs?", "orbs?", "craft", "flying saucers?", "lights", "drones?", "radar")),
    Rule("ghosts", words("ghosts?", "apparitions?", "haunt(?:ed|ing|ings)", "poltergeists?", "figures?"), unless=words("ghost tours?")),
    Rule("cryptids", words("beasts?", "creatures?", "footprints?", "tracks", "bigfoot")),
    Rule("fortean", words("curse", "vanish(?:ed|es)", "villagers", "humming", "unaided")),
    Rule("temporal", near(words("hours", "minutes"), words("lost", "vanished", "missing"))),
    Rule("archaeology", words("dig", "uncovers", "carvings?", "idols?", "ruins", "wall"), unless=words("lie detector"), override=words("dig")),
    Rule("ooparts", near(words("museum", "curator"), words("pulled", "tape", "shows"), 60)),
    Rule("science", words("scientists?", "laborator(?:y|ies)", "samples?", "tests?", "experts?")),
]
FLAG_RULES = {
    "entertainment": [words("films? festival", "box office", "trailer", "episode", "novel")],
    "offbeat": [words("lie detector", "weather balloon", "hoax")],
    "attraction": [words("ghost tours?", "haunted house tickets")],
    "roundup": [r"^(?:top|best) [0-9]{1,2}\b", r"(^|[^0-9,])[0-9]{1,2} (?:places|sights|tales)\b"],
    "notice": [words("letters:", "webinar", "call for papers", "tickets")],
}


# Serial fiction and its followers, which no reading makes news.
OFF_TOPIC = [r"\b(anime|manga|isekai|manhwa|webtoon|light novel|k-?drama|episode [0-9]+|ep\.? ?[0-9]+|chapter [0-9]+|season [0-9]+ episode)\b"]


def classify_flags(title: Column) -> Column:
    """Flags of a headline in a fixed order."""
    gathering = rescued(title, words("fair", "festival", "convention", "club"), words("police", "constable", "inquest"), hard=words("expo"))
    found = {k: any_of(title, v) for k, v in FLAG_RULES.items() if k != "roundup"}
    found["roundup"] = cleared(title, words("confirms", "reopens"), FLAG_RULES["roundup"])
    found["gathering"] = gathering
    order = ["entertainment", "offbeat", "attraction", "gathering", "roundup", "notice"]
    return F.array_compact(F.array(*(F.when(found[k], F.lit(k)) for k in order)))


def compute_flags(title: Column, publisher_flag: Column, names_nothing: Column) -> Column:
    """Flags of headline, publisher and missing topics together, sorted, each once."""
    return F.array_sort(F.array_distinct(F.concat(classify_flags(title), F.array_compact(F.array(F.when(publisher_flag, F.lit("entertainment")), F.when(names_nothing, F.lit("weak-match")))))))


def publisher_tier(df: DataFrame, publisher: str, exact: DataFrame, patterns: list[Rule], default: str = "genre", out: str = "tier") -> DataFrame:
    """``df`` with the tier of its publisher: by exact key, else the first pattern that holds, else the default.

    ``exact`` has ``publisher_key, tier``; of several rows of a key the last by tier order counts. Null publishers get the default.
    """
    lookup = exact.groupBy("publisher_key").agg(F.max("tier").alias("__exact"))
    keyed = df.withColumn("__key", publisher_key(F.col(publisher)))
    joined = keyed.join(lookup.withColumnRenamed("publisher_key", "__key"), "__key", "left")
    return joined.withColumn(out, F.coalesce("__exact", first_match(F.col(publisher), patterns), F.lit(default))).drop("__key", "__exact")


def publisher_in(df: DataFrame, publisher: str, keys: DataFrame | None, patterns: tuple[str, ...] = (), out: str = "listed") -> DataFrame:
    """``df`` with whether its publisher is listed: by exact key (``publisher_key`` of ``keys``) or by a pattern; false for null."""
    named = any_of(F.col(publisher), list(patterns))
    if keys is None:
        return df.withColumn(out, named)
    listed = keys.select(F.col("publisher_key").alias("__key")).distinct().withColumn("__listed", F.lit(True))
    return df.withColumn("__key", publisher_key(F.col(publisher))).join(listed, "__key", "left").withColumn(out, F.coalesce("__listed", F.lit(False)) | named).drop("__key", "__listed")
