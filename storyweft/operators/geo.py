"""Places of headlines: a gazetteer by precedence, candidate names, longest prefix, datelines, pins that don't overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyweft.operators.rules import Rule, words
from storyweft.schema import PLACE_KINDS, ordinal

NAME = r"\p{Lu}[\w'’.-]*"
RUN = rf"{NAME}(?:\s+(?:(?:of|de|upon|on|the)\s+)?{NAME}){{0,3}}"
PLAIN = r"\p{Lu}[\w.-]*"  # without apostrophes, which a possessive begins with
BEAT = r"(?:bigfoot|sasquatch|yeti|ufos?|uaps?|ghosts?|haunt\w*|poltergeist|monster|beast|creature|cryptid|sighting|encounter|mystery|lights?|residents|mill|villagers)"
EXTRACTORS = [
    rf"\b(?:in|over|above|near|at|across|around|outside|off|through|along|beneath|under|from|of|to|past|beside)\s+(?:the\s+)?({RUN})",
    rf"({RUN}),\s*({RUN})",
    rf"^((?:{PLAIN}\s+){{0,2}}{PLAIN})(?:['’]s)?\s+(?i:{BEAT})\b",
    rf"\b((?:{PLAIN}\s+){{0,2}}{PLAIN})['’]s\s+(?i:{BEAT})\b",
]
PAIR = 1  # the extractor whose second name must be a place as well
# A headline reports something that happened, and isn't about a body that carries a place's name, nor a review.
EVENT = r"(?i)\b(?:sight(?:ing|ed|ings)|spotted|seen|saw|witness\w*|encounter\w*|filmed|footage|reported|reports?|appear(?:s|ed)|hover\w*|flew|flying|crash\w*|land(?:s|ed|ing)|tracks?|tracked|prints?|footprints?|growls?|creature|craft|object|orbs?|lights?|figure|monster|beast|beam|discs?|haunt\w*|apparition|found|discovered|uncovers|hunts?|search\w*|investigat\w+|claims?|debris|villagers|radar|returns?|rose|vanish\w*|ring)\b"
BODY = r"(?i)\b(?:daily record|gazette|herald|tribune|chronicle|sentinel|dispatch|university|college|institute|society|association|library|airport|police department|fire department|congress|parliament)\b"
CRITICISM = r"(?i)\b(?:debunk\w*|skeptics?|sceptics?|hoax(?:es|ed)?|starring|recap)\b|\breview\b\s*[–—|:-]|[–—|]\s*review\b"
MISLEADING = ["may", "march", "august", "orb", "drone", "mercury", "reading", "nice"]


def gazetteer(countries: DataFrame, cities: DataFrame, curated: DataFrame, large: int = 12_000, small: int = 40_000, near: tuple[str, ...] = ("US", "GB", "CA", "AU", "IE", "NZ")) -> DataFrame:
    """Places by lower-case name: curated ones first, else the lowest kind, else the first by sequence.

    ``countries`` (name, code, lat, lon), ``cities`` (name, country, admin, population, lat, lon), ``curated`` (PLACE). Regions are
    the means of all their cities, weighted by population, before the small ones are dropped; without people there is none.
    """
    region = cities.where("admin is not null").groupBy("country", "admin").agg(
        F.sum(F.col("lat") * F.col("population")).alias("la"), F.sum(F.col("lon") * F.col("population")).alias("lo"), F.sum("population").alias("people")
    ).where("people > 0")
    rows = [
        curated.select("name", "lat", "lon", "kind", "admin", "country", F.lit(-1).alias("seq")),
        cities.where(F.col("population") >= F.when(F.col("country").isin(*near), large).otherwise(small)).select("name", "lat", "lon", F.lit("city").alias("kind"), "admin", "country", (-F.col("population")).cast("int").alias("seq")),
        region.select(F.col("admin").alias("name"), (F.col("la") / F.col("people")).alias("lat"), (F.col("lo") / F.col("people")).alias("lon"), F.lit("region").alias("kind"), F.lit(None).cast("string").alias("admin"), "country", F.lit(0).alias("seq")),
        countries.select("name", "lat", "lon", F.lit("country").alias("kind"), F.lit(None).cast("string").alias("admin"), F.col("code").alias("country"), F.lit(0).alias("seq")),
    ]
    union = rows[0].withColumn("own", F.lit(0))
    for r in rows[1:]:
        union = union.unionByName(r.withColumn("own", F.lit(1)))
    return precedence(union, F.lower("name"), [F.col("own"), ordinal(F.col("kind"), PLACE_KINDS), F.col("seq"), F.col("country"), F.col("lat")]).drop("own", "seq")


def precedence(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key by an order, combined before the shuffle; ``key`` is added."""
    columns = df.columns
    best = df.withColumn("key", key).where("key is not null").groupBy("key").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("x"))
    return best.select("key", "x.*")


def candidates(df: DataFrame, title: str = "title") -> DataFrame:
    """``df`` with a row for each candidate name of its headline: ``extractor``, ``place_at``, ``run``, and ``beside``, the name that must be a place too."""

    def by(extractor: int, pattern: str) -> Column:
        of = lambda group: F.regexp_extract_all(F.col(title), F.lit(pattern), F.lit(group))
        second = of(2) if extractor == PAIR else F.array().cast("array<string>")
        return F.transform(F.arrays_zip(of(1).alias("run"), second.alias("beside")), lambda x: F.struct(F.lit(extractor).alias("extractor"), x["run"].alias("run"), x["beside"].alias("beside")))

    found = [by(k, p) for k, p in enumerate(EXTRACTORS)]
    return df.select("*", F.posexplode(F.concat(*found)).alias("place_at", "__c")).select("*", "__c.extractor", "__c.run", "__c.beside").drop("__c")


def resolve(runs: DataFrame, places: DataFrame, keys: list[str], run: str = "run") -> DataFrame:
    """``keys`` with the place that the longest prefix of four words or fewer of ``run`` names; runs without one are left out.

    ``places`` has ``key`` (lower case). Prefixes are joined by equality.
    """
    parts = F.split(F.regexp_replace(F.col(run), r"[\s,;:.!?'’-]+\z", ""), r"\s+")
    prefix = runs.select(*keys, F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.size(parts))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, 1, n), " ").alias("matched")))).alias("p")).select(*keys, "p.n", "p.matched", F.lower("p.matched").alias("key"))
    prefix = prefix.where(~F.col("key").isin(*MISLEADING))
    fields = ["name", "lat", "lon", "kind", "admin", "country"]
    met = prefix.join(places.select("key", *fields), "key")
    return met.groupBy(*keys).agg(F.max_by(F.struct("matched", *fields), "n").alias("x")).select(*keys, "x.*")


def locate(df: DataFrame, places: DataFrame, key: str = "id", title: str = "title", body: str | None = None, implied: list[Rule] | None = None) -> DataFrame:
    """Columns ``key, name, admin, lat, lon, kind, matched, provenance``: where each headline is, if anywhere.

    Of the candidates of a headline that reports an event the one of the lowest kind, the first of equal ones; else the place that the
    first of the ``implied`` rules names; else the dateline of the body. A criticism of a report has no place; the name of a
    body says nothing of one.
    """
    text = F.col(title)
    critic, body_name = F.coalesce(text.rlike(CRITICISM), F.lit(False)), F.coalesce(text.rlike(BODY), F.lit(False))
    base = df.where(~critic)
    event = base.where(F.coalesce(text.rlike(EVENT), F.lit(False)) & ~body_name)
    runs = candidates(event.select(key, title), title)
    keys = [key, "extractor", "place_at"]
    met = resolve(runs.select(*keys, "run"), places, keys)
    # of a pair the first counts if both are places, and it is no country
    beside = resolve(runs.where("beside is not null").select(*keys, F.col("beside").alias("run")), places, keys).select(*keys, F.lit(True).alias("__both"))
    met = met.join(beside, keys, "left").where((F.col("extractor") != PAIR) | (F.coalesce("__both", F.lit(False)) & (F.col("kind") != "country"))).drop("__both")
    shape = lambda: F.struct("name", "admin", "lat", "lon", "kind", "matched")
    head = met.groupBy(key).agg(F.min_by(shape(), F.struct(ordinal(F.col("kind"), PLACE_KINDS).alias("k"), "extractor", "place_at")).alias("x")).select(key, "x.*", F.lit("headline").alias("provenance"), F.lit(0).alias("way"))
    out = head
    if implied:
        from storyweft.operators.rules import first_match

        said = base.where(~body_name).select(key, F.lower(first_match(text, implied)).alias("key")).where("key is not null")
        out = out.unionByName(said.join(places, "key").select(key, "name", "admin", "lat", "lon", "kind", F.col("name").alias("matched"), F.lit("implied").alias("provenance"), F.lit(1).alias("way")))
    if body:
        opening = F.left(F.regexp_replace(F.col(body), "<[^>]+>", " "), F.lit(160))
        pattern = r"^\s*([A-Z][A-Z .'-]+)(?:,\s+([A-Z][\w .]+?))?\s*(?:\([A-Z][\w ./]*\))?\s*[—–-]\s"
        city, region = F.initcap(F.lower(F.trim(F.regexp_extract(opening, pattern, 1)))), F.trim(F.regexp_extract(opening, pattern, 2))
        lines = base.select(key, F.posexplode(F.array(city, region)).alias("o", "n")).where("n is not null and n != ''").select(key, "o", F.lower("n").alias("key"))
        placed = lines.join(places, "key").groupBy(key).agg(F.min_by(F.struct("name", "admin", "lat", "lon", "kind"), "o").alias("x"))
        out = out.unionByName(placed.select(key, "x.*", F.col("x.name").alias("matched"), F.lit("dateline").alias("provenance"), F.lit(2).alias("way")))
    best = out.groupBy(key).agg(F.min_by(F.struct("name", "admin", "lat", "lon", "kind", "matched", "provenance"), "way").alias("x"))
    return best.select(key, "x.*")


def sighting_report(title: Column, flags: Column) -> Column:
    """Whether a headline reports an event rather than announces, lists or reviews one."""
    demoted = F.coalesce(F.arrays_overlap(flags, F.lit(["attraction", "gathering", "roundup", "notice"])), F.lit(False))
    return ~demoted & ~F.coalesce(title.rlike(r"(?i)" + words("letters", "museum", "inquest", "council", "exhibition", "anniversary")), F.lit(False))


def spread_pins(df: DataFrame, order: list[Column], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``df`` with ``pin_lat, pin_lon``: the nth pin of a spot (three decimals) is moved out on a spiral."""
    w = Window.partitionBy(F.round(lat, 3), F.round(lon, 3)).orderBy(*order)
    n = F.row_number().over(w) - 1
    angle, radius = F.pmod(n * 2.4, F.lit(6.283185307179586)), 0.05 + 0.012 * n
    moved = df.withColumn("__n", n)
    angle, radius = F.pmod(F.col("__n") * 2.4, F.lit(6.283185307179586)), 0.05 + 0.012 * F.col("__n")
    first = F.col("__n") == 0
    return moved.withColumn("pin_lat", F.round(F.when(first, F.col(lat)).otherwise(F.col(lat) + radius * F.sin(angle)), 6)).withColumn("pin_lon", F.round(F.when(first, F.col(lon)).otherwise(F.col(lon) + radius * F.cos(angle)), 6)).drop("__n")


def pin_style(df: DataFrame, precision: str = "precision") -> DataFrame:
    """``df`` with ``radius`` and ``heat`` of its pins: the vaguer the place, the larger and fainter."""
    p = F.col(precision)
    return df.withColumn("radius", F.when(p.isin("landmark", "city"), 6).when(p == "region", 8).otherwise(10)).withColumn("heat", F.when(p == "country", 0.35).otherwise(1.0))
