"""One instant for each record: readings as arrays, the likeliest chain of them by Viterbi over a source's record order.

A source's order is cut into range partitions, so that a source with a third of all rows is many tasks. Each
partition sums up its first and last stretch of one source as a table of best costs between the stretch's first
and last record; these few tables (two a partition) are chained, and with the states so fixed at the edges every
partition finds its own best paths. The result is that of one Viterbi pass over each whole source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyweft.functions.instants import readings
from storyweft.session import cut, width

SWITCH = 1.0  # cost of another format than the record before
BACK = 1.0  # cost of an instant more than SLACK before the record before
SLACK = 2 * 86_400_000_000
SALTS = 16
ROWS = 1_000_000  # records of a range partition at most, about: it is held at once by a task
FORMS = ["epoch", "ymd", "compact", "dmy", "mdy", "slash-mdy", "slash-dmy", "dots"]

Cand = list[tuple[int, int, float]]  # (format, instant, cost) of a record's readings


def _step(before: Cand, now: Cand) -> np.ndarray:
    """Cost of each reading of ``now`` after each of ``before``, the cost of ``now`` included."""
    return np.array([[(SWITCH if f != g else 0.0) + (BACK if u < v - SLACK else 0.0) + c for f, u, c in now] for g, v, _ in before])


def _best(chain: list[Cand], entry: int | None = None, exit_: int | None = None) -> list[int]:
    """Readings of the cheapest path, those at the ends given or free; the first of equal ones."""
    cost = np.array([c for _, _, c in chain[0]])
    if entry is not None:
        cost = np.where(np.arange(len(cost)) == entry, cost, np.inf)
    back = []
    for before, now in zip(chain, chain[1:]):
        total = cost[:, None] + _step(before, now)
        back.append(total.argmin(axis=0))
        cost = total.min(axis=0)
    at = int(cost.argmin()) if exit_ is None else exit_
    path = [at]
    for b in reversed(back):
        path.append(at := int(b[at]))
    return path[::-1]


def _transfer(chain: list[Cand]) -> np.ndarray:
    """Least cost from each reading of the first record to each of the last, that of the first included."""
    total = np.where(np.eye(len(chain[0])) > 0, np.array([c for _, _, c in chain[0]]), np.inf)
    for before, now in zip(chain, chain[1:]):
        total = (total[:, :, None] + _step(before, now)[None]).min(axis=1)
    return total


class _Part:
    """A range partition: sources, readings by offset; ``solve`` gives the place of each record's reading."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        got = [b for b in batches if b.num_rows]
        self.rows = sum(b.num_rows for b in got)
        if not got:
            return
        self.table = table = pa.Table.from_batches(got).combine_chunks()
        col = lambda name: table.column(name).chunk(0)
        self.offset = col("us").offsets.to_numpy().astype(np.int64)
        self.form, self.us, self.cost = (col(x).values.to_numpy() for x in ("form", "us", "cost"))
        source = col("source_id").dictionary_encode()
        code = source.indices.fill_null(-1).to_numpy()
        self.starts = np.r_[np.flatnonzero(np.r_[True, code[1:] != code[:-1]]), self.rows]
        self.many = np.diff(self.offset) > 1
        self.names = source

    def cands(self, i: int) -> Cand:
        a, b = self.offset[i], self.offset[i + 1]
        return list(zip(self.form[a:b].tolist(), self.us[a:b].tolist(), self.cost[a:b].tolist()))

    def source(self, i: int) -> str | None:
        return self.names[i].as_py()

    def stretch(self, lo: int, hi: int) -> tuple[np.ndarray, Cand, Cand]:
        """Summary of the records lo..hi-1 of one source: only stretches of ambiguous records are walked."""
        known = np.flatnonzero(~self.many[lo:hi]) + lo
        first, last = self.cands(lo), self.cands(hi - 1)
        if not len(known):
            return _transfer([self.cands(i) for i in range(lo, hi)]), first, last
        # between the first and the last certain record the cost is the same for all ends
        head = _transfer([self.cands(i) for i in range(lo, known[0] + 1)])
        tail = _transfer([self.cands(i) for i in range(known[-1], hi)])
        return head + tail, first, last

    def solve(self, fixed: dict[int, tuple[int | None, int | None]]) -> np.ndarray:
        pick = np.zeros(self.rows, np.int64)
        for k, (lo, hi) in enumerate(zip(self.starts[:-1], self.starts[1:])):
            if not self.many[lo:hi].any():
                continue
            entry, exit_ = fixed.get(k, (None, None))
            many = np.flatnonzero(self.many[lo:hi]) + lo
            for group in np.split(many, np.flatnonzero(np.diff(many) > 1) + 1):
                a, b = max(lo, group[0] - 1), min(hi - 1, group[-1] + 1)  # with the certain neighbours
                path = _best([self.cands(i) for i in range(a, b + 1)], entry if a == lo else None, exit_ if b == hi - 1 else None)
                pick[a : b + 1] = path
        return pick


def read_instants(entries: DataFrame, sources: DataFrame, key: str = "entry_id", source: str = "source_id", text: str = "published", order: str = "fetched_at", keep: tuple[str, ...] = (), rows: int = ROWS) -> DataFrame:
    """Columns ``key, source, form, utc_us`` and ``keep``: the instant each record's text names.

    ``sources`` has ``id``, ``tz`` and ``edition``. Records with no valid reading are left out: null and blank text, junk,
    impossible dates. A record of an unknown source (or null) is read with no zone and no edition, its own chain being that of
    the source's name. Records follow one another by ``order`` (nulls first), then ``key``; repeated rows come out
    as often as they went in. An empty table gives an empty result. There are as many range partitions as give each about ``rows`` records.
    """
    spark = entries.sparkSession
    known = sources.select(F.col("id").alias("source_id"), "tz", "edition").dropDuplicates(["source_id"])
    base = entries.select(F.col(key).alias("k"), F.col(source).alias("source_id"), F.col(text).alias("t"), F.col(order).alias("o"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)))
    salt = F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int")  # one source may have a third of all records
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = base.withColumn("salt", salt).join(spread, ["source_id", "salt"], "left").select("k", "source_id", "t", "o", "tz", "edition", *(f"keep_{i}" for i in range(len(keep))))
    number = {f: i for i, f in enumerate(FORMS)}
    passed = ["k", "source_id", "o", *(f"keep_{i}" for i in range(len(keep)))]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [readings(*x) for x in zip(batch.column("t").to_pylist(), batch.column("tz").to_pylist(), batch.column("edition").to_pylist())]
            ok = np.flatnonzero([bool(f) for f in found])
            rows = batch.take(pa.array(ok))
            good = [found[i] for i in ok]
            lists = [pa.array([[number[f] for f, _, _ in g] for g in good], pa.list_(pa.int32())), pa.array([[u for _, u, _ in g] for g in good], pa.list_(pa.int64())), pa.array([[c for _, _, c in g] for g in good], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in passed), *lists], names=[*passed, "form", "us", "cost"])

    types = {f.name: f.dataType.simpleString() for f in joined.schema}
    head = ", ".join(f"{c} {types[c]}" for c in passed)
    parsed = joined.mapInArrow(parse, f"{head}, form array<int>, us array<bigint>, cost array<double>")
    ordered = parsed.repartitionByRange(max(width(spark), -(-entries.count() // rows)), "source_id", "o", "k").sortWithinPartitions("source_id", "o", "k")
    ordered = cut(ordered.withColumn("block", F.spark_partition_id()))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _Part(batches)
        if not part.rows:
            return
        block = part.table.column("block")[0].as_py()
        last = len(part.starts) - 2
        for k in sorted({0, last}):
            matrix, first, end = part.stretch(part.starts[k], part.starts[k + 1])
            flat = lambda c, j: [x[j] for x in c]
            yield pa.RecordBatch.from_pylist([{"block": block, "k": k, "last": k == last, "source_id": part.source(int(part.starts[k])), "m": matrix.ravel().tolist(), "f0": flat(first, 0), "u0": flat(first, 1), "c0": flat(first, 2), "f1": flat(end, 0), "u1": flat(end, 1), "c1": flat(end, 2)}], schema=edge)

    edge = pa.schema([("block", pa.int32()), ("k", pa.int32()), ("last", pa.bool_()), ("source_id", pa.string()), ("m", pa.list_(pa.float64())), *((f"{n}{i}", pa.list_(t)) for i in (0, 1) for n, t in (("f", pa.int32()), ("u", pa.int64()), ("c", pa.float64())))])
    names = "block int, k int, last boolean, source_id string, m array<double>, f0 array<int>, u0 array<bigint>, c0 array<double>, f1 array<int>, u1 array<bigint>, c1 array<double>"
    edges = sorted(ordered.mapInArrow(summary, names).collect(), key=lambda r: (r["block"], r["k"]))  # at most two a partition
    shared = spark.sparkContext.broadcast(_chain(edges))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _Part(batches)
        if not part.rows:
            return
        at = part.offset[:-1] + part.solve(shared.value.get(part.table.column("block")[0].as_py(), {}))
        names = pa.array(FORMS).take(pa.array(part.form[at]))
        columns = [part.table.column(c).chunk(0) for c in passed]
        yield pa.RecordBatch.from_arrays([*columns, names, pa.array(part.us[at])], names=[*passed, "form", "utc_us"])

    out = ordered.mapInArrow(choose, f"{head}, form string, utc_us bigint")
    return out.select(F.col("k").alias(key), F.col("source_id").alias(source), "form", "utc_us", *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)))


def _chain(edges: list) -> dict[int, dict[int, tuple[int | None, int | None]]]:
    """The readings at both ends of each stretch that goes on into another partition."""
    fixed: dict[int, dict[int, tuple[int | None, int | None]]] = {}
    run: list = []

    def settle() -> None:
        if len(run) > 1:
            cost, back = None, []
            for before, now in zip([None, *run], run):
                m = np.array(now["m"]).reshape(len(now["f0"]), len(now["f1"]))
                enter = np.zeros(len(now["f0"]))
                if before is not None:
                    c0 = list(zip(now["f0"], now["u0"], now["c0"]))
                    step = cost[:, None] + _step(list(zip(before["f1"], before["u1"], before["c1"])), c0) - np.array(now["c0"])[None]
                    enter, came = step.min(axis=0), step.argmin(axis=0)
                else:
                    came = None
                total = enter[:, None] + m
                back.append((came, total.argmin(axis=0)))
                cost = total.min(axis=0)
            end = int(cost.argmin())
            for now, (came, entry) in zip(reversed(run), reversed(back)):
                start = int(entry[end])
                fixed.setdefault(now["block"], {})[now["k"]] = (start, end)
                end = int(came[start]) if came is not None else -1
        run.clear()

    for e in edges:
        if run and (e["source_id"] != run[-1]["source_id"] or not run[-1]["last"] or e["k"] != 0):
            settle()
        run.append(e)
    settle()
    return fixed


def misdated(items: DataFrame, instants: DataFrame) -> DataFrame:
    """Columns ``id, utc_us``: items whose stored ``published_at`` isn't the instant that their raw entries name.

    ``instants`` has ``source_id, link_hash, utc_us``; entries of an item are those with its feed and url (xxhash64).
    Entries that disagree leave the item out, as do items without one; a null ``published_at`` differs from any instant.
    """
    named = instants.groupBy("source_id", "link_hash").agg(F.min("utc_us").alias("lo"), F.max("utc_us").alias("hi"))
    own = items.select("id", F.col("feed_id").alias("source_id"), F.xxhash64("url").alias("link_hash"), F.unix_micros("published_at").alias("stored"))
    per = own.join(named, ["source_id", "link_hash"]).groupBy("id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max(~F.col("stored").eqNullSafe(F.col("lo"))).alias("differs"))
    return per.where((F.col("lo") == F.col("hi")) & F.col("differs")).select("id", F.col("lo").alias("utc_us"))
