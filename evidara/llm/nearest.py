"""Problem 6: near-duplicate records found by multi-index hashing of fingerprints.

A record is a set of units (word or character n-grams). Its fingerprint has SEGMENTS x WIDTH symbols of 16 bits, each the
least value of one hash function over the record's units (min-wise hashing), so two records agree in a symbol as often
as their sets overlap. Each segment is one index: for every record, the ball of Hamming radius 1 around the segment is
enumerated (one entry for each symbol left out), equal entries are fetched, and the distances of sketches of all units (where
they are met) and of the whole fingerprints decide which pairs are verified exactly. Bits instead of symbols can't work at a similarity of 0.6: a pair then differs
in 23 % of the bits and a random pair in 50 %, and balls of that radius hold most of the table.

Units that very many records hold (a host's URLs, frequent syllables) would make entries of whole hosts, so each record
leaves its commonest units out, but never more than TRIMMED of its units: what the members of a large group of near copies
share is common as well, and at least half of it stays. The counts are exact sums over all records, alike for any batch or
partition. The exact verification counts all units.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.llm.components import group_linked
from evidara.plans.lineage import Scratch

SEGMENTS, WIDTH = 8, 4
#: Least number of equal symbols: 1.4 standard deviations under the mean of a pair whose remaining units overlap by a third,
#: the least a pair at 0.6 can keep, and 3 of one whose units overlap by 0.45.
LEAST_EQUAL = 7
#: Bits of a record's sketch of all its units. A pair is ruled out above the mean of a pair at the threshold by this many times
#: a bound of the standard deviation: 4.4 deviations or more, and none of 100,000 such pairs of 20 to 400 units each.
BITS, SIGMAS = 256, 4
#: Units that occur more often than in this share of the records are common; the most of its units a record leaves out.
COMMON, TRIMMED = 0.005, 0.5
#: Entries of the index held by more records than this are split over tasks.
HOT = 2000
#: A unit that occurs no more often than this is never common: groups of near-duplicates share such units.
NEVER_COMMON = 100
#: Counts of units are kept for this many hash buckets; the table's size doesn't depend on the records.
BUCKETS = 1 << 20
#: Ids up to this number (some 50 MB) are broadcast.
SENT = 1_000_000
#: Characters handled at once in a worker.
AT_ONCE = 4_000_000
_WORD = re.compile(r"[^\W_]+")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _is_word() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a 0 after each; the record of each point."""
    flat = np.frombuffer(("\0".join(t.replace("\0", " ") for t in texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return flat, np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))


def word_units(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit, record) for every ``n`` consecutive words; a word is a longest run of letters and digits."""
    flat, record = _points(texts)
    inside = _is_word()[flat]
    begins = inside & ~np.concatenate(([False], inside[:-1]))
    at = np.flatnonzero(inside)
    if not at.size:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.flatnonzero(begins[at])
    place = np.arange(at.size) - np.repeat(first, np.diff(np.append(first, at.size)))
    powers = np.cumprod(np.concatenate(([1], np.full(place.max(), 0x9E3779B97F4A7C15, np.uint64))).astype(np.uint64))
    words = _mix(np.add.reduceat(_mix(flat[at].astype(np.uint64) + np.uint64(1)) * powers[place], first))
    of = record[at[first]]
    return _ngrams(words, of, n)


def char_units(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit, record) for every ``n`` consecutive characters."""
    flat, record = _points(texts)
    keep = np.ones(flat.size, bool)
    keep[np.cumsum([len(t) + 1 for t in texts]) - 1] = False
    return _ngrams(_mix(flat[keep].astype(np.uint64) + np.uint64(1)), record[keep], n)


def _ngrams(items: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    count = items.size - n + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    gram = np.zeros(count, np.uint64)
    for k in range(n):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + items[k : k + count]
    whole = of[:count] == of[n - 1 :]
    return _mix(gram[whole]), of[:count][whole]


class Units:
    """What a record's units are: ``n`` words or characters of its lower-cased text."""

    def __init__(self, kind: str, n: int) -> None:
        self.kind, self.n = kind, n

    def hashed(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return (word_units if self.kind == "words" else char_units)(texts, self.n)

    def overlaps(self, a: pd.Series, b: pd.Series) -> np.ndarray:
        """For each pair of texts the units in both over the units in either, units told by their 64-bit hashes."""
        number, texts = pd.factorize(pd.concat([a, b], ignore_index=True))
        sets: list[np.ndarray] = []
        for _, run in _parts(pd.Series(texts)):
            unit, of = self.hashed(run)
            order = np.lexsort((unit, of))
            unit, of = unit[order], of[order]
            once = np.ones(unit.size, bool)
            once[1:] = (unit[1:] != unit[:-1]) | (of[1:] != of[:-1])
            sets += np.split(unit[once], np.cumsum(np.bincount(of[once], minlength=len(run)))[:-1])
        out = np.empty(len(a))
        for k, (i, j) in enumerate(zip(number[: len(a)], number[len(a) :], strict=True)):
            both = np.sort(np.concatenate((sets[i], sets[j])))
            same = int(np.count_nonzero(both[1:] == both[:-1]))
            out[k] = same / max(1, both.size - same)
        return out

    def exact(self, text: str) -> set:
        items = _WORD.findall(text) if self.kind == "words" else text
        return {tuple(items[i : i + self.n]) for i in range(len(items) - self.n + 1)} if self.kind == "words" else {text[i : i + self.n] for i in range(len(text) - self.n + 1)}


def _parts(texts: pd.Series) -> Iterator[tuple[int, list[str]]]:
    """The texts, lower-cased, in runs of at most AT_ONCE characters (a longer text comes alone)."""
    start, run, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t.lower()
        if run and size + len(t) > AT_ONCE:
            yield start, run
            start, run, size = i, [], 0
        run.append(t)
        size += len(t)
    if run:
        yield start, run


def _bucket(unit: np.ndarray) -> np.ndarray:
    return (unit >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)


def commonness(records: DataFrame, units: Units) -> np.ndarray:
    """For each hash bucket of units how common it is: 0 if it occurs no more than NEVER_COMMON times or no more often than
    in COMMON of the records, else a step of a logarithmic scale.

    Every task sums its records into one table of fixed size; the sums are exact however the rows are batched.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            table[BUCKETS] += len(b)
            for _, run in _parts(b["text"]):
                table[:BUCKETS] += np.bincount(_bucket(units.hashed(run)[0]), minlength=BUCKETS)
        full = np.flatnonzero(table)
        yield pd.DataFrame({"bucket": full, "n": table[full]})

    sums = records.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = sums.where((F.col("n") > NEVER_COMMON) | (F.col("bucket") == BUCKETS)).toPandas()
    total = got.loc[got["bucket"] == BUCKETS, "n"].sum()
    many = got[(got["n"] > COMMON * total) & (got["bucket"] < BUCKETS)]
    out = np.zeros(BUCKETS, np.uint8)
    out[many["bucket"].to_numpy(np.int64)] = np.clip(1 + 16 * np.log2(many["n"].to_numpy(float) / (COMMON * total)), 1, 255).astype(np.uint8)
    return out


def told_units(unit: np.ndarray, of: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, record, kept), each once in order of records: kept are all but the commonest common units of each record, at
    most TRIMMED of its units."""
    level = common[_bucket(unit)]
    key = of.astype(np.uint64) << np.uint64(40) | (255 - level).astype(np.uint64) << np.uint64(32) | unit >> np.uint64(32)
    order = np.argsort(key)
    order = order[np.diff(key[order], prepend=key[order[:1]] ^ np.uint64(1)) != 0]
    unit, of, level = unit[order], of[order], level[order]
    size = np.bincount(of)
    rank = np.arange(of.size) - (np.cumsum(size) - size)[of]
    return unit, of, (level == 0) | (rank >= np.floor(TRIMMED * size[of]))


def sketches(unit: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """For each record the number of its units, and in BITS bits whether an odd number of them fell on a bit.

    ``first`` are the places where a record's units begin. The bits in which two sketches differ are those of the units
    that only one of the records has.
    """
    bit = unit & np.uint64(BITS - 1)
    out = {"size": np.diff(np.append(first, unit.size)).astype(np.int32)}
    for k in range(BITS // 64):
        own = np.where(bit >> np.uint64(6) == np.uint64(k), np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
        out[f"s{k}"] = np.bitwise_xor.reduceat(own, first).view(np.int64)
    return out


def bits_apart(threshold: float) -> list[int]:
    """For each sum of two records' sizes the most bits their sketches differ in if at least ``threshold`` of their units
    are in both; up to the sum from which sketches tell nothing."""
    out: list[int] = []
    while len(out) < 1 << 14:
        apart = (1 - threshold) / (1 + threshold) * len(out)
        mean, most = BITS / 2 * (1 - (1 - 2 / BITS) ** apart), BITS / 4 * (1 - (1 - 4 / BITS) ** apart)
        out.append(int(mean + SIGMAS * most**0.5 + 1))
        if mean > 0.45 * BITS:
            break
    return out


def fingerprints(records: DataFrame, units: Units) -> DataFrame:
    """(id, symbols array<int>, sketch) for every record with a unit: the fingerprint, and the sketch of all units."""
    held = records.sparkSession.sparkContext.broadcast(commonness(records, units))
    count = SEGMENTS * WIDTH
    seeds = _mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    factors, shifts = seeds[:count] | np.uint64(1), seeds[count:]

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["id"].to_numpy()
            for start, run in _parts(b["text"]):
                unit, of, kept = told_units(*units.hashed(run), held.value)
                if not unit.size:
                    continue
                whole = sketches(unit, np.flatnonzero(np.diff(of, prepend=-1)))
                unit, of = unit[kept], of[kept]
                first = np.flatnonzero(np.diff(of, prepend=-1))
                symbols = np.empty((first.size, count), np.int32)
                for k in range(count):
                    symbols[:, k] = (_mix(np.minimum.reduceat(unit * factors[k] + shifts[k], first)) >> np.uint64(48)).astype(np.int32)
                yield pd.DataFrame({"id": ids[start + of[first]], "symbols": list(symbols), **whole})

    kind, words = dict(records.dtypes)["id"], [f"s{k}" for k in range(BITS // 64)]
    rows = records.mapInPandas(sketch, f"id {kind}, symbols array<int>, size int, {', '.join(f'{w} long' for w in words)}")
    return rows.select("id", "symbols", F.struct("size", *words).alias("sketch"))


class _Near:
    """The steps between records and verified pairs; records are known by the number of their representative."""

    def __init__(self, table: DataFrame, id_col: str, text: str, units: Units, threshold: float) -> None:
        self.scratch, self.units, self.threshold = Scratch(table.sparkSession, "near"), units, threshold
        self.records = table.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("text"))
        digests = self.records.select("id", F.unhex(F.md5(F.lower("text"))).alias("digest"))
        firsts = self.scratch.save(digests.groupBy("digest").agg(F.min("id").alias("rep")).withColumn("no", F.monotonically_increasing_id()))
        self.members = self.scratch.save(digests.join(firsts, "digest").select("id", "rep", "no"))
        self.reps = firsts.select(F.col("rep").alias("id"), "no")
        self.prints = self.scratch.save(fingerprints(self.records, units).join(self.reps, "id").select("no", "symbols", "sketch"))
        self.apart = bits_apart(threshold)

    def index(self) -> DataFrame:
        """(entry, no): the ball of radius 1 around every segment of every fingerprint, one entry for each symbol left out.

        An entry is its number above its three other symbols of 16 bits, so no two entries share a key. Numbers are
        exploded first: one expression for all entries stays small enough to be compiled.
        """
        numbered = self.prints.select("no", "symbols", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS * WIDTH - 1))).alias("k"))
        left_out = F.pmod("k", F.lit(WIDTH))
        first = F.col("k") - left_out
        key = F.shiftleft(F.col("k").cast("long"), 48)
        for j in range(WIDTH - 1):
            key = key + F.shiftleft(F.get("symbols", first + F.when(left_out <= j, j + 1).otherwise(j)).cast("long"), 16 * j)
        return numbered.select("no", key.alias("entry"))

    def met(self) -> DataFrame:
        """(a, b) for every two records with an entry in common whose sketches don't rule them out.

        Both sides read one shuffle of the shared entries and their sketches; pairs ruled out, whose number grows with the
        square of the records, are never written. Adaptive execution splits the entries of large groups, whose pairs are
        wanted all.
        """
        shared = self.sketched(self.shared())
        x, y = (shared.select("entry", F.col("no").alias(c), F.col("sketch").alias(f"s_{c}")) for c in "ab")
        return x.join(y, "entry").where("a < b").where(self.may()).select("a", "b").distinct()

    def may(self) -> Column:
        """Whether the sketches s_a and s_b can be those of similar records."""
        differ = reduce(Column.__add__, [F.bit_count(F.col(f"s_a.s{k}").bitwiseXOR(F.col(f"s_b.s{k}"))) for k in range(BITS // 64)])
        most = F.get(F.array(*map(F.lit, self.apart)), F.col("s_a.size") + F.col("s_b.size"))
        return differ <= F.coalesce(most, F.lit(BITS))

    def sketched(self, shared: DataFrame) -> DataFrame:
        return shared.join(self.prints.select("no", "sketch"), "no")

    def shared(self) -> DataFrame:
        """(entry, no, n): the entries of the index that more than one record has, and how many have it."""
        index = self.index()
        several = index.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return self.scratch.save(index.join(several, "entry"))

    def met_apart(self, shared: DataFrame) -> DataFrame:
        """(a, b) for every two records of different groups with an entry in common whose sketches don't rule them out;
        entries of many records are split over tasks."""
        k = F.ceil(F.col("n") / HOT).cast("int")
        shared = self.sketched(shared)
        x = shared.select("entry", F.col("no").alias("a"), F.pmod(F.xxhash64("no"), k).cast("int").alias("part"), F.col("group").alias("x"), F.col("sketch").alias("s_a"))
        y = shared.select("entry", F.col("no").alias("b"), F.explode(F.sequence(F.lit(0), k - 1)).alias("part"), F.col("group").alias("y"), F.col("sketch").alias("s_b"))
        return x.join(y, ["entry", "part"]).where("a < b AND x <> y").where(self.may()).select("a", "b").distinct()

    def close(self, met: DataFrame) -> DataFrame:
        """(a, b): those whose whole fingerprints are near enough."""
        left, right = (self.prints.select(F.col("no").alias(x), F.col("symbols").alias(f"s_{x}")) for x in "ab")
        equal = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
        return self.scratch.save(met.join(left, "a").join(right, "b").where(equal >= LEAST_EQUAL).select("a", "b").distinct())

    def verified(self, close: DataFrame) -> DataFrame:
        """(a, b, similarity) of the pairs whose texts are similar enough."""
        units = self.units

        @F.pandas_udf("double")
        def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
            parts = [units.overlaps(a.iloc[k : k + 1000], b.iloc[k : k + 1000]) for k in range(0, len(a), 1000)]
            return pd.Series(np.concatenate(parts) if parts else [], dtype=float)

        # Few texts are wanted as a rule; their ids are then sent to the texts, else the texts to the ids.
        wanted = self.scratch.save(close.select(F.explode(F.array("a", "b")).alias("no")).distinct().join(self.reps, "no"))
        sent = F.broadcast(wanted) if wanted.count() <= SENT else wanted
        texts = self.scratch.save(self.records.join(sent, "id").dropDuplicates(["no"]).select("no", "text"))
        a, b = (texts.select(F.col("no").alias(x), F.col("text").alias(f"t_{x}")) for x in "ab")
        pairs = close.join(b, "b").join(a, "a").select("a", "b", overlap("t_a", "t_b").alias("similarity"))
        return pairs.where(F.col("similarity") >= self.threshold)

    def named(self, pairs: DataFrame) -> DataFrame:
        a, b = (self.reps.select(F.col("no").alias(x), F.col("id").alias(f"rep_{x}")) for x in "ab")
        pairs = pairs.join(a, "a").join(b, "b")
        return pairs.select(F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b"), "similarity")


def near_groups(table: DataFrame, id_col: str, text: str, units: Units, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): (id, rep, no) for every record with a text, and (a, b, similarity) for all pairs of
    representatives, by their numbers, whose sets of units overlap by at least ``threshold`` (Jaccard).

    Records with equal lower-cased texts are copies with one representative, the smallest id, and are never paired with
    each other. Null texts are in neither result; records without any unit are members but in no pair. Repeated ids count
    once. No cap is set on partners or candidates. Candidates come from fingerprints (see above): a pair is missed with a
    probability of 0.006 if the units it keeps overlap by 0.6, of 0.12 by 0.45 and of 0.4 by a third, the least a pair at
    0.6 can keep; every reported pair is verified on the texts themselves.
    """
    near = _Near(table, id_col, text, units, threshold)
    return near.members, near.verified(near.close(near.met()))


def near_links(table: DataFrame, id_col: str, text: str, units: Units, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(members, links): as ``near_groups``, but links (rep_a, rep_b, similarity) by id, and only as many as it takes to
    make the same groups.

    Each record is first compared with the smallest of every entry it shares, which links most of a large group with a
    pair a record; only records of an entry that are still in different groups are then compared with each other.
    """
    near = _Near(table, id_col, text, units, threshold)
    shared = near.shared()
    heads = shared.groupBy("entry").agg(F.min("no").alias("a"))
    stars = shared.join(heads, "entry").where("a < no").select("a", F.col("no").alias("b")).distinct()
    first = near.scratch.save(near.verified(near.close(stars)))
    known = group_linked(first.select(F.lit(0).alias("scope"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")), "scope", "a", "b")
    groups = near.scratch.save(known.select(F.col("entity_name").cast("long").alias("no"), F.col("group_name").cast("long").alias("group")))
    grouped = shared.join(groups, "no", "left").withColumn("group", F.coalesce("group", "no"))
    mixed = grouped.groupBy("entry").agg(F.min("group").alias("x"), F.max("group").alias("y")).where("x <> y").select("entry")
    second = near.verified(near.close(near.met_apart(grouped.join(mixed, "entry", "left_semi"))))
    return near.members.select("id", "rep").distinct(), near.named(first.unionByName(second))


def near_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of records, copies included."""
    m, n = (members.select(F.col("id").alias(f"id_{x}"), F.col("no").alias(x)) for x in "ab")
    apart = pairs.select("a", "b").join(m, "a").join(n, "b")
    copied = members.groupBy("no").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select(F.col("no").alias("a"))
    alike = m.join(copied, "a", "left_semi").join(n, F.col("a") == F.col("b")).where("id_a < id_b")
    both = apart.select("id_a", "id_b").unionByName(alike.select("id_a", "id_b"))
    return both.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
