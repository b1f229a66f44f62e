"""Near-duplicate documents by HyperMinHash registers.

1. A document's set is its distinct word shingles as 64-bit hashes.  The hash's
   top bits choose one of 256 buckets; a bucket keeps the least remainder as a
   16-bit register, the count of its leading zeros and the mantissa bits after
   them.  Empty buckets borrow from the first filled one in a fixed order.
2. Documents with equal sets are one class, its smallest id stands for it.
3. Bands of registers give keys; classes that share a key are candidates.  Each
   key's members are first paired with two of them only, the smallest and the
   one that meets most others (the likely source of copies), so a group of n
   near copies gives about n pairs, not their square.
4. A pair whose collision-corrected estimate of the Jaccard index could reach
   the threshold is verified on both full sets.
5. Members of a key that are still in different components after that are
   paired with each other component's members of the same key where sizes,
   parity sketches and one-bit sketches of the registers allow the threshold,
   and verified the same way, so no link between components is lost.

With 51 bands of 5 registers a pair at the threshold 0.8 is missed with
probability 1.6e-9.  Skew: members of a hot class are dealt to several tasks
(:func:`salted_join`); the members of a key that meet in step 5 are dealt to blocks
of ``BLOCK``, and each pair of blocks is a task's work of its own.

Defined results: null and empty texts have an empty set, link with nothing and
stay; a text with fewer words than a shingle is one shingle; texts of any length
count whole; equal ids are one node, also with unlike texts; rows with a null id
link with nothing and stay; repeated rows get equal results; of a component the
smallest id stays, so there are no ties; an empty table gives no rows.  Columns
other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import salted_join, small_batches, table, written
from framewright.llm.components import components
from framewright.llm.wordhash import coded, groups, hashes, mix

BUCKET_BITS = 8
MANTISSA_BITS = 10
BAND_REGISTERS = 5
SHINGLE_WORDS = 5
PERCENT = 80
#: Bits of the parity sketch.
PARITY_BITS = 1024
#: Members of a key that meet those of another block in one task.
BLOCK = 1024
#: Standard errors below the threshold at which an estimate still goes to verification.
MARGIN = 6.0

_BUCKETS = 1 << BUCKET_BITS
_BANDS = _BUCKETS // BAND_REGISTERS
#: For each bucket the fixed order in which it looks for a filled one, itself first.
_ORDER = np.stack([np.concatenate([[b], np.random.default_rng(b).permutation(np.delete(np.arange(_BUCKETS), b))]) for b in range(_BUCKETS)])


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; ``texts`` has no nulls."""
    codes, offsets, distinct = coded(texts, lower=True)
    h = mix(hashes(distinct))[codes] if distinct else np.zeros(0, np.uint64)
    n = len(h)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(n - size + 1, 0), np.uint64)
        for k in range(size):
            rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(rolled)])
        for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            if last - first >= size:
                yield np.unique(rolled[first : last - size + 1])
            elif last > first:
                short = np.uint64(last - first)
                for x in h[first:last]:
                    short = mix(np.array([short * np.uint64(0x9E3779B97F4A7C15) + x]))[0]
                yield np.array([short], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def registers(found: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16) of a sorted, non-empty set."""
    bucket = (found >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    rest = found[at] << np.uint64(BUCKET_BITS)  # sorted: the first of a bucket is its least
    _, exponent = np.frexp((rest >> np.uint64(BUCKET_BITS)).astype(np.float64) + 0.5)
    zeros = np.clip(64 - BUCKET_BITS - exponent, 0, 63).astype(np.uint64)
    mantissa = ((rest << zeros) << np.uint64(1)) >> np.uint64(64 - MANTISSA_BITS)
    out = np.zeros(_BUCKETS, np.uint16)
    out[bucket[at]] = ((zeros << np.uint64(MANTISSA_BITS)) | mantissa).astype(np.uint16)
    if len(at) < _BUCKETS:
        filled = np.zeros(_BUCKETS, bool)
        filled[bucket[at]] = True
        out = out[_ORDER[np.arange(_BUCKETS), filled[_ORDER].argmax(axis=1)]]
    return out


def band_keys(register: np.ndarray) -> np.ndarray:
    rows = register[: _BANDS * BAND_REGISTERS].reshape(_BANDS, BAND_REGISTERS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = mix(np.arange(1, _BANDS + 1, dtype=np.uint64))
        for k in range(BAND_REGISTERS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.astype(np.int64)


def estimated(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index from two register arrays, corrected for chance collisions.

    Two unlike buckets agree by chance when zeros and mantissa agree:
    sum over z of 2**-2(z+1) = 1/3, times 2**-mantissa bits.
    """
    chance = 1 / (3 * 2**MANTISSA_BITS)
    return max(0.0, (float((a == b).mean()) - chance) / (1 - chance))


def sketch(register: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Longs: the low bits of the registers (unlike ones differ in half of
    them), then for each residue of the hashes whether the set holds an odd
    number (unlike bits are at most the elements that only one set has)."""
    low = np.packbits((register & 1).astype(np.uint8), bitorder="little").view("<i8")
    odd = np.bincount((found % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.concatenate([low, np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")])


def _possible(percent: int) -> str:
    """SQL condition that two sets (n, sketch) and (o, t) may reach the threshold.

    Sizes and parities are exact bounds.  The low bits are asked only of sets
    that fill the registers, at MARGIN standard errors above their mean.
    """
    p, words = (1 - percent / 100) / 2, _BUCKETS // 64
    limit = int(np.ceil(_BUCKETS * p + MARGIN * np.sqrt(_BUCKETS * p * (1 - p))))
    differ = lambda first, many: " + ".join(f"bit_count(sketch[{k}] ^ t[{k}])" for k in range(first, first + many))
    return (
        f"100 * least(n, o) >= {percent} * greatest(n, o)"
        f" and {100 + percent} * ({differ(words, PARITY_BITS // 64)}) <= {100 - percent} * (n + o)"
        f" and (least(n, o) < {_BUCKETS} or {differ(0, words)} <= {limit})"
    )


def _profiles(size: int, full: bool):
    """Map batches (doc_id, text) to sets; ``full``: with registers and set, else with band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_id")
            for first, part in groups(batch.column("text")):
                n, low, high, bands, sketches, regs, sets = [], [], [], [], [], [], []
                for found in shingle_sets(part, size):
                    n.append(len(found))
                    register = registers(found) if len(found) else np.zeros(0, np.uint16)
                    if full:
                        regs.append(register.tobytes())
                        sets.append(found.tobytes())
                    else:
                        with np.errstate(over="ignore"):
                            low.append(int(np.bitwise_xor.reduce(mix(found + np.uint64(1))).astype(np.int64)) if len(found) else 0)
                            high.append(int(mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().astype(np.int64)) if len(found) else 0)
                        bands.append(band_keys(register) if len(found) else np.zeros(0, np.int64))
                        sketches.append(sketch(register, found).tolist() if len(found) else [])
                ids = keys.slice(first, len(part))
                if full:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(regs, pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "registers", "shingles"])
                else:
                    lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32), np.concatenate(bands))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), lists, pa.array(sketches, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "low", "high", "bands", "sketch"])

    return run


def _verified(percent: int):
    """Keep the candidate pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = percent / 100 - MARGIN * np.sqrt(percent / 100 * (1 - percent / 100) / _BUCKETS)
        for batch in batches:
            a, b = [], []
            cols = [batch.column(c) for c in ("a", "b", "ra", "rb", "sa", "sb")]
            last, left, mine = None, None, None
            for i in range(batch.num_rows):
                x, y = cols[0][i].as_py(), cols[1][i].as_py()
                if x != last:
                    last, left, mine = x, np.frombuffer(cols[4][i].as_py(), np.uint64), np.frombuffer(cols[2][i].as_py(), np.uint16)
                # Borrowed registers of small sets are not independent; those sets go straight to verification.
                right = np.frombuffer(cols[5][i].as_py(), np.uint64)
                if min(len(left), len(right)) >= _BUCKETS and estimated(mine, np.frombuffer(cols[3][i].as_py(), np.uint16)) < limit:
                    continue
                if 100 * min(len(left), len(right)) < percent * max(len(left), len(right)):
                    continue
                both = np.concatenate([left, right])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(left) + len(right) - shared):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _links(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of distinct ids that reach the threshold."""
    left = profiles.select(F.col("doc_id").alias("a"), F.col("registers").alias("ra"), F.col("shingles").alias("sa"))
    right = profiles.select(F.col("doc_id").alias("b"), F.col("registers").alias("rb"), F.col("shingles").alias("sb"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "ra", "rb", "sa", "sb").mapInArrow(_verified(percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents link when ``100 * |A and B| >= percent * |A or B|`` of their sets
    of ``size``-word shingles; a component is named after its smallest id.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = written(source.mapInArrow(_profiles(size, False), "doc_id bigint, n_shingles bigint, low bigint, high bigint, bands array<bigint>, sketch array<bigint>"))
    some = seen.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("n_shingles", "low", "high").agg(F.min("doc_id").alias("rep"))
    member = written(salted_join(some.select("doc_id", "n_shingles", "low", "high"), classes, ["n_shingles", "low", "high"], ["doc_id"]).select("doc_id", "rep"))
    # An id with unlike texts ties its classes together; all other members follow their class.
    both = member.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("doc_id")
    same = member.join(both, "doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    # An id stands for its class once, however many equal rows there are.
    reps = some.join(classes.select("n_shingles", "low", "high", F.col("rep").alias("doc_id")), ["doc_id", "n_shingles", "low", "high"], "left_semi")
    keyed = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("rep"))
    shared = keyed.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("most"), F.count("*").alias("n")).where("lead < most").select("key", "lead", "n")
    members = written(keyed.join(shared, "key").distinct())
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    profiles = written(source.join(wanted, "doc_id", "left_semi").mapInArrow(_profiles(size, True), "doc_id bigint, registers binary, shingles binary"))

    # The text that copies were made from shares its keys with most of them: the member met most often.
    met = members.groupBy("rep").agg(F.sum("n").alias("met"))
    centre = members.join(met, "rep").groupBy("key").agg(F.max(F.struct("met", (-F.col("rep")).alias("r"))).alias("best")).select("key", (-F.col("best.r")).alias("centre"))
    ends = [members.select(F.col("lead").alias("x"), F.col("rep").alias("y")), members.join(centre, "key").select(F.col("centre").alias("x"), F.col("rep").alias("y"))]
    first = written(ends[0].union(ends[1]).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    links = written(_links(first, profiles, percent))
    found = components(links)

    # Keys that still hold several components: their other pairs that sizes and one-bit sketches allow.
    # A key's members are dealt to blocks; every pair of blocks meets under a key of its own.
    place = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    place = written(place)
    mixed = place.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("m")).where("x < y and m > 2").select("key", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    sketched = reps.select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sketch").distinct()  # an id with unlike texts keeps each
    open_ = written(place.join(mixed, "key").withColumn("at", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).join(sketched, "rep"))
    here = open_.select("key", F.col("rep").alias("a"), "c", "n", "sketch", F.col("at").alias("one"), F.explode(F.expr("sequence(at, blocks - 1)")).alias("two"))
    other = open_.select("key", F.col("rep").alias("b"), F.col("c").alias("d"), F.col("n").alias("o"), F.col("sketch").alias("t"), F.explode(F.expr("sequence(0, at)")).alias("one"), F.col("at").alias("two"))
    rest = here.join(other, ["key", "one", "two"]).where("c <> d and (one < two or a < b)").where(_possible(percent))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = rest.join(first, ["a", "b"], "left_anti")
    more = written(_links(rest, profiles, percent))
    everything = links.select("a", "b").union(more).union(same)
    final = salted_join(member, components(everything).withColumnRenamed("node", "rep"), ["rep"], ["doc_id"], "left")
    final = final.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = seen.where("doc_id is not null").select("doc_id", "n_shingles").join(final, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    # Rows without an id have nothing to join on: they do not meet in one task.
    out = out.unionByName(seen.where("doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
       ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
g AS (SELECT DISTINCT doc_id, g FROM s),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS place, g FROM (SELECT *, count(*) OVER (PARTITION BY g) AS df FROM g)),
-- Sets that share four fifths share one of the rarest fifth (and one more) of each: only those are joined.
p AS (SELECT doc_id, g FROM k JOIN n USING (doc_id) WHERE 5 * place <= n + 5),
c AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id),
link AS (SELECT x, y FROM c JOIN g a ON a.doc_id = x JOIN g b ON b.doc_id = y AND b.g = a.g JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y
         GROUP BY x, y, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
both_ AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM reach r JOIN both_ l ON r.y = l.x),
comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, comp.component_id, d.doc_id = comp.component_id AS kept
FROM d JOIN comp ON comp.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's links over all ``documents``: two-word shingles, four fifths."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2)
