"""MinHash near-dedup by a multi-index Hamming join.

A document's set of word shingles gets a signature of 16-bit components, ``IN_CHUNK`` to a chunk. Two
signatures that differ in fewer than twice as many components as there are chunks have a chunk in which
at most one component differs (pigeonhole). All single errors are enumerated: a key for every chunk and
left-out component, over the chunk's other components. So every pair under the distance shares a key.
With 8 chunks, pairs of Jaccard similarity 0.85 are over the distance with probability 2e-6 and more
similar ones less often; for 0.8, 12 chunks give 4e-6.

1. Documents of equal sets are one class from here on.
2. Keys that several classes share give candidates: first each class with a random one of the key's
   (as many as there are classes): of those under the distance and near in size, confirmed on full sets.
3. Between members of a key that are not yet connected, all pairs within the distance of the
   signatures, and of longer ones, are confirmed on full sets. Keys of many members are cut into
   blocks, those of a large component apart from others, and every two blocks that aren't of one and
   the same component are compared as a unit of their own. First signatures say which members
   of a unit have a candidate at all; their full sets are brought to the unit and compared there, so
   that no row is made for a pair but a confirmed link, and pairs that a unit's links connect are left.
   The longer signatures are a second loss: a pair of the similarity has more differing components
   than ``long_errors`` with probability 1e-9.
4. Connected components of the confirmed links are the groups.

Defined cases: null and empty texts, and texts without a word, have an empty set and no links, and are
kept; fewer words than a shingle's are one shingle; rows are documents each for itself, so rows that
share a doc_id share its fate only if their texts are linked; a null doc_id ranks after all others
(component_id is null only if all ids of the group are); an empty table gives an empty result; other
columns pass through ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procure_spark.llm.common import table, written
from procure_spark.llm.graph import components

WIDTH, PERCENT = 5, 85

#: Components of a chunk; chunks. Twice as many errors as chunks leave a chunk with two, one less doesn't.
IN_CHUNK, CHUNKS = 4, 8

#: Components, of one byte, of the longer signature that is compared before full sets are.
LONG = 256

#: Members of a key that are compared at once.
BLOCK = 512

_random = np.random.default_rng(7)
_LETTERS = _random.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_random.integers(0, 2**62)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_A, _B = _random.integers(0, 2**64, LONG, dtype=np.uint64) | np.uint64(1), _random.integers(0, 2**64, LONG, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        _powers[base] = np.multiply.accumulate(step)
    return _powers[base][:n]


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles (A-Z lower-cased, words between ASCII spaces)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    data = np.frombuffer(b" ".join(words), np.uint8)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * _power(_BASE, len(data)), out=sums[1:])
    spaces = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], spaces + 1])[: len(words) - width + 1], np.concatenate([spaces, [len(data)]])[width - 1 :]
    h = (sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA24BAED4963EE407)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def signature(hashes: np.ndarray, components: int, bits: int) -> bytes:
    least = np.full(components, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096, None] * _A[:components] + _B[:components]).min(axis=0), out=least)
    mixed = (least ^ (least >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)
    return mixed.astype(f"<u{bits // 8}").tobytes()


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def long_errors(percent: int) -> int:
    """Differing components of longer signatures that pairs of the similarity exceed with probability 1e-9."""
    p = (1 - percent / 100) * 255 / 256
    return math.ceil(LONG * p + 6 * math.sqrt(LONG * p * (1 - p)))


def signed(docs: DataFrame, chunks: int) -> DataFrame:
    """(doc_id, text) -> (doc_id, text_hash, n_shingles, class, sig); class is a digest of the set."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(text) for text in b["text"]]
            yield pd.DataFrame({
                "doc_id": b["doc_id"],
                "text_hash": b["text_hash"],
                "n_shingles": [len(s) for s in sets],
                "class": [digest(s) if len(s) else None for s in sets],
                "sig": [signature(s, chunks * IN_CHUNK, 16) if len(s) else None for s in sets],
            })

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInPandas(sign, f"doc_id {id_type}, text_hash long, n_shingles long, class binary, sig binary")


def keys(classes: DataFrame, chunks: int) -> DataFrame:
    """(class, sig) -> (class, slot, key): one key for each chunk and component left out of it."""
    part = lambda i: F.substring("sig", 2 * i + 1, 2)
    slots = [F.xxhash64(F.lit(c * IN_CHUNK + o), *[part(c * IN_CHUNK + i) for i in range(IN_CHUNK) if i != o]) for c in range(chunks) for o in range(IN_CHUNK)]
    return classes.select("class", F.posexplode(F.array(*slots)).alias("slot", "key"))


def errors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=-1)


def near_pairs(pairs: DataFrame, classes: DataFrame, percent: int, chunks: int) -> DataFrame:
    """pairs (a, b) of classes whose sizes allow the similarity and whose signatures are under the distance."""
    side = lambda c: classes.select(F.col("class").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n").alias(f"n_{c}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                sa, sb = (np.frombuffer(b"".join(p[c]), "<u2").reshape(len(p), chunks * IN_CHUNK) for c in ("sig_a", "sig_b"))
                yield p.loc[errors(sa, sb) < 2 * chunks, ["a", "b"]]

    return sized.mapInPandas(near, "a binary, b binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) of classes whose full sets are as similar as ``percent``."""
    most = long_errors(percent)
    one = pairs.join(sets.select(F.col("class").alias("a"), F.col("hashes").alias("ha"), F.col("long").alias("la")), "a")
    two = one.join(sets.select(F.col("class").alias("b"), F.col("hashes").alias("hb"), F.col("long").alias("lb")), "b")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            good = []
            for ha, hb, la, lb in zip(p["ha"], p["hb"], p["la"], p["lb"], strict=True):
                x, y = np.frombuffer(ha, "<u8"), np.frombuffer(hb, "<u8")
                small, large = sorted((len(x), len(y)))
                if 100 * small < percent * large or errors(np.frombuffer(la, np.uint8), np.frombuffer(lb, np.uint8)) > most:
                    good.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield p.loc[good, ["a", "b"]]

    return two.mapInPandas(check, "a binary, b binary")


def candidates(unit: pd.DataFrame, percent: int, chunks: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a unit and the rows that each is to be compared with: of another label, of a size and
    signatures near enough, and of this key as the first that both share."""
    sig = np.frombuffer(b"".join(unit["sig"]), "<u2").reshape(len(unit), chunks * IN_CHUNK)
    long = np.frombuffer(b"".join(unit["long"]), np.uint8).reshape(len(unit), LONG)
    n, side, label, slot, most = unit["n"].to_numpy(), unit["side"].to_numpy(), unit["label"].to_numpy(), int(unit["slot"].iloc[0]), long_errors(percent)
    right = np.flatnonzero(side == 1)
    for i in np.flatnonzero(side <= 0):
        j = right if side[i] == 0 else np.arange(i + 1, len(unit))
        j = j[(label[j] != label[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
        if not len(j):
            continue
        same = sig[j] == sig[i]
        near = (~same).sum(1) < 2 * chunks
        j, chunk = j[near], same[near].reshape(-1, chunks, IN_CHUNK)
        first = (chunk.sum(2) >= IN_CHUNK - 1).argmax(1)
        own = first * IN_CHUNK + chunk[np.arange(len(j)), first].argmin(1)  # all equal: the first is left out
        j = j[own == slot]
        j = j[errors(long[j], long[i]) <= most]
        if len(j):
            yield int(i), j


def each_unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The units of batches that are sorted by unit; a unit has two blocks at most."""
    held = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        last = (b["unit"] == b["unit"].iloc[-1]).to_numpy()
        held = b[last]
        yield from (unit.reset_index(drop=True) for _, unit in b[~last].groupby("unit", sort=False))
    if held is not None and len(held):
        yield held.reset_index(drop=True)


def by_unit(members: DataFrame) -> DataFrame:
    return members.repartition("unit").sortWithinPartitions("unit", "side", "class")


def meeting(members: DataFrame, percent: int, chunks: int) -> DataFrame:
    """The rows of (unit, side, class, slot, sig, long, n, label) that are a candidate of any other row;
    side is 0 or 1, or -1 if the unit is one block."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit in each_unit(batches):
            met = np.zeros(len(unit), bool)
            for i, j in candidates(unit, percent, chunks):
                met[i] = True
                met[j] = True
            if met.any():
                yield unit[met]

    return by_unit(members).mapInPandas(find, members.schema)


def unit_links(members: DataFrame, percent: int, chunks: int) -> DataFrame:
    """members with hashes -> (a, b): confirmed links between labels, in each unit as many as connect
    what it can connect."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit in each_unit(batches):
            sets = [np.frombuffer(h, "<u8") for h in unit["hashes"]]
            sizes = np.array([len(x) for x in sets])
            numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
            sets = np.split(numbers, np.cumsum(sizes)[:-1])
            marked = np.zeros(int(numbers.max()) + 1, bool)
            names, label = np.unique(unit["label"].to_numpy(), return_inverse=True)
            root = np.arange(len(names))
            found = []
            for i, j in candidates(unit, percent, chunks):
                j = j[root[label[j]] != root[label[i]]]
                if not len(j):
                    continue
                marked[sets[i]] = True
                both = np.add.reduceat(marked[np.concatenate([sets[x] for x in j])].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[j])[:-1]]))
                marked[sets[i]] = False
                for x in j[100 * both >= percent * (sizes[i] + sizes[j] - both)]:
                    one, other = root[label[i]], root[label[x]]
                    if one != other:
                        root[root == max(one, other)] = min(one, other)
                        found.append((unit["class"][i], unit["class"][x]))
            yield pd.DataFrame(found, columns=["a", "b"])

    return by_unit(members).mapInPandas(confirm, "a binary, b binary")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, chunks: int = CHUNKS) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, component_id, kept)."""
    return grouped(docs, percent, chunks).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def grouped(docs: DataFrame, percent: int = PERCENT, chunks: int = CHUNKS) -> DataFrame:
    """(doc_id, text) -> (doc_id, text_hash, n_shingles, component_id, first): a row for each row. first is the
    hash of a text under the group's least id, the least hash if there are several."""
    documents = written(signed(docs, chunks), "op7-signatures")
    # A struct's null would come first; ids that are null come last.
    classes = documents.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one"), F.min("sig").alias("sig"), F.min("n_shingles").alias("n"))
    classes = written(classes, "op7-classes")
    keyed = keys(classes, chunks)
    # A random member of each key (another one for each, so that no odd document stands in for all).
    luck = F.struct(F.xxhash64("key", "class").alias("luck"), F.col("class"))
    several = keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key")
    shared = written(keyed.join(several, "key").select("class", "slot", "key"), "op7-shared")
    sig = classes.select("class", "sig", "n")
    star = shared.join(shared.groupBy("key").agg(F.min(luck)["class"].alias("pivot")), "key").filter(F.col("class") != F.col("pivot"))
    star = star.select(F.least("class", "pivot").alias("a"), F.greatest("class", "pivot").alias("b")).distinct()
    star = written(near_pairs(star, sig, percent, chunks), "op7-star")
    # Full sets and longer signatures of the classes that share any key, from one text of each; only paired ones are joined to pairs.
    paired = star.select(F.col("a").alias("class")).union(star.select("b")).distinct().withColumn("paired", F.lit(True))
    wanted = shared.select("class").distinct().join(classes.select("class", "one.doc_id", "one.text_hash"), "class").join(paired, "class", "left")
    sets = written(full_sets(docs, wanted), "op7-sets")
    star_links = written(confirmed(star, sets.filter("paired"), percent), "op7-links")
    labels = components(star_links, "op7-components")
    # Keys whose members lie in several components.
    labelled = shared.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).filter("l1 != l2").select("key")
    members = labelled.join(open_keys, "key", "left_semi").join(sig, "class").join(sets.select("class", "long"), "class")
    met = written(meeting(in_blocks(members), percent, chunks), "op7-met")
    more = written(unit_links(met.join(sets.select("class", "hashes"), "class"), percent, chunks), "op7-links")
    labels = components(star_links.unionByName(more), "op7-components")
    named = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"), F.min("one")["text_hash"].alias("first"))
    groups = named.join(least, "label").select("class", "component_id", "first")
    own = documents.join(groups, "class", "left")
    lonely = F.col("class").isNull()
    return own.select("doc_id", "text_hash", "n_shingles", F.when(lonely, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(lonely, F.col("text_hash")).otherwise(F.col("first")).alias("first"))


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(class, hashes, long, paired) of the wanted (class, doc_id, text_hash, paired): one text of each class, told by both, as
    rows may share an id."""

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, cls, paired in zip(b["text"], b["class"], b["paired"], strict=True):
                s = shingle_set(text)
                if digest(s) == cls:
                    rows.append((cls, s.astype("<u8").tobytes(), signature(s, LONG, 8), bool(paired)))
            yield pd.DataFrame(rows, columns=["class", "hashes", "long", "paired"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["doc_id"]) & (rows["text_hash"] == wanted["text_hash"])).select("class", "text", F.coalesce("paired", F.lit(False)).alias("paired"))
    return texts.mapInPandas(expand, "class binary, hashes binary, long binary, paired boolean").dropDuplicates(["class"])


def in_blocks(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """members with unit and side. A key's members are cut into blocks of about ``block``: those of a label
    that has as many there into blocks of its own, all others into mixed ones. Two blocks are a unit, unless
    they are of one label; a mixed block is a unit by itself too (side -1)."""
    per = members.groupBy("key", "label").agg(F.count("*").alias("__m"))
    cut = lambda n: F.ceil(n / block).cast("int")
    large = F.collect_list(F.when(F.col("__m") >= block, F.struct(F.col("label").alias("of"), cut(F.col("__m")).alias("n"))))
    keys = per.groupBy("key").agg(large.alias("__large"), F.coalesce(F.sum(F.when(F.col("__m") < block, F.col("__m"))), F.lit(0)).alias("__small"))
    numbers = lambda n: F.slice(F.sequence(F.lit(0), n), F.lit(1), n)  # noqa: E731  0 to n - 1
    own_ones = F.flatten(F.transform("__large", lambda x: F.transform(numbers(x["n"]), lambda i: F.struct(x["of"].alias("of"), i.alias("no")))))
    mixed = F.transform(numbers(cut(F.col("__small"))), lambda i: F.struct(F.lit(None).cast("binary").alias("of"), i.alias("no")))
    keys = keys.select("key", F.concat(own_ones, mixed).alias("__blocks"), cut(F.col("__small")).alias("__mixed"))
    own = F.when(F.col("__m") >= block, F.col("label")).alias("of")
    number = F.pmod(F.xxhash64("class", F.lit(3)), F.when(F.col("__m") >= block, cut(F.col("__m"))).otherwise(F.col("__mixed"))).cast("int").alias("no")
    rows = members.join(per, ["key", "label"]).join(keys, "key").withColumn("__own", F.struct(own, number))
    rows = rows.withColumn("__at", (F.array_position("__blocks", F.col("__own")) - 1).cast("int"))
    rows = rows.select("*", F.posexplode("__blocks").alias("__other", "__b")).filter(F.col("__own.of").isNull() | ~F.col("__b.of").eqNullSafe(F.col("__own.of")))
    side = F.when(F.col("__other") == F.col("__at"), -1).when(F.col("__at") < F.col("__other"), 0).otherwise(1)
    key = F.xxhash64("key", F.least("__at", "__other"), F.greatest("__at", "__other"))
    return rows.select(key.alias("unit"), side.alias("side"), "class", "slot", "sig", "long", "n", "label")


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, chunks: int = CHUNKS) -> DataFrame:
    """docs of which one document of each group stays: that of the group's least id, and of the least text hash
    if several texts of the group share that id. Rows are told apart by id and text, so that an id or a null id
    that many texts share keeps none of them alive for another's sake; rows equal in both are one document."""
    first = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first"))
    kept = grouped(docs, percent, chunks).filter(first).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash")), "left_semi")


def op7_hamming_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
