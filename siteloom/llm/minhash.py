"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document is the set of its runs of ``k`` words. One permutation scatters the elements over
``UNIVERSE`` places; a second one, shifted circularly by 0, 1, ... K - 1 places, gives all K
signature coordinates: for an element these are K adjacent cells of one table, so a signature
is a running minimum over slices. Bands of the signature name buckets; links are confirmed on
the full sets, and components of the links are returned.

Groups of copies: equal sets are one class from the start. In a bucket every member is compared
with one pivot (the member met in most buckets), never with all others. Members of buckets that
still hold several components are then joined on the rarest elements of their sets, which pairs over the
threshold must share (prefix filtering), and pairs of different components are compared; so
no link within a bucket is lost that could join two components.

Defined cases: words are the runs outside blanks and control space after lower-casing A-Z; a text with
fewer than ``k`` words is one run of all of them; a null, empty or wordless text has
no set and no link. Rows of one id are one document: if their sets differ, these are linked, and each row shows the size of its own.
A row with a null id takes the class of its equals but links nothing. Ties go to the smaller id. Extra columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, LOWER, chunks, few_files, lists, materialise, mix, shingles, small_batches, word_hash, words
from .graph import components

BANDS, ROWS = 25, 5
COORDINATES = BANDS * ROWS
UNIVERSE = 1 << 21
#: Documents up to which an element counts as rare while pairs are sought.
RARE = 32
#: Standard deviations by which a signature may fall short of the threshold before its pair is dropped.
SLACK = 6.5

#: Word bytes: all but tab to carriage return, and blank.
WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[*range(9, 14), 32]] = False

_TABLES: dict[str, np.ndarray] = {}


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and K-wide windows of the circular one (a view)."""
    if not _TABLES:
        rng = np.random.default_rng(97)
        _TABLES["scatter"] = rng.permutation(UNIVERSE).astype(np.uint32)
        ring = rng.permutation(UNIVERSE).astype(np.uint32)
        _TABLES["ring"] = np.concatenate([ring, ring[:COORDINATES]])
    return _TABLES["scatter"], np.lib.stride_tricks.sliding_window_view(_TABLES["ring"], COORDINATES)


def signature(elements: np.ndarray) -> np.ndarray:
    """K coordinates of a set of 64-bit elements (at least one)."""
    scatter, ring = permutations()
    place = scatter[(elements >> np.uint64(43)).astype(np.int64)]
    out = ring[place[:2048]].min(axis=0)
    for lo in range(2048, len(place), 2048):
        np.minimum(out, ring[place[lo:lo + 2048]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for c in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
        h = h * np.uint64(BASE) + c + np.uint64(1)
        h ^= h >> np.uint64(29)
    return mix(h).view(np.int64)


def sets_of(raw: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    raw = LOWER[raw]
    start, end, first = words(raw, at, WORD_BYTES)
    runs, row = shingles(word_hash(raw, start, end), first, k)
    return [np.unique(runs[a:b]) for a, b in zip(row[:-1], row[1:])]


def set_marks(s: np.ndarray) -> tuple[int, int]:
    """Two independent sums over a set, as signed longs: with its size they stand for the set."""
    both = np.array([mix(s).sum(dtype=np.uint64), mix(s * np.uint64(BASE)).sum(dtype=np.uint64)], np.uint64).view(np.int64)
    return int(both[0]), int(both[1])


def features(docs: DataFrame, k: int) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: set size, set fingerprint, packed signature, band keys."""

    def run(batches):
        for batch in batches:
            for lo, hi, raw, at in chunks(batch, "text"):
                sizes, one, two, sigs, bands, count = [], [], [], [], [], [0]
                for s in sets_of(raw, at, k):
                    sizes.append(len(s))
                    for out, value in zip((one, two), set_marks(s)):
                        out.append(value)
                    if len(s):
                        sig = signature(s)
                        sigs.append(sig.astype(np.uint8).tobytes())
                        bands.append(band_keys(sig))
                    else:
                        sigs.append(b"")
                    count.append(count[-1] + (BANDS if len(s) else 0))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()),
                    pa.array(two, pa.int64()), pa.array(sigs, pa.binary()),
                    lists(np.concatenate([np.zeros(0, np.int64), *bands]), np.array(count), pa.int64())],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "sig", "bands"])

    return small_batches(docs).mapInArrow(run, "doc_id long, n_shingles long, fp1 long, fp2 long, sig binary, bands array<long>")


def full_sets(docs: DataFrame, classes: DataFrame, k: int, ids: DataFrame) -> DataFrame:
    """The sets of the classes in ``ids(rep)``, read from the text of the document that stands for each: rep, elements."""

    def run(batches):
        for batch in batches:
            reps, marks = batch.column("rep"), list(zip(batch.column("fp1").to_pylist(), batch.column("fp2").to_pylist()))
            for lo, hi, raw, at in chunks(batch, "text"):
                sets = sets_of(raw, at, k)
                # Another row of the same id may hold another set.
                own = [i for i, s in enumerate(sets) if set_marks(s) == marks[lo + i]]
                offsets = np.cumsum([0, *(len(sets[i]) for i in own)])
                yield pa.RecordBatch.from_arrays([
                    reps.slice(lo, hi - lo).take(pa.array(own, pa.int64())),
                    lists(np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in own)]).view(np.int64), offsets, pa.int64())], names=["rep", "elements"])

    # Joined by shuffle at every size, so that its cost follows the input.
    wanted = classes.select("rep", F.col("least").alias("doc_id"), "fp1", "fp2").join(ids, "rep", "left_semi")
    texts = docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id")
    sets = materialise(small_batches(texts.select("rep", "fp1", "fp2", "text")).mapInArrow(run, "rep long, elements array<long>"), "sets")
    twice = sets.groupBy("rep").agg(F.count("*").alias("rows")).where("rows > 1")
    return sets if twice.isEmpty() else materialise(sets.dropDuplicates(["rep"]), "sets")


def close(pairs: DataFrame, sigs: DataFrame, share: float) -> DataFrame:
    """Pairs whose signatures do not rule the threshold out."""
    least = share - SLACK * (share * (1 - share) / COORDINATES) ** 0.5

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("sa", "sb"))
                keep = pa.array((a == b).mean(axis=1) >= least)
                yield batch.select(["a", "b"]).filter(keep)

    both = (pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb"))
    return both.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs whose full sets have den * intersection >= num * union."""
    ids = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    sets = full_sets(docs, classes, k, ids)
    both = (pairs.join(sets.select(F.col("rep").alias("a"), F.col("elements").alias("ea")), "a")
            .join(sets.select(F.col("rep").alias("b"), F.col("elements").alias("eb")), "b"))
    both = both.withColumn("common", F.size(F.array_intersect("ea", "eb")).cast("long"))
    return both.where(F.lit(den) * F.col("common") >= F.lit(num) * (F.size("ea") + F.size("eb") - F.col("common"))).select("a", "b").distinct()


def with_pivots(rows: DataFrame) -> DataFrame:
    """Add to ``rows(key, rep)`` each bucket's pivot: the member that meets most others, then the smaller id."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("members"))
    weight = rows.join(sizes, "key").groupBy("rep").agg(F.sum("members").alias("weight"))
    best = rows.join(weight, "rep").groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("less"))).alias("top"))
    return rows.join(best.select("key", (-F.col("top.less")).alias("pivot")), "key")


def mixed(rows: DataFrame) -> DataFrame:
    """Buckets of ``rows(key, rep, component)`` whose members lie in more than one component."""
    keys = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return rows.join(keys, "key", "left_semi")


def prefix_pairs(rows: DataFrame, docs: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs of different components among ``rows(rep, component)`` that may reach the threshold: a, b.

    Sets are ordered by how many of these documents hold an element. Two sets that reach the threshold
    share one of their first n - ceil(n * num / den) + 1 elements in that order, so only these are
    joined. Per element, the members outside its largest component meet all others.

    What two sets can share is bounded before they meet. Elements that a document holds alone are never
    shared. If two sets meet at an element of more than ``RARE`` documents, all their rarer elements come before it in
    their prefixes; they either meet there too, or share none of them. At the first element where two sets meet, neither
    shares anything before it; pairs that this rules out there need not be made there.
    """
    ids = rows.select("rep", "component").distinct()
    cells = full_sets(docs, classes, k, ids.select("rep")).select("rep", F.size("elements").alias("n"), F.explode("elements").alias("element"))
    df = cells.groupBy("element").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("rep")
    seen = cells.join(df, "element").withColumns({
        "shared": F.count("*").over(own), "common": F.count_if(F.col("df") > RARE).over(own),
        "place": F.row_number().over(own.orderBy("df", "element"))})
    # Elements of one document alone come first in its order; they use up its prefix and meet nobody.
    seen = seen.withColumn("place", F.col("place") + F.col("n") - F.col("shared"))
    most = F.least(F.when(F.col("df") > RARE, F.col("common")).otherwise(F.col("shared")), F.col("n") - F.col("place") + 1)
    first = (seen.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(num) / F.lit(den)) + 1)
             .select("rep", "n", most.alias("most"), "element").join(ids, "rep"))
    first = few_files(first, "prefixes")
    sizes = first.groupBy("element", "component").agg(F.count("*").alias("members"))
    major = sizes.groupBy("element").agg(F.max(F.struct("members", "component")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
    held = first.join(major.select("element", F.col("top.component").alias("major")), "element")
    minor = held.where("component <> major").select("element", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("most").alias("most_a"), F.col("component").alias("ca"))
    both = F.least("most_a", "most")
    may = (F.col("ca") != F.col("component")) & (F.lit(den) * both >= F.lit(num) * (F.col("na") + F.col("n") - both))
    return (minor.join(held, "element").where(may)
            .select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct())


def links(docs: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Confirmed links that connect what is connected, between class representatives: a, b."""
    sigs = classes.select("rep", "sig")
    cells = classes.select("rep", F.explode("bands").alias("key"))
    shared = cells.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    rows = few_files(with_pivots(few_files(cells.join(shared, "key", "left_semi"), "buckets")), "pivots").where("rep <> pivot")

    def check(pairs):
        return few_files(confirmed(few_files(close(pairs, sigs, num / den), "close"), docs, classes, k, num, den), "links")

    found = check(rows.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct())
    labels = components(found).withColumnRenamed("v", "rep")
    rest = rows.select("key", "rep").join(labels, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    rest = few_files(mixed(rest).select("rep", "component").distinct(), "rest")
    if rest.isEmpty():
        return found
    return found.unionByName(check(few_files(prefix_pairs(rest, docs, classes, k, num, den), "pairs")))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable), kept (it is that id)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    feats = materialise(features(docs, k), "minhash")
    equal = ["fp1", "fp2", "n_shingles"]
    # A class is a set that documents share; the smallest of their ids finds its text and may name its component.
    classes = materialise(
        feats.where("n_shingles > 0").groupBy(*equal)
        .agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig"), F.first("bands").alias("bands")).where("least IS NOT NULL")
        .withColumn("rep", F.monotonically_increasing_id()), "classes")
    found = links(docs, classes, k, num, den).unionByName(shared_ids(feats, classes))
    labels = components(found).withColumnRenamed("v", "rep")
    of = classes.select(*equal, "rep", "least").join(labels, "rep", "left").select(*equal, "least", F.coalesce("component", "rep").alias("component"))
    names = of.groupBy("component").agg(F.min("least").alias("name"))
    of = of.join(names, "component").select(*equal, "name")
    out = feats.select("doc_id", *equal).join(of, equal, "left")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("name", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("name", "doc_id"), F.lit(False)).alias("kept"))


def shared_ids(feats: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of one id, each to the least of them: a, b."""
    equal = ["fp1", "fp2", "n_shingles"]
    rows = feats.where("n_shingles > 0 AND doc_id IS NOT NULL")
    twice = rows.groupBy("doc_id").agg(F.min(F.struct(*equal)).alias("lo"), F.max(F.struct(*equal)).alias("hi")).where("lo <> hi").select("doc_id")
    twice = few_files(twice, "shared_ids")
    held = rows.join(twice, "doc_id", "left_semi").select("doc_id", *equal).distinct().join(classes.select(*equal, "rep"), equal).select("doc_id", "rep")
    least = held.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return held.join(least, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b")).distinct()
