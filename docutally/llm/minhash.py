"""Near-duplicate documents by MinHash: banding, signature check, full-set check, components.

Method: a document is its set of 5-word shingles (64-bit hashes). Texts with equal sets are folded to
one class first. ``bands * ROWS`` universal hash functions give the minima of each class; every band of
``ROWS`` minima is a bucket key. Pairs of small buckets are checked on 16-bit signatures (kept from an
estimate of ``threshold - MARGIN`` on), then on the full sets. Components come from alternating large-star and small-star.

Every bucket is compared with one of its classes first, the one whose bucket keys are the commonest, and components are made of the
links found. From then on only classes of different components are paired, and buckets of one component are done.

Large buckets are not paired with themselves while splitting them helps. One class, the one whose bucket keys are the commonest, is the pivot,
and all others are compared with it. Two classes linked to the pivot are connected already. For any other pair,
only differences from the pivot matter: two sets are as far apart as their differences are, and a class that is
too far from the pivot must share part of its difference with every class it is linked to. So the group is split
into smaller buckets by the elements of the differences, the rarest in the group first (of the partner
only so many that one of the required overlap must be among them), and the step repeats as long as it at least halves the pairs that are left;
buckets that it doesn't help stay as they were. Members of a bucket are paired only if their sizes, and what is left of
both differences from the shared element on, allow a link. No pair that can be a link is given up.

There are as many bands of 4 rows as a pair at the threshold needs to share a bucket with probability 1 - 1e-5: 16
at 0.85 (1 - 7.4e-6; a pair at 0.9 1 - 4e-8), 22 at 0.8 (1 - 9.2e-6). The signature check (38 of 64 minima at 0.85, 48 of
88 at 0.8) loses under 1.6e-7 of the pairs at the threshold besides.

Scale: sketches are a few hundred bytes per document; texts move once, compressed, to those documents that share
a bucket at all, then only with candidate pairs. Joins are sort-merge joins at every size.

Defined results: null text counts as empty; texts without a word have an empty set and are linked with
nothing; under 5 words the whole sequence is the one shingle; rows with a null id are linked with nothing,
have a null component and are kept; rows that share an id are one node; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docutally.llm import hashing as H
from docutally.llm.common import packed, unpacked, written
from docutally.llm.components import components

SHINGLE = 5
ROWS = 4
#: Share of pairs just at the threshold that may share no bucket.
MISSED = 1e-5
#: Over five standard deviations of the signature's estimate at the threshold and above.
MARGIN = 0.26
#: A bucket with at most so many pairs per member is paired at once.
PAIRS_PER_MEMBER = 64
#: All that is left is paired at once when it comes to at most so many pairs per bucket entry of the start.
REST_PER_ENTRY = 2


def shingle_sets(texts) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text (A-Z lower-cased, words between white space)."""
    out = []
    for _, _, data, offsets in H.buffers(texts):
        starts, ends, first = H.words(data, offsets)
        hashes = H.Spans(data, lower=True)(starts, ends)
        every = H.sequences(hashes, SHINGLE)
        for lo, hi in zip(first[:-1], first[1:]):
            if hi - lo >= SHINGLE:
                out.append(np.unique(every[lo : hi - SHINGLE + 1]))
            else:
                out.append(H.sequences(hashes[lo:hi], int(hi - lo)) if hi > lo else every[:0])
    return out


def bands_for(percent: int) -> int:
    """Bands with which all but ``MISSED`` of the pairs at the threshold share a bucket."""
    return max(1, int(np.ceil(np.log(MISSED) / np.log1p(-min((percent / 100) ** ROWS, 1 - 1e-9)))))


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """The minima of ``n`` universal hash functions."""
    rng = np.random.default_rng(1618)
    a = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    least = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024]
        np.minimum(least, np.multiply.outer(a, part).__iadd__(b[:, None]).min(axis=1), out=least)
    return least


def sketches(docs: DataFrame, id_col: str, text_col: str, n_bands: int) -> DataFrame:
    """Rows (id, n, set_a, set_b, bands, sig): size and 128-bit hash of the set, band keys, 16-bit minima."""
    bands = np.arange(n_bands, dtype=np.uint64)
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def sketch(batches):
        for batch in batches:
            ids = batch.column(0)
            n, set_a, set_b, keys, sigs = [], [], [], [], []
            for own in shingle_sets(batch.column(1).to_pylist()):
                n.append(len(own))
                with np.errstate(over="ignore"):
                    set_a.append(int(H.mix(own).sum().astype(np.int64)) if len(own) else 0)
                    set_b.append(int(H.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum().astype(np.int64)) if len(own) else 0)
                if not len(own):
                    keys.append([])
                    sigs.append(b"")
                    continue
                least = H.mix(signature(own, n_bands * ROWS))
                key = bands
                for i in range(ROWS):
                    key = H.mix(key * np.uint64(0x9E3779B97F4A7C15) + least[i * n_bands : (i + 1) * n_bands])
                keys.append(key.astype(np.int64))
                sigs.append((least & np.uint64(0xFFFF)).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(set_a, pa.int64()), pa.array(set_b, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], schema=schema
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(sketch, "id long, n long, set_a long, set_b long, bands array<long>, sig binary")


def _agreement(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """The pairs whose signatures agree in a share of at least ``least``."""
    left, right = sigs.toDF("a", "sig_a"), sigs.toDF("b", "sig_b")

    def agree(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            keep = pa.array((a == b).mean(axis=1) >= least)
            yield batch.select(["a", "b"]).filter(keep)

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(agree, "a long, b long")


def _with_sets(pairs: DataFrame, texts: DataFrame, each, schema: str) -> DataFrame:
    """``each(a, b, set of a, set of b)`` over all pairs; it returns a row of ``schema`` or None."""
    left, right = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    joined = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "text_a", "text_b")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            # A text may stand in many pairs of a batch: its set is made once.
            both = [batch.column(c).to_pylist() for c in ("text_a", "text_b")]
            every = list(dict.fromkeys([*both[0], *both[1]]))
            sets = dict(zip(every, shingle_sets([t.decode("utf-8", "surrogatepass") for t in unpacked(pa.array(every, pa.binary()))])))
            rows = [each(a, b, sets[s], sets[t]) for a, b, s, t in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), *both)]
            rows = [r for r in rows if r is not None]
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows))), schema=pa.schema([(n, KINDS[f.split()[1]]) for n, f in zip(names, schema.split(", "))]))

    return joined.mapInArrow(run, schema)


KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets have ``100 * intersection >= percent * union``."""

    def confirm(a, b, x, y):
        common = len(np.intersect1d(x, y, assume_unique=True))
        return (a, b) if common and 100 * common >= percent * (len(x) + len(y) - common) else None

    return _with_sets(pairs, texts, confirm, "a long, b long")


def _starred(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Every (pivot a, member b) with the verdict and the member's difference from the pivot.

    ``pivot`` and ``of`` are hashes of the two sets: rows that share an id may have several. ``far`` is the size of the difference. ``own`` is what an unlinked member may share with a partner, ``prefix`` what a partner offers. Two sets
    x, y at distance at most ``t = (100 - percent) * (|x| + |y|) / (100 + percent)`` (elements in one only)
    whose differences from the pivot are X, Y share at least (|X| + |Y| - t) / 2 of them. With x not linked
    to the pivot P this is over (|Y| + (100 - percent) * (|P| - |y|) / (100 + percent)) / 2.
    """
    share = (100 - percent) / (100 + percent)

    def star(a, b, pivot, member):
        added = np.setdiff1d(member, pivot, assume_unique=True)
        gone = np.setdiff1d(pivot, member, assume_unique=True)
        total = len(added) + len(gone)
        linked = len(added) < len(member) and total * (100 + percent) <= (100 - percent) * (len(member) + len(pivot))
        difference = np.concatenate([added, H.mix(gone ^ np.uint64(0xD1B54A32D192ED03))]).view(np.int64)
        shared = int(np.floor((total + share * (len(pivot) - len(member))) / 2 + 1e-9)) + 1
        prefix = max(0, total - max(shared - 1, 1) + 1)
        # Far from the pivot, a partner cannot be near it: both sides' prefixes meet.
        far = total > 2.2 * share * (len(member) + len(pivot)) / percent * 100
        # No link misses more than t elements of either difference, with |y| at most 100 / percent * |x|.
        most = int(share * len(member) * (1 + 100 / percent) + 1e-9) + 1
        prefix = min(prefix, most)
        own = 0 if linked else min(total, prefix if far else most)
        key, of = (int(H.mix(x).sum().view(np.int64)) for x in (pivot, member))
        return a, b, key, of, len(member), linked, difference.tolist(), own, prefix, total

    return _with_sets(pairs, texts, star, "a long, b long, pivot long, of long, n long, linked boolean, difference array<long>, own int, prefix int, far long")


def _spots(star: DataFrame, near: DataFrame) -> DataFrame:
    """Members of the buckets into which the starred groups are split, one bucket per pivot and element.

    Elements stand in one order for all members of a group, by how many of them have it. Those of a single member come
    first and make no bucket. ``rest`` counts a member's elements from this one on.
    """
    each = star.select("a", "pivot", F.col("b").alias("id"), "of", "n", "own", "prefix", "far", F.explode("difference").alias("element"))
    often = each.groupBy("a", "pivot", "element").count().filter("count > 1")
    listed = each.join(often.hint("merge"), ["a", "pivot", "element"]).groupBy("a", "pivot", "id", "of", "n", "own", "prefix", "far").agg(F.sort_array(F.collect_set(F.struct("count", "element"))).alias("elements"))
    single = F.col("far") - F.size("elements")
    wanted = F.greatest("own", "prefix").cast("long") - single
    placed = listed.select("*", single.alias("single"), F.posexplode(F.slice("elements", 1, F.greatest(wanted, F.lit(0)).cast("int"))).alias("pos", "spot")).withColumn("at", F.col("single") + F.col("pos"))
    placed = placed.join(near.hint("merge"), "id", "left")
    return placed.select(
        "id", F.xxhash64("a", "pivot", "spot.element").alias("bucket"), (-F.col("far")).alias("weight"), F.coalesce("component", "id").alias("part"), "n", "far", (F.col("far") - F.col("at")).alias("rest"),
        (F.col("at") < F.col("own")).alias("open"), (F.col("at") < F.col("prefix")).alias("offered"),
    )


def _met(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of open and offered members of a bucket that may be a link between two components."""
    x = members.filter("open").select(*[F.col(c).alias(f"{c}_x") for c in ("id", "part", "n", "far", "rest")], "bucket")
    y = members.filter("offered").select(*[F.col(c).alias(f"{c}_y") for c in ("id", "part", "n", "far", "rest")], "bucket").hint("merge")
    # In the join's condition, so that no other pair leaves it. A link shares (far_x + far_y - t) / 2 elements, t as in _starred; all stand from its first one on.
    apart = F.lit((100 - percent) / (100 + percent)) * (F.col("n_x") + F.col("n_y")) + 1e-6
    can = (F.col("part_x") != F.col("part_y")) & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")) & (2 * F.least("rest_x", "rest_y") + apart >= F.col("far_x") + F.col("far_y"))
    return x.join(y, (x["bucket"] == y["bucket"]) & can).select(F.greatest("id_x", "id_y").alias("a"), F.least("id_x", "id_y").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", pairs_per_member: int = PAIRS_PER_MEMBER, rest_per_entry: int = REST_PER_ENTRY) -> DataFrame:
    """Rows (id_col, n_shingles, component_id, kept), one per row of ``docs``."""
    drawn = written(sketches(docs, id_col, text_col, bands_for(percent)), "sketches")
    sets = ("n", "set_a", "set_b")
    classes = written(drawn.filter("n > 0 AND id IS NOT NULL").groupBy(*sets).agg(F.min("id").alias("rep")), "classes")
    reps = drawn.join(classes.select(F.col("rep").alias("id"), *sets).hint("merge"), ["id", *sets])
    entries = reps.select("id", "n", F.posexplode("bands").alias("band", "key")).select("id", "n", F.xxhash64("band", "key").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = written(entries.join(sizes.hint("merge"), "bucket"), "buckets")
    weights = written(shared.groupBy("id").agg(F.sum("size").alias("weight")), "weights")
    wanted = weights.select("id").hint("merge")
    sigs = reps.join(wanted, "id", "left_semi").select("id", "sig").dropDuplicates(["id", "sig"])
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = written(packed(texts).join(wanted, "id"), "texts")

    # First every bucket is compared with one of its own only, the one whose bucket keys are the commonest.
    members = shared.join(weights.hint("merge"), "id")
    top = members.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("top"))
    star = members.join(top.select("bucket", (-F.col("top.minus")).alias("to")).hint("merge"), "bucket").filter("id <> to")
    star = star.select(F.greatest("id", "to").alias("a"), F.least("id", "to").alias("b")).distinct()
    links = [written(_confirmed(_agreement(star, sigs, percent / 100 - MARGIN), texts, percent), "links")]
    near = components(links[0]).withColumnRenamed("node", "id")
    # What is connected already needs no further pair: buckets of one component are done, and so are those of two members.
    members = members.filter("size > 2").join(near.hint("merge"), "id", "left")
    members = members.select("id", "bucket", "weight", F.coalesce("component", "id").alias("part"), "n", F.lit(0).cast("long").alias("far"), F.lit(0).cast("long").alias("rest"), F.lit(True).alias("open"), F.lit(True).alias("offered"))

    def sized(members):
        """The members of buckets that may give pairs, with the pairs per member that a bucket gives at most."""
        count = members.groupBy("bucket").agg(
            F.count("*").alias("size"), F.count_if("open").cast("double").alias("opens"), F.count_if("offered").alias("offers"), F.min("part").alias("low"), F.max("part").alias("high")
        ).filter("size > 1 AND opens > 0 AND offers > 0 AND low < high")
        count = count.select("bucket", (F.col("opens") * F.col("offers") / F.col("size")).alias("each"))
        return written(members.join(count.hint("merge"), "bucket"), "buckets")

    def weight_of(members):
        return members.agg(F.coalesce(F.sum("each"), F.lit(0.0))).first()[0]

    entry_count, pairs, members = shared.count(), [], sized(members)
    while True:
        large = members.filter(F.col("each") > pairs_per_member)
        rest = weight_of(large)
        if rest <= rest_per_entry * entry_count:
            break
        # The pivot is an open member, the one with the commonest bucket keys; later the nearest to the pivot before.
        top = large.filter("open").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("top"))
        group = large.join(top.select("bucket", (-F.col("top.minus")).alias("a")).hint("merge"), "bucket").filter("id <> a")
        star = written(_starred(group.select("a", F.col("id").alias("b")).distinct(), texts, percent), "star")
        links.append(star.filter("linked").select("a", "b"))
        split = sized(written(_spots(star, near), "spots"))
        # Splitting goes on while it at least halves the pairs that are left.
        if weight_of(split) > rest / 2:
            break
        pairs.append(_met(members.filter(F.col("each") <= pairs_per_member), percent))
        members = split
    pairs.append(_met(members, percent))
    every = reduce(DataFrame.union, pairs).distinct()
    checked = _confirmed(_agreement(every, sigs, percent / 100 - MARGIN), texts, percent)
    found = components(reduce(DataFrame.union, links, checked))
    of_class = classes.join(found.hint("merge"), F.col("rep") == F.col("node"), "left").select(*sets, F.coalesce("component", "rep").alias("found"))
    out = drawn.select("id", *sets).join(of_class.hint("merge"), list(sets), "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("found")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    from docutally.llm.common import prepare, table

    return near_duplicates(table(prepare(spark), sf_dir, "documents"), percent=85)


OP9_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM texts UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM texts LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""
