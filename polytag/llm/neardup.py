"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

Method
------
1. Every text becomes its set of distinct 5-word shingles (lower-cased A-Z), a 128-bit digest of the
   set and a MinHash signature of ``COORDINATES`` values.  Equal sets are one class with its smallest
   doc_id as representative, so exact copies cost one row each and never meet in pairs.
2. Each representative is posted under every (coordinate, value) pair.  Postings that only one
   representative has cannot link anything and go; a representative left with fewer than ``MATCHES``
   postings cannot reach the match threshold and is skipped.
3. Prefix rule: with postings ordered by (frequency, key), two signatures that agree in at least ``MATCHES`` of their
   shared postings also meet within the first s - MATCHES + 1 postings of each.  Only those are joined,
   rarest first, so values that very many documents share (a common passage) are left out of
   every prefix but those of documents that consist mostly of it.
4. Stars: every posting list proposes its members against one head, its most central member (the one
   whose postings are the most shared, so all lists of a group of near copies agree on it): linear in the
   list.  Pairs whose signatures collide in at least ``MATCHES`` coordinates are confirmed on the full shingle
   sets, and confirmed links are joined to components.
5. The rest, without listing a group's pairs: only members of lists that still hold more than one component
   can have a link that is missing, and only one between components.  Two members a, b with the same head H are compared
   by what they add to and leave out of H (X and R): |A n B| <= |H| - max(|Ra|, |Rb|) + |Xa n Xb|, so a
   link needs a number of *added* shingles in common that depends on |A|, |B|, |H| and R alone.
   Where that number is positive the added shingles are joined by the same prefix rule (a document that added more
   than it shares with anyone is out); where it is not (both close to H and short) members of fitting sizes
   are compared.  R and X decide the similarity exactly, inside the join and at the pair's first common added shingle, so that only
   links leave it, each once.  Members with different heads are proposed when they share a
   posting list and are confirmed on the full sets.  So no link between two components is missed.

The signature threshold is 28 of 64: a pair of similarity 0.75 agrees in 48 coordinates on average
(sd 3.5) and misses the threshold with a chance below 1e-8; everything above it is confirmed
exactly, so there are no false links.

Rows are numbered once, in the written table of signatures; classes, links and components are of rows, so a repeated doc_id
confuses nothing.  The text of a head that very many members are compared with is sent once per ``FANOUT`` of them, to different tasks.

Cases: a null or word-less text has an empty set and is linked with nothing; a document of fewer
than five words has one shingle, its whole sequence; rows with a null doc_id are linked with nothing and kept; rows that repeat a doc_id are
documents of their own, each with the component of its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import connected_components
from .lookup import if_small
from .store import Scratch
from .text import chunks, lists, mix64, shingle_sets

COORDINATES = 64
MATCHES = 28
WIDTH = 5
#: comparisons of one text that a task gets
FANOUT = 256

_SIGNED = T.StructType([
    T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("t", T.LongType()), T.StructField("n_shingles", T.LongType()),
    T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
    T.StructField("sig", T.ArrayType(T.IntegerType())),
])


def minhash(values: np.ndarray, offsets: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """(rows, k) uint32 minima over each row's values; every row must have one."""
    seeds = mix64(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    high, low = (values >> np.uint64(32)).astype(np.uint32), values.astype(np.uint32)
    out = np.empty((len(offsets) - 1, k), np.uint32)
    for j in range(k):
        x = (high ^ np.uint32(seeds[j] >> np.uint64(32))) * np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x += low
        x *= np.uint32(int(seeds[j]) & 0xFFFFFFFF | 1)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        out[:, j] = np.minimum.reduceat(x, offsets[:-1])
    return out


def _sign(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in chunks(batch.column(3)):
            values, first = shingle_sets(data, offs, width)
            sizes = np.diff(first)
            full = sizes > 0
            n = hi - lo
            h1, h2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            sig_offsets = np.concatenate(([0], np.cumsum(np.where(full, k, 0))))
            sig = np.zeros((0, k), np.uint32)
            if full.any():
                starts = first[:-1][full]
                h1[full] = np.add.reduceat(mix64(values), starts)
                h2[full] = np.add.reduceat(mix64(values ^ np.uint64(0x5851F42D4C957F2D)), starts)
                sig = minhash(values, np.append(starts, first[-1]), k)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(lo, n) for i in range(3)), pa.array(sizes), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                 lists(sig.reshape(-1).view(np.int32), sig_offsets, pa.int32())],
                names=_SIGNED.names,
            )


def signatures(rows: DataFrame, width: int = WIDTH, k: int = COORDINATES) -> DataFrame:
    """row, doc_id, t (hash of the text), n_shingles, 128-bit set digest (h1, h2), sig (empty for an empty set)."""
    return rows.select("row", "doc_id", F.xxhash64("text").alias("t"), "text").mapInArrow(lambda it: _sign(it, width, k), _SIGNED)


def rarest(postings: DataFrame, key: list[str], need: Column, what: DataFrame) -> DataFrame:
    """Prefix rule: of ``postings (rep, *key)`` the keys that two or more have, each rep's rarest s - need + 1.

    ``what`` holds one row per rep with the columns that ``need`` uses; a rep with fewer than ``need``
    shared keys has no row.  Gives rep, keys (all shared), weight (sum of their frequencies) and prefix.
    """
    shared = postings.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    entry = F.struct(F.col("_n").alias("n"), F.col(key[-1]).alias("key"))
    own = postings.join(shared, key).groupBy("rep").agg(F.sort_array(F.collect_list(entry)).alias("_p"))
    own = own.join(what, "rep").withColumn("_need", need).filter(F.size("_p") >= F.col("_need"))
    return own.select(
        *what.columns, F.col("_p.key").alias("keys"), F.aggregate("_p", F.lit(0).cast("long"), lambda t, x: t + x["n"]).alias("weight"),
        F.expr("slice(_p.key, 1, greatest(0, size(_p) - _need + 1))").alias("prefix"),
    )


def posting_prefixes(reps: DataFrame, matches: int) -> DataFrame:
    """(rep, n, keys, weight, prefix): each representative's shared signature postings and the rarest of them."""
    posted = reps.select("rep", F.posexplode("sig").alias("c", "v")).select(
        "rep", F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key")
    )
    return rarest(posted, ["key"], F.lit(matches), reps.select("rep", "n"))


def _sets(batch: pa.RecordBatch, width: int, held: dict[int, np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows (a, b, text of a, text of b), rows of one a together -> (a, b, set of a, set of b); ``held`` keeps the last a's set."""
    a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
    for lo, hi, data, offs in chunks(batch.column(3)):
        values, first = shingle_sets(data, offs, width)
        for r in range(lo, hi):
            if a[r] not in held:
                _, _, d, o = next(chunks(batch.column(2).slice(r, 1)))
                held.clear()
                held[a[r]] = shingle_sets(d, o, width)[0]
            yield int(a[r]), int(b[r]), held[a[r]], values[first[r - lo] : first[r - lo + 1]]


def _jaccard_links(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text of a, text of b) -> the pairs whose sets pass."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        out = []
        for a, b, x, y in _sets(batch, width, held):
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            both = np.concatenate((x, y))
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            if 100 * common >= percent * (len(both) - common):
                out.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(2)], names=["a", "b"])


def _added(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The same rows, a being a head -> rep (b), hub_n (|H|), gone (R, in H alone), added (X, in b alone)."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        out = [(b, len(x), np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)) for _, b, x, y in _sets(batch, width, held)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), _listed([o[2] for o in out]), _listed([o[3] for o in out])],
            names=["rep", "hub_n", "gone", "added"],
        )


def _listed(rows: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return lists(flat.view(np.int64), np.concatenate(([0], np.cumsum([len(r) for r in rows]))), pa.int64())


def with_texts(pairs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) with both texts of ``rows`` (row, text), the pairs of one a together; an a of very many pairs is dealt to several tasks.

    Only texts that a pair names are moved: while the pairs' ids are counted small, they go to the texts, not the texts to them.
    """
    pairs = scratch.write(pairs, "pairs")
    fan = scratch.write(pairs.groupBy("a").agg(F.expr(f"cast((count(1) - 1) div {FANOUT} + 1 as int)").alias("fan")), "fan")
    second = scratch.write(pairs.select("b").distinct(), "second")
    fan, second = if_small(fan), if_small(second)
    dealt = pairs.join(fan, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("fan")).cast("int"))
    left = rows.join(fan, F.col("row") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("part"), F.col("text").alias("at"))
    right = rows.join(second, F.col("row") == F.col("b")).select("b", F.col("text").alias("bt"))
    # sorted by a in every task, so that a's set is made once for all its pairs
    met = dealt.join(right, "b").join(left.hint("merge"), ["a", "part"])
    return met.select("a", "b", "at", "bt")


def confirm(pairs: DataFrame, rows: DataFrame, scratch: Scratch, width: int, percent: int) -> DataFrame:
    """Of the candidate pairs (a, b), those whose full shingle sets are similar enough."""
    return with_texts(pairs, rows, scratch).mapInArrow(lambda it: _jaccard_links(it, width, percent), "a long, b long").distinct()


def same_head_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components among documents with one head (see 5 above), decided on the full sets.

    ``members``: rep, component, hub, n (|A|), hub_n (|H|), gone (R), added (X); one row per rep.  As A = (H - R) + X,
    the sizes of R's union and X's intersection give |A n B| exactly.
    """
    over = 100 + percent
    least = members.groupBy("hub").agg(F.min("n").alias("least_n"))
    # the smallest partner a document can have, and the added shingles that a link to any partner needs
    m = (
        members.join(least, "hub")
        .withColumn("least_n", F.greatest("least_n", F.expr(f"cast(ceil({percent} * n / 100) as long)")))
        .withColumn("need", F.expr(f"cast(ceil({percent} * (n + least_n) / {over}) as int) - hub_n + size(gone)"))
    )
    carried = ("rep", "component", "n", "hub_n", "gone", "added")
    by_added = rarest(m.select("rep", "hub", F.explode("added").alias("key")), ["hub", "key"], F.greatest("need", F.lit(1)).cast("int"), m.select("hub", "need", *carried))
    posted = by_added.select(F.explode("prefix").alias("key"), "hub", "prefix", *carried)
    one, two = (posted.select("hub", "key", *(F.col(c).alias(f"{c}_{s}") for c in ("prefix", *carried))) for s in "ab")
    common = "(hub_n_a - size(array_union(gone_a, gone_b)) + size(array_intersect(added_a, added_b)))"
    linked = F.expr(f"100 * {common} >= {percent} * (n_a + n_b - {common})")
    most = "(hub_n_a - greatest(size(gone_a), size(gone_b)) + least(size(added_a), size(added_b)))"
    meets = F.expr(
        f"rep_a < rep_b and component_a <> component_b and 100 * {most} >= {percent} * (n_a + n_b - {most})"
        " and element_at(array_intersect(prefix_a, prefix_b), 1) = p.key"
    )
    found = one.alias("p").join(two.alias("q"), (F.col("p.hub") == F.col("q.hub")) & (F.col("p.key") == F.col("q.key")) & meets & linked).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    # no shared addition needed: n(a) + n(b) <= over / percent * (|H| - most left out); the one that leaves out more asks,
    # so each pair is met once, and only pairs that pass leave the join
    loose = m.filter("need <= 0")
    reach = F.expr(f"sequence(least_n, greatest(least_n, {over} * (hub_n - size(gone)) div {percent} - n))")
    asking = loose.withColumn("met_n", F.explode(reach)).select("hub", "met_n", *(F.col(c).alias(f"{c}_a") for c in carried))
    asked = loose.select("hub", *(F.col(c).alias(f"{c}_b") for c in ("rep", "component", "n", "gone", "added")))
    once = F.expr("component_a <> component_b and (size(gone_b) < size(gone_a) or (size(gone_b) = size(gone_a) and rep_b < rep_a))")
    close = asking.alias("p").join(asked.alias("q"), (F.col("p.hub") == F.col("q.hub")) & (F.col("met_n") == F.col("n_b")) & once & linked)
    return found.unionAll(close.select(F.least("rep_a", "rep_b"), F.greatest("rep_a", "rep_b"))).distinct()


def roots(hubs: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, hub), each hub more central than its rep -> the end of each chain (pointer doubling)."""
    cur, left = scratch.write(hubs, "hubs"), 1
    while left:
        up = cur.select(F.col("rep").alias("hub"), F.col("hub").alias("next"))
        nxt = scratch.write(cur.join(up, "hub", "left").select("rep", F.coalesce("next", "hub").alias("hub"), F.col("next").isNotNull().alias("moved")), "hubs")
        left = nxt.filter("moved").limit(1).count()
        scratch.drop(cur)
        cur = nxt.drop("moved")
        cur._scratch_path = nxt._scratch_path  # type: ignore[attr-defined]
    return cur


def numbered(docs: DataFrame, *more: str) -> DataFrame:
    """row (a number of its own, fixed once it is written), doc_id, text and ``more`` columns."""
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        *(F.col(c).alias(f"_{c}") for c in more))


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, percent: int = 75, k: int = COORDINATES, matches: int = MATCHES
) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept; one row per input row."""
    scratch = Scratch(docs.sparkSession, "neardup")
    out = grouped(numbered(docs), scratch, width, percent, k, matches)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def grouped(rows: DataFrame, scratch: Scratch, width: int = WIDTH, percent: int = 75, k: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """``rows`` (row, doc_id, text) -> row, doc_id, n_shingles, component_id and ``first``, the row that stands for the component
    (its smallest doc_id, then row); null ids have no component and stand for themselves.

    The rows are read twice: for the signatures, whose table fixes the row numbers, and for the texts of those that can meet another (found by doc_id and text)."""
    spark: SparkSession = rows.sparkSession
    rows = rows.select("row", "doc_id", "text")
    signed = scratch.write(signatures(rows, width, k), "signed")
    reps = scratch.write(
        signed.filter("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2")
        .agg(F.min("row").alias("rep"), F.min(F.struct("doc_id", "row")).alias("first"), F.any_value("n_shingles").alias("n"), F.any_value("sig").alias("sig")),
        "reps",
    )
    prefixes = scratch.write(posting_prefixes(reps, matches), "prefixes")
    lists_ = scratch.write(prefixes.select("rep", "weight", F.explode("prefix").alias("key")), "lists")
    # only rows that share a prefix posting can meet: their texts are picked once, every comparison joins this smaller table
    meeting = lists_.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    wanted = lists_.join(meeting, "key").select(F.col("rep").alias("row")).distinct().join(signed.select("row", "doc_id", "t"), "row")
    wanted = scratch.write(wanted.select("row", F.col("doc_id").alias("_id"), F.col("t").alias("_t")), "wanted")
    own = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_t"))
    texts = scratch.write(rows.select("doc_id", "text").join(if_small(wanted), own).select("row", "text"), "texts")

    def collide(pairs: DataFrame) -> DataFrame:
        """Pairs that agree in enough coordinates and whose sizes allow the similarity."""
        side = lambda s: prefixes.select(F.col("rep").alias(s), F.col("keys").alias(f"k{s}"), F.col("n").alias(f"n{s}"))
        pairs = scratch.write(pairs, "candidates")
        found = side("a").join(if_small(pairs), "a").join(side("b"), "b")
        ok = (F.size(F.array_intersect("ka", "kb")) >= matches) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        return found.filter(ok).select(*pairs.columns)

    head = F.max(F.struct("weight", F.xxhash64("rep").alias("h"), "rep"))
    heads = lists_.groupBy("key").agg(head.alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "head.weight", "head.h", F.col("head.rep").alias("head"))
    met = lists_.select("key", "rep").join(heads, "key").filter("rep <> head").groupBy("rep", "head").agg(F.first("weight").alias("weight"), F.first("h").alias("h"))
    met = scratch.write(collide(met.select(F.col("head").alias("a"), F.col("rep").alias("b"), "weight", "h")), "star")
    tested = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = scratch.write(confirm(tested, texts, scratch, width, percent), "links")
    comps = scratch.write(connected_components(spark, links, scratch), "components")

    placed = lists_.select("key", "rep").join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component")
    )
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    best = met.groupBy(F.col("b").alias("rep")).agg(F.max(F.struct("weight", "h", "a")).alias("hub"))
    own = prefixes.select("rep", F.struct("weight", F.xxhash64("rep").alias("h"), F.col("rep").alias("a")).alias("own"))
    # the head of a document: the most central one it met, then that one's, to the end; itself where it met none above it
    hubs = roots(best.join(own, "rep").filter("hub > own").select("rep", F.col("hub.a").alias("hub")), scratch)
    still = placed.join(mixed, "key").join(hubs, "rep", "left")
    still = scratch.write(still.select("key", "rep", "component", F.coalesce("hub", "rep").alias("hub")), "open")

    # different heads: a pair leaves the join once (at its first common posting) and only if its signatures collide often enough
    split = still.groupBy("key").agg(F.min("hub").alias("lo"), F.max("hub").alias("hi")).filter("lo <> hi").select("key")
    facing = still.join(split, "key").join(prefixes.select("rep", "keys", "prefix", "n"), "rep")
    left, right = (facing.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "component", "hub", "keys", "prefix", "n"))) for s in "ab")
    meets = F.expr(
        "rep_a < rep_b and component_a <> component_b and hub_a <> hub_b"
        f" and least(n_a, n_b) * 100 >= greatest(n_a, n_b) * {percent}"
        " and element_at(array_intersect(prefix_a, prefix_b), 1) = p.key"
        f" and size(array_intersect(keys_a, keys_b)) >= {matches}"
    )
    apart = left.alias("p").join(right.alias("q"), (F.col("p.key") == F.col("q.key")) & meets).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    across = scratch.write(apart.join(tested, ["a", "b"], "left_anti"), "across")
    members = still.select("rep", "component", "hub").distinct().join(prefixes.select("rep", "n"), "rep")
    away = members.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    changes = with_texts(away, texts, scratch).mapInArrow(
        lambda it: _added(it, width), "rep long, hub_n long, gone array<long>, added array<long>"
    ).dropDuplicates(["rep"])
    none = F.expr("cast(array() as array<long>)")
    itself = members.filter("rep = hub").withColumns({"hub_n": F.col("n"), "gone": none, "added": none})
    members = scratch.write(members.join(changes, "rep").unionByName(itself), "members")
    late = scratch.write(confirm(across, texts, scratch, width, percent).unionAll(same_head_links(members, percent)), "late")
    if not late.isEmpty():
        comps = scratch.write(connected_components(spark, links.unionAll(late), scratch), "components")

    classes = reps.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("h1", "h2", "first", F.coalesce("component", "rep").alias("component"))
    classes = scratch.write(classes, "classes")
    firsts = classes.groupBy("component").agg(F.min("first").alias("first"))
    classes = classes.drop("first").join(firsts, "component").select("h1", "h2", F.col("first.doc_id").alias("component_id"), F.col("first.row").alias("first"))
    mine = F.col("doc_id").isNotNull() & F.col("component_id").isNotNull()
    return signed.drop("sig").join(classes, ["h1", "h2"], "left").select(
        "row", "doc_id", "n_shingles", F.when(mine, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(mine, F.col("first")).otherwise(F.col("row")).alias("first"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay: one row per group of near-duplicates (its smallest doc_id, then the first row), all columns as given.

    Rows with a null doc_id and rows without words stay, but for a row without words that repeats a doc_id without words.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = scratch.write(numbered(docs, *rest), "rows")
    found = grouped(rows, scratch)
    blank = found.filter("n_shingles = 0 and doc_id is not null").groupBy("doc_id").agg(F.min("row").alias("stays"))
    stays = found.filter("first = row and (n_shingles > 0 or doc_id is null)").select(F.col("row").alias("stays")).unionAll(blank.select("stays"))
    types = dict(docs.dtypes)
    kept = rows.join(stays, F.col("row") == F.col("stays"), "left_semi")
    return kept.select(*(F.col(c if c in ("doc_id", "text") else f"_{c}").cast(types[c]).alias(c) for c in docs.columns))
