"""MinHash near-duplicates by an inverted join on signature coordinates.

1. A document's set holds the 64-bit hashes of its distinct word shingles; its signature
   has K coordinates. Documents with equal sets are one class, and only its least id goes on.
2. Every class is posted under each of its coordinate-value pairs. Pairs that nobody shares
   cannot collide and go; a class that shares fewer than T pairs has no partner and goes.
3. Prefix: two classes that collide T times or more share one of the m - T + 1 rarest of
   their m shared pairs, in the global order by posting length. Only this prefix is posted.
4. Skip merging: most postings within a group of copies say the same thing again. First each
   class is compared to one pivot of its lists, and linked classes are united. Then classes
   outside the main component of a list are compared to a few of its members, again while
   that finds links. Only lists that still hold several components are merged, and only pairs
   across components are counted: by a join in lists of at most ``short``, else in blocks.
5. Pairs with T collisions are confirmed on the full sets (blocks compare full sets at once);
   links unite into components.

No group's pairs are all emitted, yet no link between components is lost: a pair that is
never compared is one whose ends are already in one component. Whatever is confirmed is
confirmed exactly; a link of similarity s is missed only if its two signatures agree in
fewer than T of K coordinates: with K = 40 and T = 20 about 5 in a million at s = 0.8.

Defined results: null and empty texts, and texts of white space alone, have an empty set
and link with nothing; a text of fewer words than a shingle is one shingle; rows that share
a doc_id are one document whose texts all count; rows with a null doc_id link with nothing,
have a null component and are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Shelf, few_ids, hot_keys, spread_join, table, trim
from .components import components

SHINGLE_WORDS, PERCENT = 5, 80
K, T = 40, 20
SHORT, BLOCK, BLOCK_CHARS = 48, 256, 1 << 21
#: Pivots a class meets in one turn, and turns at most before lists are merged in full.
PIVOTS, MOST_TURNS = 4, 6
#: Turns go on while one in so many of the colliding pairs that they met was a link.
WORTHWHILE = 20
CACHE_WORDS = 200_000
_U = np.uint64
# Odd multipliers of the K coordinates, from a fixed seed.
_A = np.random.default_rng(20240229).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_B = np.random.default_rng(77).integers(0, 1 << 63, 64, dtype=np.uint64)
_words: dict[bytes, int] = {}


def _rest() -> None:
    """What a worker does at the end of a task."""
    _words.clear()
    trim()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes. Bytes lower() and split() are exactly A-Z and
    the white space of the word definition."""
    if not text:
        return np.empty(0, np.uint64)
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    get, h = _words.get, xxhash.xxh3_64_intdigest
    if len(_words) > CACHE_WORDS:
        _words.clear()
    ids = list(map(get, parts))
    if None in ids:
        for i, v in enumerate(ids):
            if v is None:
                ids[i] = _words[parts[i]] = h(parts[i])
    w = np.array(ids, np.uint64)
    n = min(words, len(w))
    x = np.full(len(w) - n + 1, n, np.uint64)
    for j in range(n):
        x = _mix(x * _U(0x9E3779B97F4A7C15) + w[j : len(w) - n + 1 + j])
    return np.unique(x)


def signature(s: np.ndarray, k: int = K) -> np.ndarray:
    """Coordinate-value pairs as longs: the least hash under each multiplier, its low six bits
    replaced by the coordinate."""
    out = np.empty(k, np.uint64)
    for i in range(k):
        out[i] = (s * _A[i] + _B[i]).min()
    return ((out & ~_U(63)) | np.arange(k, dtype=np.uint64)).view(np.int64)


#: Four coordinates travel in a long: 14 bits of each, and a bit that a sum carries into.
LANE, LANES = 15, 4
_SHIFT = np.array([LANE * i for i in range(LANES)], np.uint64)
CARRY = sum(1 << (LANE * i + LANE - 1) for i in range(LANES))
FILL = sum(((1 << (LANE - 1)) - 1) << (LANE * i) for i in range(LANES))


def short_signature(toks: np.ndarray) -> np.ndarray:
    """14 bits of every coordinate, four in a long (K is padded with zeros to whole longs). Unlike
    values agree in one of 16,384; what agrees is confirmed on full sets."""
    v = np.zeros(-(-len(toks) // LANES) * LANES, np.uint64)
    v[: len(toks)] = (toks.view(np.uint64) >> _U(6)) & _U((1 << (LANE - 1)) - 1)
    return (v.reshape(-1, LANES) << _SHIFT).sum(1, dtype=np.uint64).view(np.int64)


def _unlike(a: str, b: str, k: int):
    """In how many of k coordinates two short signatures differ: a lane of their exclusive or that
    is not zero carries."""
    x = [F.col(a)[i].bitwiseXOR(F.col(b)[i]) for i in range(-(-k // LANES))]
    return reduce(lambda p, q: p + q, [F.bit_count((y + F.lit(FILL)).bitwiseAND(F.lit(CARRY))) for y in x])


def _signed(docs: DataFrame, words: int, k: int) -> DataFrame:
    """(doc_id, n, k1, k2, toks, sig): set size, 128 bits that identify the set, signature in full
    and short."""
    longs = pa.list_(pa.int64())

    def run(batches):
        for batch in batches:
            n, k1, k2, toks, sig = [], [], [], [], []
            for t in batch.column("text").to_pylist():
                s = shingle_set(t, words)
                a, b = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64).tolist() if len(s) else (None, None)
                n.append(len(s))
                k1.append(a)
                k2.append(b)
                toks.append(signature(s, k) if len(s) else None)
                sig.append(short_signature(toks[-1]) if len(s) else None)
            made = [pa.array(x, pa.int64()) for x in (n, k1, k2)] + [pa.array(x, longs) for x in (toks, sig)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "n", "k1", "k2", "toks", "sig"])
        _rest()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, toks array<long>, sig array<long>")


def _hot_ends(pairs: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """The hot keys among the written pairs' ends."""
    total = pairs.count()
    return tuple(hot_keys(pairs.groupBy(c).agg(F.count("*").alias("n")), [c], total) for c in "ab")


def _collide(pairs: DataFrame, sigs: DataFrame, t: int, k: int, percent: int, shelf: Shelf) -> DataFrame:
    """The pairs whose sizes allow a link and whose signatures agree in t coordinates or more."""
    pairs = shelf.put(pairs)
    hot_a, hot_b = _hot_ends(pairs)
    left, right = (sigs.select(F.col("doc").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")) for x in "ab")
    both = spread_join(spread_join(pairs, left, ["a"], "b", hot_a), right, ["b"], "a", hot_b)
    sized = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    out = shelf.put(both.where(sized & (_unlike("sa", "sb", k) <= k - t)).select("a", "b").distinct())
    shelf.drop(pairs)
    return out


class _Texts:
    """Whole texts of some ids, straight from the source. Up to BROADCAST_IDS ids go to the scan;
    beyond that the texts of all that may ever be asked for are written once and joined."""

    def __init__(self, docs: DataFrame, live: DataFrame, shelf: Shelf):
        self.docs, self.live, self.shelf = docs.select(F.col("doc_id").alias("doc"), "text"), live, shelf
        self.held: DataFrame | None = None

    def of(self, ids: DataFrame) -> DataFrame:
        """Written (doc, text) of written ids (doc)."""
        if ids.count() <= BROADCAST_IDS:
            return self.shelf.put(self.docs.join(F.broadcast(ids), "doc", "left_semi"))
        if self.held is None:
            self.held = self.shelf.put(self.docs.join(self.live, "doc", "left_semi"))
        return self.shelf.put(self.held.join(ids, "doc", "left_semi"))


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union on full sets. Texts travel, not sets:
    compressed they are half as large, and a set takes a fraction of a millisecond to make."""
    hot_a, hot_b = _hot_ends(pairs)
    left, right = (texts.select(F.col("doc").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    both = spread_join(spread_join(pairs, left, ["a"], "b", hot_a), right, ["b"], "a", hot_b).select("a", "b", "ta", "tb")

    def run(batches):
        last, held = None, None
        for pdf in batches:
            ok = []
            for ta, tb in zip(pdf["ta"], pdf["tb"], strict=True):
                if tb != last:  # rows come by b: its set is made once
                    last, held = tb, shingle_set(tb, words)
                s = shingle_set(ta, words)
                i = len(np.intersect1d(s, held, assume_unique=True)) if 100 * min(len(s), len(held)) >= percent * max(len(s), len(held)) else 0
                ok.append(i * 100 >= (len(s) + len(held) - i) * percent)
            yield pdf.loc[ok, ["a", "b"]]
        _rest()

    return both.mapInPandas(run, "a long, b long")


def _main(p: DataFrame, turn: int) -> DataFrame:
    """(tok, n, main, held, pivots) of the lists with several components: size, largest component,
    its size, and a few of its members. A pivot is the least id after an exclusive or with a
    number of the turn, so that picking them is an ordinary partial aggregate."""
    salts = np.random.default_rng(1000 + turn).integers(1, 1 << 62, PIVOTS).tolist()
    per = p.groupBy("tok", "comp").agg(F.count("*").alias("n"), *[F.min(F.col("doc").bitwiseXOR(F.lit(c))).alias(f"p{j}") for j, c in enumerate(salts)])
    pivots = F.array(*[F.col(f"p{j}").bitwiseXOR(F.lit(c)) for j, c in enumerate(salts)])
    top = F.max_by(F.struct("comp", "n", pivots.alias("pivots")), F.struct("n", "comp"))
    return per.groupBy("tok").agg(F.sum("n").alias("n"), F.count("*").alias("comps"), top.alias("x")).where("comps > 1").select("tok", "n", F.col("x.comp").alias("main"), F.col("x.n").alias("held"), F.col("x.pivots").alias("pivots"))


def _outsiders(p: DataFrame, main: DataFrame, total: int, turn: int) -> DataFrame:
    """(a, b): each class outside the main component of a list with PIVOTS of its members, in one
    of its lists: first that of the largest component, then by turns. ``main`` is written."""
    hot = hot_keys(main, ["tok"], total)
    order = F.col("held") if turn == 0 else F.xxhash64("tok", F.lit(turn))
    away = spread_join(p, main.select("tok", "main", "held"), ["tok"], "doc", hot).where("comp <> main")
    pick = away.groupBy("doc").agg(F.max_by("tok", order).alias("tok"))
    return spread_join(pick, main.select("tok", "pivots"), ["tok"], "doc", hot).select(F.col("doc").alias("a"), F.explode("pivots").alias("b")).distinct()


def _counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of every two sets, as products of 0/1 matrices over shared elements."""
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, len(shared), 4096):
        part = shared[k : k + 4096]
        sides = []
        for sets in (left, right):
            m = np.zeros((len(sets), len(part)), np.float32)
            for r, s in enumerate(sets):
                x = np.searchsorted(part, s[(s >= part[0]) & (s <= part[-1])])
                ok = s[(s >= part[0]) & (s <= part[-1])]
                hit = part[np.minimum(x, len(part) - 1)] == ok
                m[r, x[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _long_lists(posts: DataFrame, fetch: _Texts, shelf: Shelf, words: int, percent: int) -> DataFrame:
    """Links (a, b) across components from lists of any length. ``posts`` has doc, comp and the
    list's main component.

    Lists with one main component hold much the same classes, so they are merged as one: every
    class that stands outside is compared to every class of these lists, on full sets, block
    by block. A block holds about BLOCK texts, or BLOCK_CHARS characters of longer ones; it travels
    once for each block that it meets, and a pair of blocks is a task row of its own. Of a class's
    links into one component one comes out."""
    all_ = shelf.put(posts.groupBy("main", "doc").agg(F.first("comp").alias("comp")))
    texts = fetch.of(shelf.put(all_.select("doc").distinct()))
    # How many times a class is listed is bounded by its posts, so joining by class has no hot key.
    rich = shelf.put(all_.join(texts, "doc").withColumn("h", F.xxhash64("doc")))
    parts = lambda rows, chars: F.ceil(F.greatest(F.sum(rows) / BLOCK, F.sum(chars) / BLOCK_CHARS)).cast("int")
    out, chars = F.when(F.col("comp") != F.col("main"), 1).otherwise(0), F.length("text")
    size = shelf.put(rich.groupBy("main").agg(F.count("*").alias("n"), parts(F.lit(1), chars).alias("nb"), F.greatest(F.lit(1), parts(out, out * chars)).alias("no")))
    rich = spread_join(rich, size.select("main", "nb", "no"), ["main"], "doc", hot_keys(size, ["main"], rich.count()))
    one = F.collect_list(F.struct("doc", "comp", "text"))
    whole = rich.withColumn("ub", F.pmod("h", "nb")).groupBy("main", "ub").agg(one.alias("right"))
    outside = rich.where("comp <> main").withColumn("ob", F.pmod("h", "no")).groupBy("main", "nb", "ob").agg(one.alias("left"))
    outside = outside.select("main", F.explode(F.expr("sequence(0L, nb - 1L)")).alias("ub"), "left")
    meet = outside.join(whole, ["main", "ub"]).select("left", "right")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                left, right = row["left"], row["right"]
                sl, sr = ([shingle_set(x["text"], words) for x in side] for side in (left, right))
                both = _counts(sl, sr)
                union = np.array([len(s) for s in sl])[:, None] + np.array([len(s) for s in sr])[None] - both
                comps = np.array([x["comp"] for x in right])
                a, b = [], []
                for i, x in enumerate(left):
                    hit = np.nonzero((both[i] * 100 >= union[i] * percent) & (comps != x["comp"]))[0]
                    for j in hit[np.unique(comps[hit], return_index=True)[1]]:
                        a.append(x["doc"])
                        b.append(right[j]["doc"])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        _rest()

    return meet.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, words: int = SHINGLE_WORDS, percent: int = PERCENT, k: int = K, t: int = T, short: int = SHORT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    shelf = Shelf(docs.sparkSession, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = shelf.put(_signed(docs, words, k))
    rows = signed.count()
    some = signed.where("n > 0 AND doc_id IS NOT NULL")
    # Classes of several rows, and the rows that are not the least of their class.
    key = ["k1", "k2"]
    classes = shelf.put(some.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1"))
    large = hot_keys(classes, key, rows, "c")
    copies = shelf.put(spread_join(some.select("doc_id", *key), classes.select(*key, "rep"), key, "doc_id", large).where("doc_id <> rep").select("doc_id", "k1"))
    reps = some.join(few_ids(copies), ["doc_id", "k1"], "left_anti").select(F.col("doc_id").alias("doc"), "n", "toks", "sig")

    # Postings: pairs that two classes or more share, then the rarest m - t + 1 of a class.
    posted = reps.select("doc", F.explode("toks").alias("tok"))
    shared = shelf.put(posted.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1"))
    ranked = spread_join(posted, shared, ["tok"], "doc", hot_keys(shared, ["tok"], rows * k, "c")).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("c", "tok"))).alias("l")).where(F.size("l") >= t)
    posts = shelf.put(ranked.select("doc", F.explode(F.expr(f"slice(l, 1, size(l) - {t - 1})")).alias("x")).select("doc", F.col("x.tok").alias("tok")))
    shelf.drop(shared)
    n_posts = posts.count()
    live = shelf.put(posts.select("doc").distinct())
    sigs = shelf.put(reps.join(few_ids(live), "doc", "left_semi").select("doc", "n", "sig"))
    fetch = _Texts(docs, live, shelf)

    def labelled(comp: DataFrame) -> DataFrame:
        return posts.join(comp, F.col("doc") == F.col("id"), "left").select("doc", "tok", F.coalesce("component", "doc").alias("comp"))

    def confirmed(star: DataFrame) -> tuple[int, int, DataFrame]:
        """Pairs that collide, links among them, and the links. Only texts of those pairs travel."""
        pairs = _collide(star, sigs, t, k, percent, shelf)
        ids = shelf.put(pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct())
        texts = fetch.of(ids)
        found = shelf.put(_confirm(pairs, texts, words, percent))
        met, linked = pairs.count(), found.count()
        shelf.drop(pairs, ids, texts)
        return met, linked, found

    def joined(comp: DataFrame, *links: DataFrame, settle: bool = True) -> DataFrame:
        edges = reduce(DataFrame.union, links, comp.select(F.col("id").alias("a"), F.col("component").alias("b")))
        out = components(edges, shelf, settle=settle)
        shelf.drop(comp, *links)
        return out

    # First every class meets one pivot, the least of its lists.
    least = shelf.put(posts.groupBy("tok").agg(F.min("doc").alias("p"), F.count("*").alias("n")))
    star = spread_join(posts, least.select("tok", "p"), ["tok"], "doc", hot_keys(least, ["tok"], n_posts)).where("doc <> p")
    _, _, found = confirmed(star.groupBy("doc").agg(F.min("p").alias("p")).select(F.col("doc").alias("a"), F.col("p").alias("b")))
    comp = components(found, shelf, settle=False)
    shelf.drop(least, found)
    # Then those outside their list's main component meet a few more of its members, as long as
    # that finds links: a group of copies ends as one component and a few that stand apart.
    # Labels need not settle in between: what shares one is in one component.
    for turn in range(MOST_TURNS):
        p = shelf.put(labelled(comp))
        main = shelf.put(_main(p, turn))
        met, linked, found = confirmed(_outsiders(p, main, n_posts, turn))
        shelf.drop(p, main)
        if linked:
            comp = joined(comp, found, settle=False)
        if linked * WORTHWHILE < met or not linked:
            break
    # What is left open is merged in full: every class with those of other components.
    comp = joined(comp)
    p = shelf.put(labelled(comp))
    main = shelf.put(_main(p, 0))
    open_ = shelf.put(spread_join(p, main.select("tok", "n", "main"), ["tok"], "doc", hot_keys(main, ["tok"], n_posts)).select("tok", "doc", "comp", "n", "main"))
    shelf.drop(p, main, posts)
    near = open_.where(f"n <= {short}")
    other = near.where("comp <> main").select("tok", F.col("doc").alias("doc2"), F.col("comp").alias("comp2"))
    pairs = near.join(other, "tok").where("comp <> comp2").select(F.least("doc", "doc2").alias("a"), F.greatest("doc", "doc2").alias("b")).distinct()
    _, _, found = confirmed(pairs)
    more = shelf.put(_long_lists(open_.where(f"n > {short}").select("main", "doc", "comp"), fetch, shelf, words, percent))
    comp = joined(comp, found, more)
    shelf.drop(open_, sigs, live)

    # Labels: by class for rows of classes, by id for all others; no row joins on a null.
    cols = ["doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")]
    of_class = shelf.put(classes.join(comp, F.col("rep") == F.col("id"), "left").select(*key, "c", F.coalesce("component", "rep").alias("component")))
    inner = spread_join(some.select("doc_id", "n", *key), of_class.select(*key, "component"), key, "doc_id", large).select(*cols)
    alone = some.select("doc_id", "n", *key)
    alone = (alone.join(few_ids(of_class.select(*key)), key, "left_anti") if large is None else spread_join(alone, of_class.select(*key, F.lit(True).alias("x")), key, "doc_id", large, "left").where("x IS NULL"))
    alone = alone.join(comp, F.col("doc_id") == F.col("id"), "left").withColumn("component", F.coalesce("component", "doc_id")).select(*cols)
    bare = signed.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return inner.union(alone).union(bare).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """One document of each component, with all columns of ``docs``. Rows that share a doc_id are
    documents of their own, in the order of id and text: the first of a component stays, and the
    first of those of one id without shingles. Rows with a null doc_id stay."""
    named = docs.where("doc_id IS NOT NULL")
    n = named.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).first()
    if n["n"] == n["d"]:
        gone = Shelf(docs.sparkSession, "gone").put(near_duplicates(docs, **how).where("NOT kept").select(F.col("doc_id").alias("_gone")))
        out = named.join(few_ids(gone), F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
    else:
        at = "_place_" + "_".join(docs.columns)  # no column of docs has this name
        order = [c for c in docs.columns if c not in ("doc_id", "text")]
        rows = Shelf(docs.sparkSession, "places").put(named.sort("doc_id", "text", *[F.col(f"`{c}`") for c in order]).withColumn(at, F.monotonically_increasing_id()))
        seen = near_duplicates(rows.select(F.col(f"`{at}`").alias("doc_id"), "text"), **how).where("kept").select(F.col("doc_id").alias("p"), "n_shingles")
        bare = rows.select("doc_id", F.col(f"`{at}`").alias("q")).join(seen.where("n_shingles = 0"), F.col("q") == F.col("p")).groupBy("doc_id").agg(F.min("q").alias("p"))
        keep = seen.where("n_shingles > 0").select("p").union(bare.select("p"))
        out = rows.join(keep, rows[at] == keep["p"], "left_semi").drop(at)
    return out.unionByName(docs.where("doc_id IS NULL"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END) AS g FROM w),
z AS (SELECT g, count(*) AS df FROM s GROUP BY g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT s.doc_id, s.g, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY z.df, s.g) AS pos FROM s JOIN z USING (g) JOIN n USING (doc_id)),
p AS (SELECT * FROM r WHERE pos <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80),
l AS (SELECT c.a, c.b FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.g = x.g GROUP BY c.a, c.b, c.na, c.nb HAVING count(*) * 100 >= (c.na + c.nb - count(*)) * 80),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT reach.v, e.b FROM reach JOIN e ON e.a = reach.u)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.u) AS component_id, d.doc_id = min(reach.u) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.v = d.doc_id GROUP BY d.doc_id
"""
