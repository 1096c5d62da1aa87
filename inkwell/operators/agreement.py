"""Correlation and agreement statistics, set precision and recall, separation of features.

Ranks come from counts of equal values within ranges of a group's values, so no window sees a whole group; pairs of annotators
meet block by block, in bounded matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import files


def pearson(x: str, y: str) -> Column:
    """Aggregate: the correlation, null under two rows or where either side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    varied = (F.count(a) >= 2) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(varied, F.try_divide(F.covar_pop(a, b), spread))


def average_ranks(df: DataFrame, by: list[str], value: str, name: str, parts: int = 64) -> DataFrame:
    """Adds the average rank of the number ``value`` within each group.

    A group's distinct values are cut into ranges at ``parts`` quantiles; a window ranks within a range, and the sizes of the
    ranges below it, a few numbers for each group, give where it starts.  So a large group is sorted by many tasks.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_k"))
    edges = counts.groupBy(*by).agg(F.percentile_approx(F.col(value).cast("double"), [k / parts for k in range(1, parts)], 20 * parts).alias("_e"))
    placed = counts.join(edges, by).withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col(value)))).drop("_e")
    sizes = placed.groupBy(*by, "_b").agg(F.sum("_k").alias("_s"))
    below = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, "_b", F.coalesce(F.sum("_s").over(below), F.lit(0)).alias("_o"))
    w = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = placed.join(starts, [*by, "_b"]).select(*by, value, (F.col("_o") + F.coalesce(F.sum("_k").over(w), F.lit(0)) + (F.col("_k") + 1) / 2).alias(name))
    return df.join(ranks, [*by, value])


def spearman(df: DataFrame, by: list[str], x: str, y: str, name: str = "rho", least: int = 2) -> DataFrame:
    """by, n, rho: the correlation of average ranks in each group; null under ``least`` rows or where a side is constant."""
    clean = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double"))).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = average_ranks(average_ranks(clean, by, "_x", "_rx"), by, "_y", "_ry")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), pearson("_rx", "_ry").alias("_rho")).select(*by, "n", F.when(F.col("n") >= least, F.col("_rho")).alias(name))


#: Ratings in a block of annotators, as expected; an annotator with more than an eighth of it meets the others in joins.
MOST_RATINGS = 4_000_000
#: Annotators in a block, as expected, where there are few; blocks that are enough to keep a cluster busy, where ratings allow.
BLOCK, BLOCKS = 128, 12
#: Items in a tile, as expected; places within it fit 16 bits.
TILE = 24_000
#: Ratings of an annotator up to which it is held against the others as a list, to find those with the same ratings.
WIDEST = 50_000
#: Entries of a matrix that ranks are taken in.
AT_ONCE = 1 << 20
#: Items of two blocks up to which ranks are sums of signs, and annotators of either block that are taken at once.
FEW_ITEMS, LINES, COLUMNS = 512, 128, 128


def annotator_pairs(ratings: DataFrame, item: list[str], least: int = 3, block: int = BLOCK, most: int = MOST_RATINGS, tile: int = TILE, weight: str | None = None) -> DataFrame:
    """a, b, n, rho for each two annotators (annotator, item, rating) with ``least`` items in common, a < b.

    There are as many pairs as annotators squared, so that is what it costs; but ratings don't meet item by item.  Items that
    two annotators have rated get a number, ratings their rank within the annotator, annotators a block: about ``block`` of them
    to each, but no more than BLOCKS blocks, unless these have more than ``most`` ratings.  Each two blocks meet in one task, so a
    rating is sent once for each block.  An annotator with more than ``most`` / 8 ratings is in no block: its pairs
    are joined by item, and ranks come from ranges of values (``spearman``), so no task holds all its ratings either.

    With ``weight``, a column with a number for each annotator, no pair leaves its task: the result is ``sums`` of the pairs, each
    counted as often as the product of its two weights, a row for each two blocks.

    Of repeated ratings of an item by one annotator the mean counts; null and NaN ratings and null annotators don't.
    """
    spark, where = ratings.sparkSession, files.folder(ratings.sparkSession, "annotators")
    clean = ratings.where(F.col("rating").isNotNull() & ~F.isnan(F.col("rating").cast("double")) & F.col("annotator").isNotNull())
    weighed = F.max(weight).cast("double") if weight else F.lit(1.0)
    # Grouped by the items themselves, ratings that were dealt out by them or by annotator stay where they are.
    once = clean.groupBy("annotator", *item).agg(F.avg(F.col("rating").cast("double")).alias("_mean"), weighed.alias("_w"))
    once.select("annotator", F.xxhash64(*item).alias("item"), F.col("_mean").alias("rating"), F.col("_w").alias("w")).write.parquet(f"{where}/once")
    once = spark.read.parquet(f"{where}/once")
    shared = once.groupBy("item").agg(F.count("*").alias("k")).where("k > 1").select("item")
    tiles = max(1, -(-shared.count() // tile))
    place = F.row_number().over(Window.partitionBy("tile").orderBy("item")) - 1
    places = shared.withColumn("tile", F.pmod("item", F.lit(tiles)).cast("int")).withColumn("at", place.cast("smallint"))
    once.join(places, "item").select("annotator", "w", "tile", "at", "rating").write.parquet(f"{where}/placed")
    placed = spark.read.parquet(f"{where}/placed")
    placed.groupBy("annotator").agg(F.count("*").alias("k"), F.max("w").alias("w")).withColumn("wide", F.col("k") > most // 8).write.parquet(f"{where}/sizes")
    files.remove(spark, f"{where}/once")
    sizes = spark.read.parquet(f"{where}/sizes")
    narrow, total, longest, wide = sizes.agg(F.count_if(~F.col("wide")), F.sum(F.when(~F.col("wide"), F.col("k"))), F.max(F.when(~F.col("wide"), F.col("k"))), F.count_if("wide")).head()
    blocks = max(1, min(-(-narrow // block), BLOCKS), -(-(total or 0) // most))
    kept = placed.join(sizes.where("NOT wide").select("annotator"), "annotator", "left_semi") if wide else placed
    kind = dict(ratings.dtypes)["annotator"]

    # Ranks depend on the order of an annotator's ratings alone.  Both numbers are as short as they can be, as they are sent often.
    number = F.col("at") if tiles == 1 else (F.col("tile").cast("long") * 32768 + F.col("at")).cast("int" if tiles < 65536 else "long")
    order = F.rank().over(Window.partitionBy("annotator").orderBy(F.col("rating") + 0.0)).cast("smallint" if (longest or 0) < 32768 else "int")
    numbered = kept.select("annotator", "w", number.alias("item"), order.alias("rank"))
    held = numbered.groupBy("annotator").agg(F.max("w").alias("w"), F.collect_list(F.struct("item", "rank")).alias("r")).select("annotator", "w", F.col("r.item").alias("items"), F.col("r.rank").alias("ranks"))
    dealt = held.withColumn("own", F.pmod(F.xxhash64("annotator"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("annotator", "w", "items", "ranks", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("second"))
    # Small rows, much work: more partitions than pairs of blocks, so that few get two, which adaptive execution would put together.
    met = dealt.repartition(min(4096, 2 * blocks * (blocks + 1)), "low", "high").groupBy("low", "high")
    one = placed.join(sizes.where("wide").select("annotator"), "annotator", "left_semi").select("tile", "at", F.col("annotator").alias("x"), F.col("rating").alias("p"))
    two = placed.join(sizes.select("annotator", "wide"), "annotator").select("tile", "at", F.col("annotator").alias("y"), F.col("rating").alias("q"), "wide")
    each = one.join(two, ["tile", "at"]).where((F.col("x") < F.col("y")) | (~F.col("wide") & (F.col("x") > F.col("y"))))
    each = each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "p", "q")
    joined = spearman(each, ["a", "b"], "p", "q", "rho", least).where(F.col("n") >= least).select("a", "b", "n", "rho")
    if weight:
        out = met.applyInArrow(lambda rows: _summed(rows, least), "n double, total double, some double, low double, high double")
        weights = sizes.select(F.col("annotator").alias("a"), F.col("w").alias("v")), sizes.select(F.col("annotator").alias("b"), "w")
        return out.unionByName(sums(joined.join(weights[0], "a").join(weights[1], "b").select("rho", (F.col("v") * F.col("w")).alias("n")))) if wide else out
    out = met.applyInArrow(lambda rows: _listed(rows, least), f"x {kind}, y {kind}, n long, rho double")
    out = out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n", "rho")
    return out.unionByName(joined) if wide else out


def sums(pairs: DataFrame) -> DataFrame:
    """n, total, some, low, high of rows (rho, n), each of which stands for n pairs: pairs, the sum of their rhos, pairs with one, its range; null in an empty table."""
    rho, n = F.col("rho"), F.col("n")
    return pairs.agg(F.sum(n).alias("n"), F.sum(rho * n).alias("total"), F.sum(F.when(rho.isNotNull(), n)).alias("some"), F.min(rho).alias("low"), F.max(rho).alias("high"))


def _meetings(rows: pa.Table, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows i of one block, rows j of the other (or the same), their matrix of common items, zero where i and j don't meet, and of rhos, NaN where there is none."""
    second = rows.column("second").to_numpy()
    same = rows.column("low")[0].as_py() == rows.column("high")[0].as_py()
    lists, ranks = rows.column("items").combine_chunks(), rows.column("ranks").combine_chunks().flatten().to_numpy()
    line, items = np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
    codes = np.unique(items) if same else np.intersect1d(items[~second[line]], items[second[line]])
    if not len(codes):
        return
    at = np.minimum(np.searchsorted(codes, items), len(codes) - 1)
    hit = codes[at] == items
    line, at, ranks = line[hit], at[hit], ranks[hit].astype(np.int32)
    starts = np.searchsorted(line, np.arange(len(rows) + 1))
    enough = np.diff(starts) >= max(1, least)
    left, right = np.flatnonzero(enough & ~second), np.flatnonzero(enough & (second | same))
    yield from (_by_signs if len(codes) <= FEW_ITEMS else _by_sorting)(line, at, ranks, starts, len(codes), left, right, same, least)


def _by_signs(line, at, ranks, starts, width, left, right, same, least):
    """Twice an item's rank less the mean rank is the number of common items rated lower, less those rated higher: a product of signs and a mask.

    All of these are whole numbers, and their sums of products too, which single precision holds exactly for up to 256 items.
    """
    kind = np.float32 if width <= 256 else np.float64

    def mask(some: np.ndarray) -> np.ndarray:
        out = np.zeros((width, len(some)), dtype=kind)
        for k, i in enumerate(some):
            out[at[starts[i] : starts[i + 1]], k] = 1
        return out

    def signs(i: int) -> tuple[np.ndarray, np.ndarray]:
        r = ranks[starts[i] : starts[i + 1]].astype(kind)
        return at[starts[i] : starts[i + 1]], np.sign(r[:, None] - r[None, :])

    for top in range(0, len(left), LINES):
        i = left[top : top + LINES]
        mine, theirs = mask(i), [signs(x) for x in i]
        p = np.zeros((COLUMNS, width, len(i)), dtype=kind)
        for first in range(top // COLUMNS * COLUMNS if same else 0, len(right), COLUMNS):
            j = right[first : first + COLUMNS]
            others = mask(j)
            n = (mine.T @ others).astype(np.int64)
            pp, qq, pq = (np.empty((len(i), len(j))) for _ in range(3))
            for k, (own, sign) in enumerate(theirs):
                both = others[own]
                x = (sign @ both) * both
                pp[k] = np.einsum("ab,ab->b", x, x)
                p[: len(j), own, k] = x.T
            for k, y in enumerate(j):
                own, sign = signs(y)
                both = mine[own]
                y = (sign @ both) * both  # zero where the other has no such item, whatever is left in p
                qq[:, k] = np.einsum("ab,ab->b", y, y)
                pq[:, k] = np.einsum("ab,ab->b", y, p[k, own])
            if same:
                n[i[:, None] >= j[None, :]] = 0
            spread = np.sqrt(pp * qq)
            yield i, j, n, np.divide(pq, spread, out=np.full(n.shape, np.nan), where=spread > 0)


def _by_sorting(line, at, ranks, starts, width, left, right, same, least):
    """Those with enough in common with an annotator are found by item and ranked against it, within AT_ONCE entries."""
    wanted = np.zeros(len(starts) - 1, dtype=bool)
    wanted[right] = True
    there = np.flatnonzero(wanted[line])
    there = there[np.argsort(at[there], kind="stable")]
    edges = np.searchsorted(at[there], np.arange(width + 1))
    for i in left:
        own, mine = at[starts[i] : starts[i + 1]], ranks[starts[i] : starts[i + 1]]
        lengths = edges[own + 1] - edges[own]
        found = there[np.repeat(edges[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
        place, other = np.repeat(np.arange(len(own)), lengths), line[found]
        if same:
            later = other > i
            found, place, other = found[later], place[later], other[later]
        js, inverse, counts = np.unique(other, return_inverse=True, return_counts=True)
        at_once = max(1, AT_ONCE // len(own))
        some = np.flatnonzero(counts >= max(1, least))
        by = np.argsort(inverse, kind="stable")
        ends = np.cumsum(counts)
        for top in range(0, len(some), at_once):
            part = some[top : top + at_once]
            taken = by[np.repeat(ends[part] - np.cumsum(counts[part]), counts[part]) + np.arange(counts[part].sum())]
            y = np.full((len(part), len(own)), np.nan)
            y[np.repeat(np.arange(len(part)), counts[part]), place[taken]] = ranks[found[taken]]
            both = ~np.isnan(y)
            mean = (counts[part][:, None] + 1) / 2
            p, q = (np.where(both, _ranked(z, both) - mean, 0.0) for z in (np.broadcast_to(mine, y.shape), y))
            spread = np.sqrt((p * p).sum(axis=1) * (q * q).sum(axis=1))
            rho = np.divide((p * q).sum(axis=1), spread, out=np.full(len(part), np.nan), where=spread > 0)
            yield np.array([i]), js[part], counts[part][None, :], rho[None, :]


def _ranked(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Average ranks from 1 of the held entries of each row; 0 for the others."""
    v, k = np.where(held, x, np.inf), np.arange(x.shape[1])
    order = np.argsort(v, axis=1)
    s = np.take_along_axis(v, order, axis=1)
    new = np.concatenate([np.ones((len(s), 1), dtype=bool), s[:, 1:] != s[:, :-1]], axis=1)
    ends = np.concatenate([new[:, 1:], np.ones((len(s), 1), dtype=bool)], axis=1)
    first = np.maximum.accumulate(np.where(new, k, 0), axis=1)
    last = np.minimum.accumulate(np.where(ends, k, len(k))[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, axis=1)
    return np.where(held, out, 0.0)


def _listed(rows: pa.Table, least: int) -> pa.Table:
    """x, y, n, rho of each two annotators with enough in common."""
    found = [(np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0),)]
    for i, j, n, rho in _meetings(rows, least):
        a, b = np.nonzero(n >= max(1, least))
        found.append((i[a], j[b], n[a, b], rho[a, b]))
    x, y, n, rho = (np.concatenate(c) for c in zip(*found, strict=True))
    names = rows.column("annotator")
    return pa.table([names.take(pa.array(x)), names.take(pa.array(y)), pa.array(n), pa.array(rho, from_pandas=True)], ["x", "y", "n", "rho"])


def _summed(rows: pa.Table, least: int) -> pa.Table:
    """One row of ``sums`` over the pairs."""
    w = rows.column("w").to_numpy()
    pairs = total = some = 0.0
    low, high = np.inf, -np.inf
    for i, j, n, rho in _meetings(rows, least):
        times = np.where(n >= max(1, least), w[i][:, None] * w[j][None, :], 0.0)
        pairs += times.sum()
        has = (times > 0) & ~np.isnan(rho)
        rhos, times = rho[has], times[has]
        total, some = total + rhos @ times, some + times.sum()
        low, high = min(low, rhos.min(initial=np.inf)), max(high, rhos.max(initial=-np.inf))
    return pa.table({"n": [float(pairs)], "total": [float(total)], "some": [float(some)], "low": pa.array([float(low) if some else None], pa.float64()), "high": pa.array([float(high) if some else None], pa.float64())})


def inter_annotator(ratings: DataFrame, item: list[str], least: int = 3) -> DataFrame:
    """pairs, mean_rho, min_rho, max_rho; pairs without a correlation don't count in the mean.

    Annotators with the same ratings are one class: only classes meet, and a pair of classes counts as often as annotators of the
    two do.  What is sent or written grows with the ratings, not with the pairs: each task sums up its own.  Ratings are compared
    whole, not by digests.
    """
    at = files.folder(ratings.sparkSession, "classes")
    clean = ratings.where(F.col("rating").isNotNull() & ~F.isnan(F.col("rating").cast("double")) & F.col("annotator").isNotNull())
    once = clean.groupBy("annotator", *item).agg(F.avg(F.col("rating").cast("double")).alias("_mean"))
    once.select("annotator", F.xxhash64(*item).alias("item"), F.col("_mean").alias("rating")).write.parquet(f"{at}/once")
    once = ratings.sparkSession.read.parquet(f"{at}/once")
    # Wide annotators would be long lists: each stays a class of its own.
    mine = once.groupBy("annotator").agg(F.count("*").alias("k"))
    narrow = once.join(mine.where(F.col("k") <= WIDEST), "annotator").groupBy("annotator").agg(F.array_sort(F.collect_list(F.struct("item", "rating"))).alias("r"))
    classes = narrow.groupBy("r").agg(F.min("annotator").alias("annotator"), F.count("*").alias("w"), F.size("r").alias("k")).drop("r")
    classes.unionByName(mine.where(F.col("k") > WIDEST).withColumn("w", F.lit(1).cast("long"))).write.parquet(f"{at}/classes")
    classes = ratings.sparkSession.read.parquet(f"{at}/classes")

    each = classes.select("annotator", F.col("w").cast("double").alias("w"))
    between = annotator_pairs(once.join(each, "annotator"), ["item"], least, BLOCK, MOST_RATINGS, TILE, "w")
    # Two annotators of one class agree wholly, unless all their ratings are equal.
    spread = once.join(classes.where("w > 1").select("annotator"), "annotator").groupBy("annotator").agg(F.when(F.min("rating") < F.max("rating"), 1.0).alias("rho"))
    within = classes.where((F.col("w") > 1) & (F.col("k") >= least)).join(spread, "annotator").select("rho", (F.col("w") * (F.col("w") - 1) / 2).alias("n"))
    every = between.unionByName(sums(within))
    return every.agg(F.coalesce(F.sum("n"), F.lit(0.0)).cast("long").alias("pairs"), F.try_divide(F.sum("total"), F.sum("some")).alias("mean_rho"), F.min("low").alias("min_rho"), F.max("high").alias("max_rho"))


def reward_agreement(scores: DataFrame, ratings: DataFrame, rewards: list[str], key: list[str]) -> DataFrame:
    """reward, n, rho of each reward with the mean human rating, best first, null last."""
    human = ratings.groupBy(*key).agg(F.avg("rating").alias("human"))
    long = scores.join(human, key).unpivot([*key, "human"], rewards, "reward", "score")
    return spearman(long, ["reward"], "score", "human", least=3).orderBy(F.desc_nulls_last("rho"), "reward")


def reward_by_annotator(scores: DataFrame, ratings: DataFrame, rewards: list[str], key: list[str]) -> DataFrame:
    """reward, annotators, mean_rho, spread: correlations of each reward with each annotator, their mean and range."""
    long = scores.join(ratings, key).unpivot([*key, "annotator", "rating"], rewards, "reward", "score")
    each = spearman(long, ["reward", "annotator"], "score", "rating", least=3).where("rho IS NOT NULL")
    return each.groupBy("reward").agg(F.count("*").alias("annotators"), F.avg("rho").alias("mean_rho"), (F.max("rho") - F.min("rho")).alias("spread"))


def top_pick_agreement(scores: DataFrame, ratings: DataFrame, rewards: list[str]) -> DataFrame:
    """reward, hits, records, flat: in how many records with two or more rated items the reward's best is the humans' best.

    A record where the reward is constant counts as flat, and also among the records.
    """
    human = ratings.groupBy("record_id", "i").agg(F.avg("rating").alias("human"))
    long = scores.join(human, ["record_id", "i"]).unpivot(["record_id", "i", "human"], rewards, "reward", "score")
    score = F.when(~F.isnan("score"), F.col("score"))
    key = lambda c: F.struct(c.alias("s"), (-F.col("i")).alias("t"))
    each = long.groupBy("reward", "record_id").agg(F.count("*").alias("n"), F.max_by("i", key(F.col("human"))).alias("h"), F.max_by("i", key(score)).alias("r"), (F.min(score) < F.max(score)).alias("varied"))
    varied = F.coalesce(F.col("varied"), F.lit(False))
    return each.where("n >= 2").groupBy("reward").agg(F.count_if(varied & (F.col("h") == F.col("r"))).alias("hits"), F.count("*").alias("records"), F.count_if(~varied).alias("flat"))


def precision_recall(got: Column, gold: Column) -> Column:
    """struct(precision, recall, f1) of two sets; 1 where both are empty, 0 where nothing is shared."""
    got, gold = F.array_distinct(got), F.array_distinct(gold)
    tp = F.size(F.array_intersect(got, gold))
    none = (F.size(got) == 0) & (F.size(gold) == 0)
    p = F.when(none, 1.0).when(F.size(got) > 0, tp / F.size(got)).otherwise(0.0)
    r = F.when(none, 1.0).when(F.size(gold) > 0, tp / F.size(gold)).otherwise(0.0)
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def entity_set(entities: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(entities, lambda e: F.trim(F.lower(e["entity_text"]))), lambda t: F.coalesce(t, F.lit("")) != ""))


def link_set(relations: Column) -> Column:
    """(head, tail) in lower case, without the type of the relation."""
    pairs = F.transform(relations, lambda r: F.struct(F.trim(F.lower(r["head_entity_text"])).alias("h"), F.trim(F.lower(r["tail_entity_text"])).alias("t")))
    return F.array_distinct(F.filter(pairs, lambda p: (F.coalesce(p["h"], F.lit("")) != "") & (F.coalesce(p["t"], F.lit("")) != "")))


def separation(df: DataFrame, group: str, good: str, flat: str, false: str, features: list[str]) -> DataFrame:
    """feature, good, flat, false (means), separates, blind: whether a feature tells good from flat, and not good from false."""
    long = df.unpivot([group], features, "feature", "value")
    mean = lambda g: F.avg(F.when(F.col(group) == g, F.col("value")))
    m = long.groupBy("feature").agg(mean(good).alias("good"), mean(flat).alias("flat"), mean(false).alias("false"))
    return m.select("*", (F.col("good") > F.col("flat") + 0.02).alias("separates"), (F.abs(F.col("good") - F.col("false")) / (F.abs(F.col("good")) + 1e-9) < 0.15).alias("blind"))


def wins(df: DataFrame, cell: list[str], group: str, score: str, first: str, second: str) -> DataFrame:
    """cells, wins: in how many cells the first group's score is above the second's."""
    of = lambda g: F.max(F.when(F.col(group) == g, F.col(score)))
    return df.groupBy(*cell).agg(of(first).alias("a"), of(second).alias("b")).agg(F.count("*").alias("cells"), F.count_if(F.col("a") > F.col("b")).alias("wins"))


def most_frequent(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each group; among equals the one seen first."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("k"), F.min(order).alias("at"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("k", (-F.col("at")).alias("at"))).alias(value), F.max("k").alias("times"))
