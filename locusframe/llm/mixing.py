"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.llm.common import discard, maybe_in, named, numbered, save, small_side, uniform, unpacked, whole_row, word_count

#: Documents of one source that meet in one step of the reduction tree.
FAN_IN = 64
_EPS = 1e-12


def source_targets(items: DataFrame, weights: tuple[float, ...], share: float, most: float) -> tuple[DataFrame, int]:
    """(source, source_size, source_items, target) of ``items`` (source, size, m), and the number of sources.

    Targets are level * weight, held at ``most`` times the source's size; the
    level rises as what capped sources leave is shared again, until no further
    source is above its cap. Every round is one aggregate over the sources.
    """
    sums = save(items.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("source_items")), "sources")
    ranked = numbered(sums, [F.col("source").asc_nulls_last()], "_rank", "source-rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    src = ranked.withColumn("_w", weight).withColumn("_cap", most * F.col("source_size").cast("double"))
    n, total, weight_sum = src.agg(F.count("*"), F.sum("source_size"), F.sum("_w")).first()
    budget, level, capped = share * (total or 0), 0.0, -1
    if n:
        level = budget / weight_sum
        while True:
            full = F.col("_cap") <= level * F.col("_w")
            now, held, open_weight = src.agg(F.count_if(full), F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_w")))).first()
            if now == capped or not open_weight:
                break
            capped, level = now, (budget - (held or 0.0)) / open_weight
        if not open_weight:  # every source is at its cap
            level = float("inf")
    target = F.least(F.col("_cap"), F.lit(level) * F.col("_w")) if level != float("inf") else F.col("_cap")
    out = save(src.select("source", "source_size", "source_items", target.alias("target")), "mix-sources")
    discard(sums, ranked)
    return out, n


def _pivot(level: int, seed: int):
    """merge(state, next): two fractional documents of one bucket exchange mass until one is integral.

    The mass is p * size, so the expected words of the pair stay as they are;
    up or down is drawn so that each document's expectation stays too.
    """

    def merge(state: Column, x: Column) -> Column:
        rest = state["rest"]
        mass_a, mass_b = rest["p"] * rest["size"], x["p"] * x["size"]
        up = F.least((1 - rest["p"]) * rest["size"], mass_b)
        down = F.least(mass_a, (1 - x["p"]) * x["size"])
        rises = uniform(F.lit(seed), F.lit(level), rest["h"], x["h"]) * (up + down) < down
        moved = F.when(rises, up).otherwise(-down)
        pa, pb = rest["p"] + moved / rest["size"], x["p"] - moved / x["size"]
        snap = lambda p: F.when(p < _EPS, 0.0).when(p > 1 - _EPS, 1.0).otherwise(p)
        pair = F.array(F.struct(snap(pa).alias("a"), snap(pb).alias("b")))
        def settle(p: Column) -> Column:
            ra, rb = rest.withField("p", p["a"]), x.withField("p", p["b"])
            whole_a, whole_b = (p["a"] == 0) | (p["a"] == 1), (p["b"] == 0) | (p["b"] == 1)
            done = F.concat(state["done"], F.when(whole_a & whole_b, F.array(ra, rb)).when(whole_a, F.array(ra)).otherwise(F.array(rb)))
            left = F.when(whole_a & whole_b, F.lit(None)).when(whole_a, rb).otherwise(ra)
            return F.struct(left.alias("rest"), done.alias("done"))

        met = F.transform(pair, settle)[0]
        return F.when(rest.isNull(), F.struct(x.alias("rest"), state["done"].alias("done"))).otherwise(met)

    return merge


def _items(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """What a document is told by: id, source, words and a hash of its text."""
    text = named(text_col)
    return [named(id_col).alias("doc_id"), named(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t")]


def _picked(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], share: float, most: float, seed: int, fan_in: int) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, source, size, t, m, whole, more): m equal rows are taken ``whole`` times each and ``more`` of them once more; the sources and their number."""
    items = save(docs.select(*_items(docs, id_col, text_col, source_col)).groupBy("doc_id", "source", "size", "t").agg(F.count("*").alias("m")), "mix-items")
    sources, n_sources = source_targets(items, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = items.withColumnRenamed("source", "_s").join(small_side(sources, n_sources), F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
    whole = F.when(F.col("size") > 0, F.floor(rate + _EPS)).otherwise(0)
    extra = F.when(F.col("size") > 0, F.greatest(rate - F.col("whole"), F.lit(0.0)) * F.col("m")).otherwise(0.0)
    split = joined.withColumn("whole", whole.cast("int")).withColumn("_x", extra).withColumn("dealt", F.floor(F.col("_x") + _EPS)).withColumn("p", F.col("_x") - F.col("dealt"))
    split = split.withColumn("p", F.when(F.col("p") < _EPS, 0.0).otherwise(F.col("p"))).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source", "size", "t"))
    columns = ["size", "h", "doc_id", "t", "m", "whole", "dealt", "p"]
    done = [split.filter("p = 0").select("source", *columns)]
    largest = sources.agg(F.max("source_items")).first()[0] or 0
    # A source's buckets: about fan_in of its items in each, so a hot source has many.
    buckets = F.ceil(F.col("source_items") / fan_in)
    rest = split.filter("p > 0").select("source", F.pmod(F.xxhash64("h", F.lit(seed + 1)), buckets).alias("bucket"), *columns)
    level, width, used = 0, -(-largest // fan_in) if largest else 0, []
    item = F.struct((-F.col("size")).alias("order"), *columns)
    while width:
        kind = rest.select(item.alias("x")).schema["x"].dataType.simpleString()
        start = F.struct(F.lit(None).cast(kind).alias("rest"), F.array().cast(f"array<{kind}>").alias("done"))
        met = rest.groupBy("source", "bucket").agg(F.sort_array(F.collect_list(item)).alias("xs"))
        met = save(met.select("source", "bucket", F.aggregate("xs", start, _pivot(level, seed)).alias("r")).select("source", "bucket", "r.*"), f"mix-level{level}")
        used.append(met)
        done.append(met.select("source", F.explode("done").alias("x")).select("source", *[F.col(f"x.{c}") for c in columns]))
        rest = met.filter("rest IS NOT NULL").select("source", F.floor(F.col("bucket") / fan_in).alias("bucket"), *[F.col(f"rest.{c}") for c in columns])
        level, width = level + 1, 0 if width == 1 else -(-width // fan_in)
    drawn = F.when(uniform(F.lit(seed), F.lit(-1), F.col("h")) < F.col("p"), 1.0).otherwise(0.0)
    done.append(rest.withColumn("p", drawn).select("source", *columns))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    out = save(out.select("doc_id", "source", "size", "t", "m", "whole", (F.col("dealt") + F.col("p").cast("long")).alias("more")), "mix")
    discard(items, *used)
    return out, sources, n_sources


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, fan_in: int = FAN_IN) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, copies, taken.

    Every source is to give ``target`` words (see source_targets), so each of its
    documents has the expectation target / source_size of copies. Its whole part
    is given; the fractions are rounded by the pivotal method: within buckets of
    about ``fan_in`` documents of one source, pairs exchange mass until one of the
    two is integral, the last fractional document of a bucket goes up to the next
    level, and the single one left at the root is drawn. A source's taken words
    are thus off its target by one document at most. All draws come from hashes
    of the documents, so reruns agree.

    Nulls: a null text has no words; a null source is a source of its own, last
    in order; a null id is an id. Documents without words are taken 0 times. A text
    of any length is one document. Rows equal in id, source and text count each: they
    form one item with a multiplicity, whose whole extra copies are dealt and whose
    fraction enters the tree. An empty table gives an empty result. Other columns of
    ``docs`` are not read.
    """
    picks, sources, n_sources = _picked(docs, id_col, text_col, source_col, weights, share, most, seed, fan_in)
    row = F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))
    rows = picks.withColumn("_row", row).withColumn("copies", F.col("whole") + F.when(F.col("_row") <= F.col("more"), 1).otherwise(0))
    of_source = rows.withColumnRenamed("source", "_s").join(small_side(sources, n_sources), F.col("_s").eqNullSafe(F.col("source")))
    return of_source.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, fan_in: int = FAN_IN) -> DataFrame:
    """``docs`` with every row repeated as often as ``mix`` copies it, with all columns as they are.

    Rows meet their copies on (id, source, words, hash of the text), and texts are
    dealt once. Where only some of several rows equal in these are taken once more,
    it is the first in order of a hash of the whole row, so reruns agree.

    Nulls, texts of any length, repeated rows and an empty table are as in ``mix``;
    null ids are told apart by their texts. Columns may have any name: all are kept in
    one struct while others are worked out beside it.
    """
    picks, sources, _ = _picked(docs, id_col, text_col, source_col, weights, share, most, seed, fan_in)
    of = [F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "size", "t")]
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("t") == F.col("_t"))
    rows = docs.select(whole_row(docs).alias("row"), *_items(docs, id_col, text_col, source_col))
    times = F.col("whole") + F.when(F.col("more") > 0, 1).otherwise(0)
    some = (F.col("more") > 0) & (F.col("more") < F.col("m"))
    sure = rows.join(picks.filter(~some & (times > 0)).select(*of, times.alias("times")), same).select("row", "times")
    some_picks = picks.filter(some).select(*of, "whole", "more")
    n_some = some_picks.count()
    if n_some:
        key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("_doc_id", "_source")], "_t")
        asked = maybe_in(some_picks.select(key.alias("key")))
        likely = rows.filter(asked(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit("")), "t")))
        alike = likely.join(small_side(some_picks, n_some), same).withColumn("_hash", F.xxhash64(F.to_json("row"))).withColumn("_row", F.monotonically_increasing_id())
        alike = save(alike.select("row", "doc_id", "source", "t", "size", "whole", "more", "_hash", "_row"), "mix-alike")
        ranked = numbered(alike, [F.col(c) for c in ("t", "doc_id", "source", "size", "_hash", "_row")], "place", "mix-ranked")
        first = ranked.groupBy(F.col("doc_id").alias("_doc_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("t").alias("_t")).agg(F.min("place").alias("_first"))
        more = ranked.join(small_side(first, n_some), same).withColumn("times", F.col("whole") + F.when(F.col("place") - F.col("_first") < F.col("more"), 1).otherwise(0))
        sure = sure.unionByName(more.filter("times > 0").select("row", "times"))
        discard(alike)
    discard(sources)
    return unpacked(sure.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))), docs)
