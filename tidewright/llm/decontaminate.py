"""Operator 5 (native): benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over SPAN consecutive tokens: hashes look at the mask's positions only,
so a substituted word at another position does not hide a match. Test and training hashes are
joined; each hit gives a place at which the item's tokens and the document's lie side by side,
and a place counts if in some WINDOW tokens of the two enough are equal. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored, table

#: Positions of the tokens that each mask looks at; of 13 tokens with two substitutions, one mask fits somewhere.
MASKS = ((0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 6, 7))
#: Masks of shorter items by their number of tokens: one fits wherever the tokens that SHARE lets differ are.
SHORT = {
    1: ((0,),), 2: ((0, 1),), 3: ((0, 1, 2),), 4: ((0, 1, 2, 3),),
    5: ((0, 1, 2), (0, 1, 3)), 6: ((0, 1, 2, 3), (0, 1, 3, 4)), 7: ((0, 1, 3, 4),),
    8: ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5)), 9: ((0, 1, 2, 3, 4, 5), (0, 1, 2, 4, 5, 6)), 10: ((0, 1, 2, 3), (0, 1, 2, 4)),
    11: ((0, 1, 2, 3, 5), (0, 1, 4, 7, 8)), 12: ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5)),
}
SPAN, WINDOW, SHARE = 8, 13, 0.8
#: Test hashes and hit documents up to these numbers are broadcast (24 bytes each); beyond, both sides are shuffled.
BROADCAST_SEEDS, BROADCAST_HITS = 1_000_000, 500_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of a whole text; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def masks_of(n: int) -> tuple[tuple[int, ...], ...]:
    """The masks that find items of n tokens."""
    return SHORT.get(n, MASKS)


def seeds(hashes: Column, masks: Iterable[tuple[int, ...]] = MASKS) -> Column:
    """Array of (at, h) over token hashes; a mask wider than the text gives none."""
    none = F.array().cast("array<struct<at:int,h:bigint>>")

    def of(mask: tuple[int, ...]) -> Column:
        found = F.transform(
            F.sequence(F.lit(0), F.size(hashes) - mask[-1] - 1),
            lambda i: F.struct(i.cast("int").alias("at"), F.xxhash64(F.lit(str(mask)), *[F.get(hashes, i + p) for p in mask]).alias("h")),
        )
        return F.when(F.size(hashes) > mask[-1], found).otherwise(none)

    return F.concat(none, *[of(m) for m in masks])


def _seeded(rows: DataFrame, keys: list[str], masks: Callable[[Column], Column]) -> DataFrame:
    hashed = rows.select(*keys, F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("hashes"))
    return hashed.select(*keys, F.explode(masks(F.col("hashes"))).alias("s")).select(*keys, "s.at", "s.h")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, least: int = SPAN) -> DataFrame:
    """(doc_id, item_id, th, at, n_equal, overlap): the best place of each test item in each document that holds it.

    overlap is the largest share of equal tokens in `window` consecutive tokens of the two (fewer,
    if the item is shorter), `share` at least; at is the document's token number under the item's
    first; n_equal counts equal tokens along the whole item. th is xxhash64 of the text, to tell rows
    of one id apart; rows that repeat give one. Null texts and items, and items under `least` tokens,
    match nothing; a null id is kept. Masks are made for the lengths that the items have. Only the named columns are read.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    # within a struct a null id is a value like any other
    base = docs.select(F.struct("doc_id").alias("doc_id"), F.xxhash64("text").alias("th"), "text").where("text IS NOT NULL")
    items = benchmark.select("item_id", "text").where("text IS NOT NULL").distinct()
    items = items.where(F.size(tokens(F.col("text"))) >= max(least, 1))
    item_tokens = items.select("item_id", tokens(F.col("text")).alias("item"))
    lengths = sorted(r[0] for r in item_tokens.select(F.least(F.size("item"), F.lit(WINDOW))).distinct().collect())
    masks = sorted({m for n in lengths for m in masks_of(n)})

    def own(hashes: Column) -> Column:
        none = seeds(hashes, ())
        return F.coalesce(*[F.when(F.least(F.size(hashes), F.lit(WINDOW)) == n, seeds(hashes, masks_of(n))) for n in lengths], none)

    tests = stored(_seeded(items, ["item_id"], own).select("item_id", F.col("at").alias("item_at"), "h").distinct(), "test-seeds")
    few = tests.count() <= BROADCAST_SEEDS
    train = _seeded(base, ["doc_id", "th"], lambda hashes: seeds(hashes, masks))
    met = train.join(F.broadcast(tests) if few else tests.hint("shuffle_merge"), "h")
    places = met.select("doc_id", "th", "item_id", (F.col("at") - F.col("item_at")).alias("at")).distinct()
    hits = stored(places, "seed-hits")
    which = hits.select("doc_id", "th").distinct()
    near = which.count() <= BROADCAST_HITS
    hit_docs = base.join(F.broadcast(which) if near else which.hint("shuffle_merge"), ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
    words = hit_docs.select("doc_id", "th", tokens(F.col("text")).alias("words"))
    size = hits.join(F.broadcast(item_tokens) if few else item_tokens, "item_id")
    # the document's tokens under the item; places before its start or past its end stay empty
    start, n = F.greatest(F.col("at"), F.lit(0)), F.size("item")
    lead = F.greatest(-F.col("at"), F.lit(0))
    part = F.slice("words", start + 1, F.greatest(n - lead, F.lit(0)))
    laid = words.join(size, ["doc_id", "th"]).select("doc_id", "th", "item_id", "at", "item", part.alias("part"), lead.alias("lead"))
    at_item = F.slice("item", F.col("lead") + 1, F.greatest(F.size("part"), F.lit(0)))
    equal = laid.select("doc_id", "th", "item_id", "at", F.size("item").alias("n_item"), F.zip_with("part", at_item, lambda a, b: (a == b).cast("int")).alias("eq"))
    wide = F.least(F.lit(window), F.col("n_item"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.size("eq") - wide + 1, F.lit(1))), lambda i: total(F.slice("eq", i, wide))))
    scored = equal.where(F.size("eq") > 0).select("doc_id", "th", "item_id", "at", total(F.col("eq")).alias("n_equal"), (best / wide).alias("overlap"))
    good = scored.where(F.col("overlap") >= share)
    top = F.max(F.struct("overlap", "n_equal", (-F.col("at")).alias("back"))).alias("b")
    one = good.groupBy("doc_id", "th", "item_id").agg(top)
    return one.select("doc_id.doc_id", "item_id", "th", (-F.col("b.back")).alias("at"), F.col("b.n_equal").alias("n_equal"), F.col("b.overlap").alias("overlap"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, one row for each document and item."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=1)
    return found.select("doc_id", "item_id", F.col("at").cast("long").alias("at"), F.col("n_equal").cast("long").alias("n_equal"), F.round("overlap", 6).alias("overlap"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark),
dt AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d),
bt AS (SELECT item_id, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM b),
eq AS (SELECT doc_id, item_id, n, dt.p - bt.p AS place, bt.p AS k FROM dt JOIN bt USING (w)),
many AS (SELECT doc_id, item_id, place FROM eq GROUP BY ALL HAVING count(*) >= 0.8 * least(13, max(n))),
c AS (SELECT doc_id, item_id, n, place, count(*) OVER (PARTITION BY doc_id, item_id, place ORDER BY k RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS c,
             count(*) OVER (PARTITION BY doc_id, item_id, place) AS n_equal
      FROM eq SEMI JOIN many USING (doc_id, item_id, place)),
p AS (SELECT doc_id, item_id, place, max(n_equal) AS n_equal, max(c) / least(13, max(n)) AS overlap FROM c GROUP BY doc_id, item_id, place),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY overlap DESC, n_equal DESC, place) AS k FROM p WHERE overlap >= 0.8)
SELECT doc_id, item_id, place::BIGINT AS "at", n_equal::BIGINT AS n_equal, round(overlap, 6) AS overlap FROM r WHERE k = 1
"""
