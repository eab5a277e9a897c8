"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 5;
DataFrame functions only).

A source's target is its weight's share of all words, at most ``max_repeat``
times the source's own words; what a cap leaves over is reshared by weight.
The mix is dealt in blocks of ``block`` words.  Sainte-Laguë gives the blocks
to the sources with the highest quotients votes / (2k - 1) (votes: the target
in words), and each source's blocks to its shards the same way (votes: the
shard's words).  A shard is a hash-dealt part of a source of about
``shard_words`` words, its documents in a seeded order.  A shard with quota q
takes q * block words: whole passes over itself, then single blocks in a
seeded permutation of its blocks until the words are used up.  A document
takes the words its shard's chosen blocks cover.

Apportionment is exact without dealing seat by seat: with V votes, N seats
and n parties, the divisors V / (N - n/2) and V / (N + n/2) give every party
a number of certain seats and leave at most about 2n seats open; only those
are ranked.

Cases: null text has size 0 and takes 0; a null source is one source, last in
order; repeated rows count and take separately; an empty table gives an empty
result; extra columns are ignored.  Ids may be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordered import running_totals
from ..session import store
from .common import text_of

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)            # by source in code point order, repeating
MAX_REPEAT = 3
BLOCK = 16                     # words dealt at once
SHARD_WORDS = 1 << 18
SEED = 17
# Primes above any block count of a shard, so each is coprime with it.
_MULTIPLIERS = (2147483659, 2147483693, 2147483713, 2147483743, 2147483777)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """From (source, source_size), one row per source: adds ``src`` (its rank in
    code point order, null last) and ``target`` in words.

    The caps are filled in the order of cap / weight: a source is capped when
    the level the sources after it would get exceeds its own ratio, and the
    final level is the largest of these."""
    ordered = running_totals(sizes.select("source", "source_size", F.col("source").isNull().alias("last"),
                                          F.lit(1).alias("one")), ["last", "source"], ["one"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("one_before") % len(weights) + 1).cast("int"))
    cap = F.col("source_size").cast("double") * max_repeat
    ranked = running_totals(
        ordered.select("source", "source_size", F.col("one_before").alias("src"), weight.alias("weight"))
        .withColumns({"cap": cap, "ratio": cap / F.col("weight")}),
        ["ratio", "src"], ["cap", "weight", "source_size"])
    ranked = store(ranked)
    level = ranked.agg(F.max((F.col("source_size_total") - F.col("cap_before"))
                             / (F.col("weight_total") - F.col("weight_before")))).scalar()
    target = F.when(F.col("ratio") < level, F.col("cap")).otherwise(F.col("weight") * level)
    return ranked.select("source", "source_size", "src", target.alias("target"))


def sainte_lague(parties: DataFrame, group: str, key: str, votes: str, seats: str) -> DataFrame:
    """Adds ``quota``: the seats of each party (``key``) in its ``group``.

    ``seats`` holds the group's number of seats, the same in all its rows.
    Equal quotients go to the smaller key; parties without votes get none."""
    v = F.col(votes).cast("double")
    base = store(parties.withColumn(votes, v))
    totals = (base.where(F.col(votes) > 0).groupBy(group)
              .agg(F.sum(votes).alias("all_votes"), F.count(F.lit(1)).alias("parties")))
    half = F.col("parties") / 2
    certain = F.floor(F.col(votes) * (F.col(seats) - half) / F.col("all_votes") + 0.5) - 1
    most = F.floor(F.col(votes) * (F.col(seats) + half) / F.col("all_votes") + 0.5) + 1
    bounds = store(base.where(F.col(votes) > 0).join(totals, group)
                   .select(group, key, votes, seats, F.greatest(F.lit(0), certain).cast("long").alias("low"),
                           F.greatest(F.lit(1), most).cast("long").alias("high")))
    open_seats = (bounds.groupBy(group).agg((F.first(seats) - F.sum("low")).alias("open")))
    asked = bounds.select(group, key, F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("seat"), votes)
    ranked = running_totals(asked.select(group, key, (-F.col(votes) / (2 * F.col("seat") - 1)).alias("rank"),
                                         F.lit(1).alias("one")), ["rank", key], ["one"], by=[group])
    won = (ranked.join(open_seats, group).where(F.col("one_before") < F.col("open"))
           .groupBy(group, key).agg(F.count(F.lit(1)).alias("won")))
    quota = (bounds.join(won, [group, key], "left")
             .select(group, key, (F.col("low") + F.coalesce("won", F.lit(0))).alias("quota")))
    return (base.join(quota, [group, key], "left")
            .withColumn("quota", F.coalesce("quota", F.lit(0).cast("long"))))


def _chosen_words(block: int) -> dict[str, Column]:
    """Per row of a document joined with its shard: the words taken and the
    spans [from, to) of its words in the last, partial pass."""
    words, rest, blocks = F.col("shard_words"), F.col("rest"), F.col("blocks")
    last_len = words - (blocks - 1) * block
    place = lambda j: (F.col("multiplier") % blocks * j + F.col("shift")) % blocks
    last_place = place(blocks - 1)

    def span(j: Column) -> Column:
        p = place(j)
        before = p * block - F.when(p > last_place, F.lit(block) - last_len).otherwise(F.lit(0))
        size = F.when(j == blocks - 1, last_len).otherwise(F.lit(block).cast("long"))
        upto = j * block + F.greatest(F.lit(0).cast("long"), F.least(size, rest - before))
        start = F.greatest(F.col("offset"), j * block)
        stop = F.least(F.col("offset") + F.col("size"), upto)
        return F.struct((start - F.col("offset")).alias("start"), (stop - F.col("offset")).alias("stop"))

    js = F.sequence((F.col("offset") / block).cast("long"),
                    ((F.col("offset") + F.col("size") - 1) / block).cast("long"))
    spans = F.when((F.col("size") > 0) & (rest > 0),
                   F.filter(F.transform(js, span), lambda s: s["stop"] > s["start"]))
    partial = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    return {"spans": F.coalesce(spans, none), "taken": F.col("passes") * F.col("size") + partial}


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT, block: int = BLOCK,
        shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, taken,
    passes, spans, text_key`` (a hash of the text).

    ``taken`` = ``passes`` times the whole document plus the words (0-based,
    half open) in ``spans``."""
    body = text_of(text_col)
    sized = store(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                              word_count(body).alias("size"),
                              F.xxhash64(body).alias("text_key"),
                              F.xxhash64(F.lit(seed), F.col(id_col), body).alias("order")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeat).withColumn("all", F.lit(0))
    seats = F.ceil(targets.agg(F.sum("target")).scalar() / block).cast("long")
    sources = store(sainte_lague(targets.withColumn("seats", seats), "all", "src", "target", "seats")
                    .select("source", "source_size", "src", "target", F.col("quota").alias("seats"),
                            F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / shard_words).alias("shards")))

    # written, so that later grouping by (src, shard) does not inherit a
    # partitioning by source, which would put a hot source into one task
    placed = store(sized.join(sources.withColumnRenamed("source", "its_source"),
                              F.col("source").eqNullSafe(F.col("its_source")))
                   .withColumn("shard", F.pmod("order", "shards"))
                   .drop("its_source", "shards"))
    shards = placed.groupBy("src", "shard").agg(F.sum("size").alias("shard_words"), F.first("seats").alias("seats"))
    quotas = sainte_lague(shards.withColumn("votes", F.col("shard_words")), "src", "shard", "votes", "seats")
    words = F.greatest(F.col("shard_words"), F.lit(1))
    need = F.least(F.col("quota") * block, F.col("shard_words") * max_repeat)
    which = F.pmod(F.xxhash64(F.lit(seed), F.col("src"), F.col("shard")), F.lit(len(_MULTIPLIERS)))
    quotas = (quotas.select("src", "shard", words.alias("shard_words"), need.alias("need"), which.alias("which"))
              .select("src", "shard", "shard_words",
                      F.floor(F.col("need") / F.col("shard_words")).alias("passes"),
                      (F.col("need") % F.col("shard_words")).alias("rest"),
                      F.ceil(F.col("shard_words") / block).alias("blocks"),
                      F.element_at(F.array(*[F.lit(p) for p in _MULTIPLIERS]),
                                   (F.col("which") + 1).cast("int")).alias("multiplier"))
              .withColumn("shift", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("src"), F.col("shard")),
                                          F.col("blocks"))))
    earlier = (Window.partitionBy("src", "shard").orderBy("order", "doc_id", "size")
               .rowsBetween(Window.unboundedPreceding, -1))
    dealt = placed.withColumn("offset", F.coalesce(F.sum("size").over(earlier), F.lit(0).cast("long")))
    chosen = _chosen_words(block)
    return (dealt.join(quotas, ["src", "shard"])
            .withColumn("spans", chosen["spans"])
            .select("doc_id", "source", "size", "source_size", "target",
                    chosen["taken"].alias("taken"), "passes", "spans", "text_key"))


def materialise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                length_col: str = "n_chars", **options) -> DataFrame:
    """The mixed documents with the columns of ``docs``: each row once per whole
    pass, then the words of its chosen blocks (joined by a space) as a further
    row, its ``length_col`` counted anew.

    Rows find their decision by id and text; rows that repeat both are told
    apart by their number among themselves."""
    plan = mix(docs, id_col, text_col, source_col, **options)
    taken = (plan.groupBy("doc_id", "text_key")
             .agg(F.collect_list(F.struct("passes", "spans")).alias("dealt"), F.sum("taken").alias("taken"))
             .where("taken > 0").drop("taken"))
    body = text_of(F.col(f"row.`{text_col}`"))
    rows = (docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_of(F.col(f"`{text_col}`"))).alias("key"),
                        F.struct("*").alias("row"))
            .join(taken, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))))
    same = Window.partitionBy("id", "key").orderBy("key")                      # repeated rows only
    rows = rows.withColumn("own", F.element_at("dealt", F.row_number().over(same)))
    spans, passes = F.col("own")["spans"], F.col("own")["passes"].cast("int")
    copies = F.concat(F.array_repeat(F.lit(True), passes),
                      F.when(F.size(spans) > 0, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))
    rows = rows.select("row", "own", F.explode(copies).alias("whole"))
    # the words are cut once a row, however many spans it has
    words = F.array(F.regexp_extract_all(body, F.lit(WORD), F.lit(0)))
    part = F.transform(words, lambda w: F.array_join(F.flatten(F.transform(spans, lambda s: F.slice(
        w, s["start"].cast("int") + 1, (s["stop"] - s["start"]).cast("int")))), " "))[0]
    rows = rows.withColumn("part", F.when(~F.col("whole"), part))
    changed = {text_col: F.col("part"), length_col: F.char_length("part")}
    return rows.select(*[
        (F.when(F.col("whole"), F.col(f"row.`{c}`")).otherwise(changed[c].cast(docs.schema[c].dataType))
         if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
