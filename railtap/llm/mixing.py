"""Mixing sources to target weights by index arithmetic.

The words of a source, in a fixed document order, are cut into blocks of
``block_words``.  A source whose target is T words gives as many output slots
as T needs: whole passes over its blocks, then part of one more.  A keyed
permutation of all slots deals them to output shards; the number of slots of
each source in a shard is then a multinomial draw given the totals of the run
(:func:`shard_counts`).  Within a source, slot i takes block p(i) of a keyed
permutation of the block numbers, one permutation per pass, and joins the
blocks on (source, block).  No step keeps state from one slot to the next, and
every slot can be computed again from its number.

Edge cases: a null source is a source of its own, after all others.  Null and
empty texts have size 0 and are taken 0 times.  Repeated rows count each for
itself.  An empty table gives an empty result.  Documents longer than a block
spread over several.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railtap.llm.common import WORD, block_number, need, running_total, stored, swap_or_not

WEIGHTS = (5, 2, 1)
_CHUNK = 8_192


@dataclass
class Mix:
    """Tables of one mix, all in the shared folder; ``total`` is the number of slots."""
    documents: DataFrame  # rid, doc_id, s, size, start
    sources: DataFrame  # s, source, size, target, ...
    slots: DataFrame  # shard, slot, s, pass, block, words
    pieces: DataFrame  # s, block, rid, start (in the document), from (in the block), length
    total: int

    def spans(self) -> DataFrame:
        """One row per slot and document piece: what the slot takes of which document."""
        length = F.least(F.col("length"), F.col("words") - F.col("from"))
        return (self.slots.join(self.pieces, ["s", "block"]).withColumn("length", length).filter("length > 0")
                .select("shard", "slot", "s", "pass", "block", "rid", "start", "from", "length"))

    def shard_counts(self) -> DataFrame:
        """Slots of each source in each output shard."""
        return self.slots.groupBy("shard", "s").agg(F.count("*").alias("slots"))


def targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """A row per source (s: its place by code point, null last) with its share of ``percent`` % of all words.

    Shares follow the weights, but none exceeds ``most`` times its source's
    size; what exceeds it goes to the others by weight.  With sources sorted by
    size per weight, those before the first that stays below its bound are the
    ones at the bound.
    """
    one = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    df = sizes.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    df = df.withColumn("weight", weight).withColumn("bound", F.col("size") * most)
    by = Window.partitionBy(F.lit(0)).orderBy(F.col("bound") / F.col("weight"), "s")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("left", F.sum("size").over(one) * percent / 100.0 - F.coalesce(F.sum("bound").over(before), F.lit(0)))
    df = df.withColumn("per_weight", F.col("left") / (F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    df = df.withColumn("full", F.col("bound") / F.col("weight") <= F.col("per_weight"))
    level = F.max(F.when(~F.col("full"), F.col("per_weight"))).over(one)
    target = F.when(F.col("full"), F.col("bound").cast("double")).otherwise(
        F.least(F.col("weight") * level, F.col("bound").cast("double")))
    return df.withColumn("target", F.coalesce(target, F.lit(0.0))).select("s", "source", "size", "target")


def _plan(sources: DataFrame, block_words: int) -> DataFrame:
    """Passes, slots and the words cut off the last slot of each source."""
    df = (sources.withColumn("want", F.floor("target").cast("long"))
          .withColumn("blocks", F.expr(f"(size + {block_words - 1}) div {block_words}"))
          .withColumn("even", F.expr(f"size div {block_words}"))
          .withColumn("passes", F.expr("CASE WHEN size > 0 THEN want div size ELSE 0L END"))
          .withColumn("rest", F.col("want") - F.col("passes") * F.col("size"))
          .withColumn("more", F.expr(f"(rest + {block_words - 1}) div {block_words}"))
          .withColumn("cut", F.when(F.col("more") == F.col("blocks"), F.col("size")).otherwise(
              F.col("more") * block_words) - F.col("rest"))
          .withColumn("n", F.col("passes") * F.col("blocks") + F.col("more")))
    before = Window.partitionBy(F.lit(0)).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn(
        "total", F.sum("n").over(Window.partitionBy(F.lit(0))))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = 150, most: int = 2,
        block_words: int = 256, shard_slots: int = 1024, seed: int = 7) -> Mix:
    """Mix ``docs`` (rid unique, doc_id, source, size in words, mark: a hash of the text) to the weights."""
    spark = docs.sparkSession
    sizes = docs.groupBy("source").agg(F.sum("size").alias("size"))
    sources = stored(_plan(targets(sizes, weights, percent, most), block_words), "mix-sources")
    named = docs.join(sources.select(F.col("source").alias("_source"), "s"), F.col("source").eqNullSafe(F.col("_source")))
    # the order comes from what the rows hold, not from how the table was split: another run gives the same mix
    documents = stored(running_total(named.select("rid", "doc_id", "s", "size", "mark"), ["s"], ["doc_id", "mark", "rid"], F.col("size"),
                                     "start", block_number(docs.count()), ["doc_id", "mark"]).drop("mark"), "mix-documents")

    # slots of a source, dealt out in chunks so that a large source is no single task's work; they are written, so
    # that the joins below know how many there are
    total = int(sources.agg(F.sum("n")).first()[0] or 0)
    chunks = sources.filter("n > 0").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {_CHUNK}"))))
    slots = chunks.repartition(1 + total // (8 * _CHUNK), F.col("s"), F.col("chunk")).withColumn(
        "i", F.explode(F.sequence(F.col("chunk") * _CHUNK, F.least(F.col("n"), (F.col("chunk") + 1) * _CHUNK) - 1)))
    slots = slots.withColumn("pass", F.expr("i div blocks")).withColumn("t", F.col("i") % F.col("blocks"))
    place = swap_or_not(F.col("first") + F.col("i"), F.col("total"), F.lit(seed))
    # the short last block of a source keeps its place at the end of each pass
    block = F.when(F.col("t") < F.col("even"), swap_or_not(F.col("t"), F.col("even"), F.lit(seed + 1), F.col("s"), F.col("pass"))
                   ).otherwise(F.col("t"))
    words = F.when(F.col("t") < F.col("even"), F.lit(block_words).cast("long")).otherwise(F.col("size") % block_words)
    last = (F.col("i") == F.col("n") - 1) & (F.col("more") > 0)
    slots = slots.withColumn("place", place).withColumn("block", block).withColumn(
        "words", words - F.when(last, F.col("cut")).otherwise(F.lit(0)))
    slots = stored(slots.select(F.expr(f"place div {shard_slots}").alias("shard"), (F.col("place") % shard_slots).alias("slot"),
                                "s", "pass", "block", "words"), "mix-slots")

    some = documents.filter("size > 0").withColumn("end", F.col("start") + F.col("size"))
    pieces = some.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(end - 1) div {block_words}"))))
    lo = F.greatest(F.col("start"), F.col("block") * block_words)
    pieces = pieces.select("s", "block", "rid", (lo - F.col("start")).alias("start"), (lo - F.col("block") * block_words).alias("from"),
                           (F.least(F.col("end"), (F.col("block") + 1) * block_words) - lo).alias("length"))
    return Mix(documents, sources, slots, pieces, total)


def sized(docs: DataFrame) -> DataFrame:
    """Number the rows and count their words; the narrow copy is read from then on."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return stored(need(docs, "doc_id", "source", "text").select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "source", size.alias("size"), F.xxhash64("text").alias("mark")), "mix-sizes")


def taken(m: Mix) -> DataFrame:
    """Each document with the words that the mix takes of it, repeats counted."""
    got = m.spans().groupBy("rid").agg(F.sum("length").alias("taken"))
    per = m.sources.select("s", F.col("size").alias("source_size"), "target")
    return (m.documents.join(got, "rid", "left").join(per, "s")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus in the columns of ``docs``: a row per document and pass, with the words taken in it.

    A document taken whole keeps its text; else the taken words follow one
    another in document order, each with the white space before it.  ``n_chars``
    is the length of the new text.  Documents without words are not drawn.
    """
    spark = docs.sparkSession
    columns = docs.columns
    kept = stored(need(docs, "doc_id", "text", "lang", "source", "n_chars").withColumn(
        "rid", F.monotonically_increasing_id()), "mix-texts")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    m = mix(stored(kept.select("rid", "doc_id", "source", size.alias("size"), F.xxhash64("text").alias("mark")), "mix-sizes"), **options)
    drawn = (m.spans().groupBy("rid", "pass").agg(F.sum("length").alias("words"),
                                                  F.sort_array(F.collect_list(F.struct("start", "length"))).alias("parts"))
             .join(m.documents.select("rid", "size"), "rid"))
    drawn = drawn.withColumn("parts", F.when(F.col("words") < F.col("size"), F.col("parts")))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)"), F.lit(0))
    # one binding of the words, so that they are found once per document and not once per stretch
    cut = F.transform(F.array(words), lambda w: F.concat_ws("", F.flatten(F.transform(
        "parts", lambda p: F.slice(w, p["start"].cast("int") + 1, p["length"].cast("int"))))))
    cut = F.regexp_replace(F.element_at(cut, 1), r"^[\x20\x09-\x0D]+", "")
    out = kept.join(drawn.select("rid", "parts"), "rid").withColumn(
        "text", F.when(F.col("parts").isNull(), F.col("text")).otherwise(cut))
    out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*[c for c in columns if c in out.columns])
