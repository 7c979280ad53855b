"""Mix sources to target weights: how many words to take of each source, and of which documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabulant.llm.shared import prefix_sums, word_count
from tabulant.storage import stored

#: The characters between words, as a class of a regular expression.
BLANK_CLASS = " \\t\\n\\x0B\\f\\r"

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix per word of the input.
SHARE = 1.5
#: How often a source may be read at most.
MOST_EPOCHS = 2


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, most_epochs: int) -> DataFrame:
    """One row per source: ``source, position, source_start, source_size, target``.

    ``source_start`` counts the words of all sources before it.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times all
    words; none gets more than ``most_epochs`` times its own, and what it can't take goes to the
    others by weight. With the sources sorted by size per weight, prefix sums give the level at
    which each would stand if all before it were full; the first that can hold its share sets it.
    """
    totals = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    by_name = {"position": F.lit(1).cast("long"), "source_start": F.col("source_size")}
    placed = prefix_sums(totals, [F.col("source").asc_nulls_last()], by_name)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    weighed = stored(placed.withColumn("weight", weight), "sources")
    all_size, all_weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    order = [F.col("source_size") / F.col("weight"), F.col("position")]
    filled = prefix_sums(weighed, order, {"size_before": F.col("source_size"), "weight_before": F.col("weight")})
    left = F.lit(share * float(all_size or 0)) - most_epochs * F.col("size_before").cast("double")
    level = left / (F.lit(all_weight or 0) - F.col("weight_before"))
    cap = most_epochs * F.col("source_size").cast("double")
    holding = filled.select(level.alias("level"), (cap >= F.col("weight") * level).alias("holds")).where("holds")
    # The first that holds has the highest level; if none holds, all sources are full.
    found = holding.agg(F.max("level")).first()[0]
    target = cap if found is None else F.least(cap, F.col("weight") * F.lit(found))
    return weighed.select("source", "position", "source_start", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    *,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most_epochs: int = MOST_EPOCHS,
    seed: int = 17,
) -> DataFrame:
    """One row per document: ``doc_id, text_hash, source, size, source_size, target, taken``.

    Each document gets a random-looking key, the MD5 of its id; its source is sorted by that key, and a
    distributed prefix sum of words says where in the source it lies. Whole epochs are taken first;
    the rest is cut at the source's budget, rounded down, so the one document at the cut gives
    only the words that still fit (``taken`` is then no multiple of ``size``).

    Null texts and ids: size 0 for a null text; null ids hash as any other value. Rows repeated in
    full are rows of their own; since they tie in every key, which of them lies at the cut is the
    same to the result. A null source is a source. Empty input gives no rows. Further columns of
    ``docs`` are not looked at.
    """
    texts = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    sized = stored(texts, "sized")
    targets = stored(source_targets(sized, weights, share, most_epochs), "targets")
    known = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"#{seed}")))
    order = [F.col("position"), key, F.col("doc_id"), F.col("text_hash")]
    placed = prefix_sums(known, order, {"before": F.col("size")})
    epochs = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))
    rest = F.floor(F.col("target") - epochs * F.col("source_size"))
    within = F.col("before") - F.col("source_start")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - within))
    taken = F.when(F.col("size") > 0, epochs * F.col("size") + part).otherwise(F.lit(0)).cast("long")
    return placed.select("doc_id", "text_hash", "source", "size", "source_size", "target", taken.alias("taken"))


def first_words(text: Column, count: Column) -> Column:
    """A text up to the end of its first ``count`` words, with the blanks among them."""
    pieces = F.split(text, f"(?<=[{BLANK_CLASS}])(?=[^{BLANK_CLASS}])")
    leading = F.when(text.rlike(f"^[{BLANK_CLASS}]"), 1).otherwise(0)
    return F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), (count + leading).cast("int")), ""), f"[{BLANK_CLASS}]+$", "")


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, each as often as it is read.

    The document at a source's cut comes with the words that fit, and its ``n_chars``, if there is
    such a column, says so. Documents without words are in no mix. Rows repeated in full share
    evenly what falls to them, rounded down. Columns stay as they are, whatever their names.
    """
    names = docs.columns
    # The row travels as one struct, so that no column of the input meets a helper's name.
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("row.source").eqNullSafe(F.col("source"))
    taken = mix(docs, **parameters).groupBy("doc_id", "text_hash", "source").agg(
        F.floor(F.sum("taken") / F.count("*")).alias("taken"), F.first("size").alias("size")
    )
    read = rows.join(taken.where("taken > 0"), same & (F.xxhash64("row.text") == F.col("text_hash")))
    rest = F.col("taken") % F.col("size")
    whole = F.array_repeat(F.col("size"), F.floor(F.col("taken") / F.col("size")).cast("int"))
    read = read.select("row", "size", F.explode(F.when(rest > 0, F.array_append(whole, rest)).otherwise(whole)).alias("words"))
    cut = F.col("words") < F.col("size")
    text = F.when(cut, first_words(F.col("row.text"), F.col("words"))).otherwise(F.col("row.text"))
    changed = {"text": text}
    if "n_chars" in names:
        length = F.length(text).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(cut, length).otherwise(F.col("row.n_chars"))
    return read.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in names])
