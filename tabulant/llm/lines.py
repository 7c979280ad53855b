"""Remove lines that many sites share, by sketches of how many sites each line is on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabulant.storage import stored

#: Sites a line must be on to count as boilerplate.
MIN_SITES = 10
#: Relative width round the threshold in which sketches don't decide; over ten standard errors at 2^12 registers.
MARGIN = 0.2
LG_REGISTERS = 12


#: Blanks that may stand at a line's ends besides the space; a file's carriage returns go with them.
BLANKS = "\t\x0b\f\r"


def identity(doc_id: Column, text: Column) -> Column:
    """What tells documents apart and orders them: id, null ids last, then the text's hash."""
    return F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), F.xxhash64(text).alias("text_hash"))


def numbered_lines(docs: DataFrame) -> DataFrame:
    """``at, site, line_no, line_hash`` of every line that isn't blank.

    Lines are compared without blanks at their ends. All that needs the whole text is computed before
    the lines are dealt out, so that rows of lines don't carry it; the rest is plain expressions on one line,
    which Spark compiles. The outer form keeps it from splitting every text twice, to see if it has lines.
    """
    site = F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit(""))
    lines = F.split(F.translate(docs["text"], BLANKS, " " * len(BLANKS)), "\n")
    whole = docs.select(identity(docs["doc_id"], docs["text"]).alias("at"), site.alias("site"), lines.alias("lines"))
    each = whole.select("at", "site", F.posexplode_outer("lines").alias("line_no", "line"))
    bare = each.select("at", "site", "line_no", F.trim("line").alias("bare")).where("bare <> ''")
    return bare.select("at", "site", "line_no", F.xxhash64("bare").alias("line_hash"))


def boilerplate(docs: DataFrame, *, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """``line_hash, sites, keep`` for every line on at least ``min_sites`` sites.

    ``sites`` is exact within ``margin`` of the threshold and else the sketch's estimate; ``keep``
    says where the line stands first: by document id (null ids last), text and line number.
    A document without source counts as one site of its own kind, shared by all such documents.

    A line needs as many occurrences as sites, so a count by hash, combined before its shuffle,
    leaves few lines to sketch. Sketches are merged by aggregation: a hot line costs one sketch a
    task. Lines near the threshold get exact counts from distinct (line, site) pairs.
    """
    lines = numbered_lines(docs)
    often = lines.groupBy("line_hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    often = stored(often.select("line_hash"), "often")
    common = lines.join(often, "line_hash")
    spread = common.groupBy("line_hash").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_REGISTERS))).alias("estimate"),
        F.min(F.struct("at", "line_no")).alias("keep"),
    )
    low, high = min_sites * (1 - margin), min_sites * (1 + margin)
    spread = stored(spread.where(F.col("estimate") >= low), "spread")
    near = spread.where(F.col("estimate") <= high).select("line_hash")
    pairs = lines.join(near, "line_hash").select("line_hash", "site").distinct()
    exact = pairs.groupBy("line_hash").agg(F.count("*").alias("exact"))
    sites = F.coalesce(F.col("exact"), F.col("estimate")).alias("sites")
    return spread.join(exact, "line_hash", "left").select("line_hash", sites, "keep").where(F.col("sites") >= min_sites)


def without_boilerplate(
    docs: DataFrame, *, min_sites: int = MIN_SITES, margin: float = MARGIN, keep_first: bool = True
) -> DataFrame:
    """The rows of ``docs`` with ``text`` freed of lines that ``min_sites`` sites share.

    Lines end at line feeds and are compared without blanks at their ends; blank lines are never
    boilerplate. With ``keep_first`` the first occurrence of a line in the whole input stays, so no
    text is lost; a line that one document repeats stays there once. Two columns are added,
    ``n_lines`` and ``n_removed``, before which columns of ``docs`` with those names are dropped.

    A null text stays null with 0 lines; an empty one is one blank line. Rows repeated in full are
    treated alike, so if they hold a first occurrence each keeps it. Null ids are allowed. A
    document that loses all lines stays, with an empty text.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # The row travels as one struct, so that no column of the input meets a helper's name.
    rows = docs.select(*[docs[f"`{c}`"] for c in names]).select(F.struct("*").alias("row"))
    rows = rows.withColumn("at", identity(F.col("row.doc_id"), F.col("row.text")))
    found = stored(boilerplate(docs, min_sites=min_sites, margin=margin), "boilerplate")
    removed = numbered_lines(docs).join(found, "line_hash")
    if keep_first:
        removed = removed.where(~F.struct("at", "line_no").eqNullSafe(F.col("keep")))
    # Documents are known by id and text, so the numbers gathered here are those of one text's lines.
    removed = removed.groupBy("at").agg(F.collect_set("line_no").alias("removed_lines"))
    same = (rows["at"]["doc_id"].eqNullSafe(removed["at"]["doc_id"])) & (rows["at"]["text_hash"] == removed["at"]["text_hash"])
    joined = rows.join(removed, same, "left").select("row", "removed_lines")
    lines, touched = F.split("row.text", "\n"), F.col("removed_lines").isNotNull()
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed_lines"))
    text = F.when(touched, F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")).otherwise(F.col("row.text"))
    return joined.select(
        *[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in names],
        F.when(F.col("row.text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(touched, F.size("removed_lines")).otherwise(0).cast("long").alias("n_removed"),
    )
