"""What follows from where declarations, comments and errors stand: names, owners and structural errors.

Inputs are relations of places, as a scan or any other parser may give them; nothing here reads
a text. All keys begin with a file, so joins stay within it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.naming import anonymous_segment, child_name
from ..sources.scratch import Tables


def paths_above(tables: Tables, links: DataFrame) -> DataFrame:
    """file_ord, ord, path: the segments from the top down to each place and its own, null if there are none.

    links: file_ord, ord, up (null at the top), segment (null: none of its own). Each round a place
    takes over what the place above it knows, so a path of length n is complete after log2(n) rounds.
    """
    known = links.select("file_ord", "ord", "up", F.col("segment").alias("path"))
    step = 0
    while True:
        known = tables.cut(known, f"paths{step}")
        if not known.where("up IS NOT NULL").limit(1).count():
            return known.drop("up")
        above = known.select("file_ord", F.col("ord").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        met = known.where("up IS NOT NULL").join(above, ["file_ord", "up"], "left")
        done = known.where("up IS NULL")
        path = F.when(F.col("head").isNull(), F.col("path")).when(F.col("path").isNull(), F.col("head")).otherwise(child_name(F.col("head"), F.col("path")))
        known = done.unionByName(met.select("file_ord", "ord", F.col("next").alias("up"), path.alias("path")))
        step += 1


def compose_names(declarations: DataFrame) -> DataFrame:
    """declarations with their segment and qualified_name.

    declarations: file_ord, ord, up (ord of the declaration or block that holds it, null at the
    top), file_ref (the file's name), kind, name (null: anonymous), named (whether it names what it
    holds; a block that is no fact has a kind of null and names by its type). Anonymous ones are
    numbered from 0 among those of their kind below one name, in order. Two declarations of one
    name share that numbering, so it is settled from the top down: a round for each level at which
    equal names hold anonymous declarations, and one where none do.
    """
    tables = Tables(declarations.sparkSession, "names")
    rows = tables.cut(declarations.select("file_ord", "ord", "up", "file_ref", "kind", "name", "named"), "declarations")
    key, number, step = ["file_ord", "up", "kind"], None, 0
    while True:
        if number is None:
            among = Window.partitionBy(*key).orderBy("ord")
            numbers = rows.where("name IS NULL AND kind IS NOT NULL").select("file_ord", "ord", (F.row_number().over(among) - 1).alias("n"))
        else:
            numbers = number
        numbers = tables.cut(numbers, f"numbers{step}")
        own = rows.join(numbers, ["file_ord", "ord"], "left").withColumn("segment", F.coalesce("name", anonymous_segment(F.col("kind"), F.col("n"))))
        own = tables.cut(own, f"segments{step}")
        above = paths_above(tables, own.select("file_ord", "ord", "up", F.when(F.col("named"), F.col("segment")).alias("segment")))
        held = own.join(above.select("file_ord", F.col("ord").alias("up"), F.col("path").alias("head")), ["file_ord", "up"], "left")
        below = F.when(F.col("head").isNull(), F.col("file_ref")).otherwise(child_name(F.col("file_ref"), F.col("head")))
        found = tables.cut(held.withColumn("below", below).withColumn("qualified_name", child_name(F.col("below"), F.col("segment"))), f"names{step}")
        among = Window.partitionBy("file_ord", "below", "kind").orderBy("ord")
        number = found.where("name IS NULL AND kind IS NOT NULL").select("file_ord", "ord", "n", (F.row_number().over(among) - 1).alias("again"))
        number = tables.cut(number, f"again{step}")
        if not number.where("n <> again").limit(1).count():
            return declarations.join(found.select("file_ord", "ord", "segment", "qualified_name"), ["file_ord", "ord"])
        number, step = number.select("file_ord", "ord", F.col("again").alias("n")), step + 1


def own_comments(events: DataFrame) -> DataFrame:
    """file_ord, frame, ord, owner of every comment.

    events: file_ord, frame, ord, sort (comment, inner, declaration, import, other), name (of a
    declaration; of what holds the frame, for comments). A run of comments owns the next declaration
    of its frame if only imports lie between; other statements and the frame's end cut it off, and its
    comments stay with what holds the frame, as inner comments do. The islands need no numbers: what
    ends a comment's run is the next row of its frame that may end one.
    """
    ahead = Window.partitionBy("file_ord", "frame").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    ends = F.when(F.col("sort").isin("declaration", "other"), F.struct(F.col("sort").alias("by"), F.col("name").alias("of")))
    met = events.withColumn("ended", F.first(ends, ignorenulls=True).over(ahead)).where("sort IN ('comment', 'inner')")
    return met.select("file_ord", "frame", "ord", F.when((F.col("sort") == "comment") & (F.col("ended.by") == "declaration"), F.col("ended.of")).otherwise(F.col("name")).alias("owner"))


def structural_errors(spans: DataFrame, errors: DataFrame, bin_size: int = 4096) -> DataFrame:
    """file_ord, errors, at: how many errors each file of errors has, and the first that breaks the structure of its declarations (null if all lie in bodies).

    spans: file_ord, start, stop, body (where an executable body begins; null for declarations that
    hold further ones). errors: file_ord, at. An error is judged by the innermost declaration around
    it: it is local if it lies in that one's body, else structural, as it is outside of all. Spans are
    cut into bins, so an error meets those of its own place only; of these the latest to begin is the
    innermost, as declarations nest.
    """
    few = spans.join(errors.select("file_ord").distinct(), "file_ord", "left_semi")
    binned = few.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.greatest("start", F.col("stop") - 1) / bin_size))))
    placed = errors.select("file_ord", "at").distinct().withColumn("bin", F.floor(F.col("at") / bin_size))
    met = placed.join(binned, ["file_ord", "bin"], "left").withColumn("inside", F.coalesce((F.col("start") <= F.col("at")) & (F.col("at") < F.col("stop")), F.lit(False)))
    inner = met.groupBy("file_ord", "at").agg(F.max(F.when(F.col("inside"), F.struct("start", (-F.col("stop")).alias("stop"), "body"))).alias("d"))
    local = F.coalesce(F.col("d.body") <= F.col("at"), F.lit(False))
    return inner.groupBy("file_ord").agg(F.count("*").alias("errors"), F.min(F.when(~local, F.col("at"))).alias("at"))
