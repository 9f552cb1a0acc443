"""Line dedup: repeated runs of lines by a suffix array over line ids; DataFrame expressions only.

A line ends at newlines, or after ``.``, ``!`` or ``?`` before a blank, so that
a passage is found wherever it stands in a paragraph.  A line's id is a 96-bit
hash of its trimmed text.  All texts stand one after the other, by id and then
by content, so that a line has one global position.

Whole copies of a text are told by its hash first, and only the first of them
has suffixes: were they all there, the first copy's lines would come first in
every run of the others, whose lines all go if the text has ``min_words`` words.

*Prefix doubling.*  Each round ranks the suffixes by twice as many lines, twice
over, and n more: the ranks by n lines at a position and n, 2n, 3n and 4n lines
on, sorted, give the rank by 5n lines.  A suffix whose rank nothing shares leaves, since it
repeats nothing; so does one whose lines have ``min_words`` words even without
their first or last line, since no shortest run is that long.  So the rounds end
at a depth of ``min_words`` lines, however long a repeat is.

*Intervals.*  Suffixes that agree in their first n lines are an interval of the
suffix array whose longest common prefix is n or more.  Overlapping ranks of the
last round up to n, the last of them ending with the run, name the interval.
Its first member stays; in the others those n lines are deleted.  The runs
looked at have ``min_words`` words and are the shortest from their first or to
their last line.  A maximal repeated run is the union of the
shortest ones within it, so exactly the lines of such runs go, but for their
first copy, and every deleted line has an equal earlier line that stays.

Least positions are summed up before each exchange, and the joins back to the
suffixes are plain ones, whose hot keys Spark splits: no interval is gathered.

Defined results: null and empty texts have no lines and stay as they are; rows
that agree in id and text are one document, and don't delete each other's
lines; other rows that share an id are documents of their own, earlier by the
hash of their text; null ids come last; overlapping repeats within a text keep
their first line; a line without words counts as one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .texts import others

#: Zero-width: after newlines, and after the blank that ends a sentence.
LINE_END = r"(?<=\n)(?!\n)|(?<=[.!?] )"
#: The same places, but for the blank or newline before them: few characters are looked at twice, and a trimmed line doesn't have it.
LINE_BREAK = r"[ \n](?:(?<=[.!?] )|(?<=\n)(?!\n))"
#: Bits for the positions of one task's texts.
PLACE_BITS = 42
#: Ranks that one round joins: two doublings and a fifth part, so that twenty lines take two rounds.
FOLD = 5
#: Rows of a list of copies that may be sent to every task.
FEW = 500_000
#: More words than a text can have: what a line that isn't there counts for.
GAP = 1 << 31


def lines(text: Column) -> Column:
    """The lines of a text with their ends: joined, they are the text."""
    return F.filter(F.split(text, LINE_END), lambda p: p != "")


def content(text: Column) -> list[Column]:
    """96 bits that tell apart the texts of one id."""
    return [F.xxhash64(text).alias("h"), F.hash(text).alias("g")]


def trimmed(part: Column) -> Column:
    """``part`` without white space around it; most lines have none, and are told so by their ends."""
    spaces = " \t\r\n"
    spaced = reduce(Column.__or__, (at(part, F.lit(c)) for c in spaces for at in (F.startswith, F.endswith)))
    return F.when(spaced, F.btrim(part, F.lit(spaces))).otherwise(part)


def line_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(row, pos, h, g, words, doc)``: each line's id and words; a row's first line has ``doc(id, h, g, size)``."""
    text = F.col(text_col).cast("string")
    doc = F.struct(F.col(id_col).alias("id"), *content(text), (F.octet_length(text) + 2).cast("long").alias("size"))
    rows = df.select(F.monotonically_increasing_id().alias("row"), doc.alias("doc"), F.split(text, LINE_BREAK).alias("parts"))
    # nothing follows the last break of a text that ends with one
    rows = rows.select("row", "doc", "parts", (F.size("parts") - (F.element_at("parts", -1) == "").cast("int")).alias("n"))
    each = rows.select("row", "doc", "n", F.posexplode("parts").alias("pos", "part")).filter("pos < n")
    blank = F.lit(" ")
    words = F.octet_length("body") - F.octet_length(F.replace(F.col("body"), blank, F.lit(""))) + 1
    return each.select("row", "doc", "pos", trimmed(F.col("part")).alias("body")).select("row", "pos", *content(F.col("body")), words.alias("words"), F.when(F.col("pos") == 0, F.col("doc")).alias("doc"))


def documents(each: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(row, id, h, g, start)``, a row for each document but whole copies, with the global position of its first line; and ``(row, id, h, g)`` of the copies.

    A copy has the text of an earlier document: all that can be said of its lines is known.
    """
    docs = each.filter("doc is not null").select("row", "doc.*").groupBy("id", "h", "g").agg(F.min("row").alias("row"), F.first("size").alias("size"))
    docs = scratch.save(docs)
    # by text, summed up before the exchange, and written, so that Spark can split a hot text
    first = scratch.save(docs.groupBy("h", "g").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "g", F.col("first.row").alias("row")))
    copies = scratch.save(docs.join(first.select("h", "g", F.col("row").alias("first")), ["h", "g"]).filter("row != first").select("row", "id", "h", "g"))
    placed = docs.join(copies.select("row"), "row", "left_anti").orderBy(F.col("id").asc_nulls_last(), "h", "g")
    placed = scratch.save(placed.select("*", F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("place")))
    before = F.sum("size").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    return placed.select("row", "id", "h", "g", (F.shiftleft("part", PLACE_BITS) + F.coalesce(before, F.lit(0))).alias("start")), copies


def few(df: DataFrame) -> DataFrame:
    """``df`` sent to every task if it has few rows; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def ranked(keyed: DataFrame, scratch: Scratch, *keys: str) -> DataFrame:
    """``(keys, rank)`` of the keys that more than one row has, ranked by their order."""
    # written, since the order's bounds are taken from a pass of their own
    shared = scratch.save(keyed.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys))
    return shared.orderBy(*keys).select(*keys, F.monotonically_increasing_id().alias("rank"))


def further(suffixes: DataFrame, size: int, min_words: int) -> DataFrame:
    """The suffixes ranked by ``size`` lines: ``row, pos, first, upto, low, high, r0, r1 ..``, and ``words`` where they can grow.

    ``r0, r1 ..`` are the ranks of the suffix and of the next ones.  The shortest
    runs of ``size`` lines up to ``FOLD`` times as many end ``low`` to ``high``
    suffixes on, and each is covered by ranks that overlap; ``low`` is null where
    there are none.  ``words`` are those of ``FOLD`` times as many lines: null
    where no shortest run is that long, and missing where none can be.
    """
    by = Window.partitionBy("row").orderBy("pos")
    most = min(FOLD * size - 1, min_words)  # a line has a word at least
    grows = FOLD * size <= min_words
    ends, end = range(most - size + 1), (FOLD - 1) * size
    steps = range(1, max(ends[-1], end * grows) + 1)
    counted = suffixes.select("*", F.row_number().over(by).alias("nth"))
    # a line alone in its rank isn't there, and none in a repeated run is: words up to a place past it are too many
    counted = counted.withColumn("from", F.col("upto") - F.col("first") + (F.col("pos") - F.col("nth")) * F.lit(GAP))
    placed = counted.select("row", "pos", "first", "upto", "from", (F.col("from") + F.col("words")).alias("s0"), F.col("rank").alias("r0"))
    far = 3 << 61  # past all places, and differences fit
    seen = placed.select("*", *(F.lead("s0", n, far).over(by).alias(f"s{n}") for n in steps), *(F.lead("r0", n).over(by).alias(f"r{n}") for n in steps))
    # words only grow from end to end
    below = lambda words: reduce(Column.__add__, ((F.col(f"s{n}") - F.col("from") < words).cast("int") for n in ends))
    out = ["row", "pos", "first", "upto", *(f"r{n}" for n in (0, *steps))]
    if grows:
        words = F.col(f"s{end}") - F.col("from")
        # without the first or the last line
        held = (words < GAP) & ((words - F.col("first") < min_words) | (F.col(f"s{end - 1}") - F.col("from") < min_words))
        out.append(F.when(held, words).alias("words"))
    # of the ends that are there, the first with enough words, and the last whose run has too few without its first line
    seen = seen.select(*out, below(min_words).alias("low"), below(min_words + F.col("first")).alias("high"), below(GAP).alias("there"))
    seen = seen.withColumn("low", F.when(F.col("low") < F.col("there"), F.col("low")))
    return seen.withColumn("high", F.greatest(F.col("low"), F.col("high") - 1)).drop("there")


def runs_of(seen: DataFrame, size: int, min_words: int) -> DataFrame:
    """``(row, at, n, x0 .. x4)``: the shortest runs that :func:`further` found, named by ranks up to the last one's."""
    ranks = [f"r{n}" for n in range(min(FOLD * size - 1, min_words) - size + 1)]
    # a filter before would count all ends once more
    ends = seen.select("row", (F.col("start") + F.col("pos")).alias("at"), *ranks, F.explode_outer(F.sequence("low", "high")).alias("end")).filter("end is not null")
    parts = (F.get(F.array(*ranks), F.least(F.lit(k * size), "end")).alias(f"x{k}") for k in range(FOLD))
    return ends.select("row", "at", (F.col("end") + size).alias("n"), *parts)


def later_copies(df: DataFrame, id_col: str, text_col: str, min_words: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(row, at, n)``, the shortest repeated runs but for the first of each; the documents; and ``(row, id, h, g, lines, words)`` of whole copies."""
    whole = scratch.save(line_table(df, id_col, text_col))
    docs, copies = documents(whole, scratch)
    docs = scratch.save(docs)
    gone = few(copies.select("row"))
    copies = scratch.save(copies.join(whole.join(gone, "row", "left_semi").groupBy("row").agg(F.count("*").alias("lines"), F.sum("words").alias("words")), "row"))
    each = whole.join(gone, "row", "left_anti")
    ids = scratch.save(ranked(each, scratch, "h", "g"))
    level = each.drop("doc").join(ids, ["h", "g"])
    level = level.select("row", F.col("pos").cast("long"), "rank", F.col("words").cast("long"), F.col("words").cast("long").alias("first"))
    so_far = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = level.select("*", F.sum("words").over(so_far).alias("upto"))
    size, found, done, keys = 1, [], [whole], [f"x{k}" for k in range(FOLD)]
    while True:
        # the starts join rows that are in order for the window
        seen, last = further(level, size, min_words).join(docs.select("row", "start"), "row"), FOLD * size > min_words
        seen = seen if last else scratch.save(seen)
        found.append(scratch.save(runs_of(seen, size, min_words)))
        for old in done:
            scratch.drop(old)
        if last:
            break
        longer = seen.filter("words is not null").select("row", "pos", "first", "upto", "words", *(F.col(f"r{k * size}").alias(x) for k, x in enumerate(keys)))
        ranks = scratch.save(ranked(longer, scratch, *keys))
        level, done = longer.join(ranks, keys).drop(*keys), [seen, ranks]
        size *= FOLD
    name = ["n", *keys]
    runs = reduce(DataFrame.unionByName, found)
    firsts = runs.groupBy(*name).agg(F.min("at").alias("earliest"), F.max("at").alias("latest")).filter("earliest < latest").drop("latest")
    firsts = scratch.save(firsts)  # written, so that Spark can split the join's hot keys
    return runs.join(firsts, name).filter("at > earliest").select("row", "at", "n"), docs, copies


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20) -> DataFrame:
    """``df`` with the later copies of repeated line runs cut out of its text, and ``deleted``, the number of lines cut.

    A column of that name in ``df`` is replaced.
    """
    scratch = Scratch(df.sparkSession, "lines")
    runs, docs, copies = later_copies(df, id_col, text_col, min_words, scratch)
    # each line once: those up to the end of the runs that begin before
    earlier = Window.partitionBy("row").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("at") + F.col("n")
    new = runs.withColumn("from", F.greatest(F.col("at"), F.max(end).over(earlier))).filter(F.col("from") < end)
    gone = new.select("row", F.explode(F.sequence(F.col("from"), end - 1)).alias("at"))
    cut = gone.groupBy("row").agg(F.collect_list("at").alias("gone")).join(docs, "row")
    cut = cut.select("id", "h", "g", F.transform("gone", lambda x: (x - F.col("start")).cast("int")).alias("gone"))
    # a copy of enough words is one repeated run
    cut = cut.unionByName(copies.filter(F.col("words") >= min_words).select("id", "h", "g", F.sequence(F.lit(0), F.col("lines").cast("int") - 1).alias("gone")))
    cut = scratch.save(cut.select(*(F.col(c).alias(f"\x00{c}") for c in ("id", "h", "g", "gone"))))
    keep = others(df, "deleted")
    text = F.col(text_col).cast("string")
    h, g = content(text)
    same = F.col(id_col).eqNullSafe(F.col("\x00id")) & (h == F.col("\x00h")) & (g == F.col("\x00g"))
    joined = df.select(*keep).join(cut, same, "left").select(*keep, "\x00gone")
    # only texts that lose lines are split again; exploding an array of one keeps the planner from splitting them twice
    split = joined.select("*", F.explode(F.array(F.when(F.col("\x00gone").isNotNull(), lines(text)))).alias("\x00parts"))
    left = F.array_except(F.sequence(F.lit(0), F.size("\x00parts") - 1), F.col("\x00gone"))
    new = F.when(F.col("\x00gone").isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get("\x00parts", i)), ""))
    deleted = F.coalesce(F.size("\x00gone"), F.lit(0))
    return split.select(*(new.alias(c) if c == text_col else F.col(c) for c in keep), deleted.alias("deleted"))
