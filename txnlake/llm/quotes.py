"""Conversations in reply order from messages that quote each other.

Every line of a message has a quote level, the number of its leading marks. Lines are normalised and hashed; a
quoted line is joined to the lines that earlier messages of its conversation wrote themselves, and a message
answers the one that most of its quoted lines, of the lowest level that is found, come from. A message that
quotes nothing known answers the one before it. A message that is the first answer to another goes on with its
branch, any other answer opens a branch; branches by their heads, each in its order, are the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txnlake.plans.groups import carry_forward, durable, row_position

#: Up to three blanks may stand before each mark, as in mail and Markdown.
MARKS = r"^((?:[ \t]{0,3}>)+)[ \t]?"
#: A line that introduces a quotation, dropped if a quoted line follows.
INTRODUCTION = r"(?i)^.{0,200}(wrote|writes|said|schrieb|escribió|a écrit)\s*:\s*$"


def quote_level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 1)
    return F.char_length(marks) - F.char_length(F.replace(marks, F.lit(">"), F.lit("")))


def _normalised(line: Column) -> Column:
    """Lower case, single blanks, no marks at the start."""
    bare = F.regexp_replace(line, MARKS, "")
    return F.trim(F.regexp_replace(F.lower(bare), r"\s+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """conv, conv_id, turn, role, tie, body, own and quoted (hashes and levels of lines) of every message.

    ``body`` is the text without quoted lines and without the introductions of quotations, trimmed.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = messages.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"),
        "role", F.xxhash64("role", "text").alias("tie"), F.split(text, "\r?\n", -1).alias("lines"))
    leveled = rows.withColumn("lines", F.transform("lines", lambda x: F.struct(quote_level(x).alias("level"), x.alias("line"), _normalised(x).alias("plain"))))
    following = lambda i: F.coalesce(F.try_element_at(F.col("lines"), i + 2)["level"], F.lit(0))
    kept = F.filter("lines", lambda x, i: (x["level"] == 0) & ~((following(i) > 0) & x["line"].rlike(INTRODUCTION)))
    hashed = lambda x: F.xxhash64(x["plain"])
    return leveled.select(
        "conv", "conv_id", "turn", "role", "tie",
        F.trim(F.regexp_replace(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")).alias("body"),
        F.array_distinct(F.transform(F.filter(kept, lambda x: x["plain"] != ""), hashed)).alias("own"),
        F.array_distinct(F.transform(
            F.filter("lines", lambda x: (x["level"] > 0) & (x["plain"] != "")),
            lambda x: F.struct(x["level"].alias("level"), hashed(x).alias("hash")))).alias("quoted"),
    )


def links(rows: DataFrame) -> DataFrame:
    """conv, pos and answered (the position of the message it quotes most) of the messages that quote a known line.

    Of the originals of a line the latest earlier one counts; a line that very many messages share is one row for
    each position range looked up, never a pair with each of them. Ties go to the later message.
    """
    quoted = rows.select("conv", "pos", F.explode("quoted").alias("l")).select("conv", "pos", "l.hash", "l.level")
    wanted = quoted.select("conv", "hash").distinct()
    own = rows.select("conv", "pos", F.explode("own").alias("hash")).join(wanted, ["conv", "hash"], "left_semi")
    # Originals and quotations of a line in order: the last original before a quotation is a running maximum.
    events = own.select("conv", "hash", "pos", F.lit(None).cast("int").alias("level")).unionByName(quoted)
    before = Window.partitionBy("conv", "hash").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    found = events.withColumn("source", F.max(F.when(F.col("level").isNull(), F.col("pos"))).over(before))
    found = found.filter("level is not null and source is not null")
    counted = found.groupBy("conv", "pos", "level", "source").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("conv", "pos").agg(F.min(F.struct("level", -F.col("n"), -F.col("source"))).alias("b"))
    return best.select("conv", "pos", (-F.col("b.col3")).alias("answered"))


def _heads(steps: DataFrame) -> DataFrame:
    """conv, pos, head: the position that ``steps`` (conv, pos, up; up < pos, or pos itself at a head) lead to.

    Stretches of messages that each go on with the one before are one step, found by carrying their starts
    forward. Only starts that go on with a message elsewhere are followed; each round doubles the length of the ways.
    """
    starts = steps.withColumn("run", F.when(F.col("up") != F.col("pos") - 1, F.col("pos")))
    runs = durable(carry_forward(starts, ["conv"], [F.col("pos")], ["run"]))
    places = runs.select(F.col("conv").alias("c"), F.col("pos").alias("p"), F.col("run").alias("over"))
    jumps = runs.filter((F.col("run") == F.col("pos")) & (F.col("up") < F.col("pos")))
    jumps = jumps.join(places, (F.col("conv") == F.col("c")) & (F.col("up") == F.col("p"))).select("conv", F.col("pos").alias("run"), "over")
    while True:
        jumps = durable(jumps)
        next_ = jumps.select(F.col("conv").alias("c"), F.col("run").alias("r"), F.col("over").alias("further"))
        moved = jumps.join(next_, (F.col("conv") == F.col("c")) & (F.col("over") == F.col("r")), "left")
        if moved.filter("further is not null").isEmpty():
            break
        jumps = moved.select("conv", "run", F.coalesce("further", "over").alias("over"))
    ends = jumps.select(F.col("conv").alias("c"), F.col("run").alias("r"), "over")
    whole = runs.join(ends, (F.col("conv") == F.col("c")) & (F.col("run") == F.col("r")), "left")
    return whole.select("conv", "pos", F.coalesce("over", "run").alias("head"))


def link_quotations(messages: DataFrame) -> DataFrame:
    """Messages in reply order: conv_id, turn, role, text (without quotations), n_quoted, level, answers, linked, branch, place.

    ``messages`` needs conv_id, turn, role and text; other columns are left out. ``answers`` is the turn of the message
    that is answered (null for the first), ``linked`` whether a quotation says so, ``branch`` the turn of the head of
    the message's branch, ``place`` its place in the conversation from 0. Messages lie in a conversation by turn
    (null first), repeated turns by a hash of role and text; equal rows are messages of their own. A null
    conv_id is a conversation. Null texts are empty.
    """
    rows = durable(parsed(messages).withColumn("row", F.monotonically_increasing_id()))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "tie", "row")]
    rows = durable(row_position(rows, ["conv"], order, "pos"))
    found = links(rows).withColumnRenamed("pos", "p").withColumnRenamed("conv", "c")
    joined = rows.join(found, (F.col("conv") == F.col("c")) & (F.col("pos") == F.col("p")), "left").drop("c", "p")
    answers = F.coalesce(F.col("answered"), F.when(F.col("pos") > 1, F.col("pos") - 1))
    joined = durable(joined.select(*rows.columns, F.col("answered").isNotNull().alias("linked"), answers.alias("parent")))
    eldest = joined.filter("parent is not null").groupBy(F.col("conv").alias("c"), F.col("parent").alias("m")).agg(F.min("pos").alias("eldest"))
    steps = joined.select("conv", "pos", "parent").join(eldest, (F.col("conv") == F.col("c")) & (F.col("parent") == F.col("m")), "left")
    steps = durable(steps.select("conv", "pos", F.when(F.col("pos") == F.col("eldest"), F.col("parent")).otherwise(F.col("pos")).alias("up")))
    heads = _heads(steps).withColumnRenamed("conv", "c").withColumnRenamed("pos", "p")
    turns = joined.select(F.col("conv").alias("tc"), F.col("pos").alias("tp"), F.col("turn").alias("answers"))
    whole = joined.join(heads, (F.col("conv") == F.col("c")) & (F.col("pos") == F.col("p"))).drop("c", "p")
    whole = whole.join(turns, (F.col("conv") == F.col("tc")) & (F.col("parent") == F.col("tp")), "left").drop("tc", "tp")
    named = turns.withColumnRenamed("answers", "branch")
    whole = whole.join(named, (F.col("conv") == F.col("tc")) & (F.col("head") == F.col("tp"))).drop("tc", "tp")
    placed = row_position(durable(whole), ["conv"], [F.col("head"), F.col("pos")], "place")
    levels = F.transform("quoted", lambda x: x["level"])
    return placed.select(
        "conv_id", "turn", "role", F.col("body").alias("text"), F.size("quoted").cast("long").alias("n_quoted"),
        F.coalesce(F.array_max(levels), F.lit(0)).cast("int").alias("level"), "answers", "linked", "branch", (F.col("place") - 1).cast("long").alias("place"))
