"""Quotation linking: conversations in reply order, without quotes.

A line's quote level is the number of '>' in front of it. Consecutive quoted lines of one level form a passage. Passages
are normalised, hashed and joined to the earlier messages of the conversation whose own lines hold the same run of lines; a
passage that none holds whole is taken line by line. The shallowest level with a link decides: the message that says
most of its quoted lines is the one answered, since deeper levels are what that message quoted itself. Answers form
chains, resolved by pointer doubling; a message's path from the first message of its chain on puts the
conversation into reply order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut

MARK = "^((\\s*>)+)\\s?"


def quotation_links(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", most_rounds: int = 40) -> DataFrame:
    """(conv, turn, role, reply_to, depth, path, n_quoted, n_linked, deepest_quote, body) for every row.

    reply_to is the turn whose own lines make up most of the lines quoted at the shallowest level that has a link (the later one of
    equals), null without a link; n_linked counts the quoted lines of all levels that an earlier turn says. path holds the turns from the chain's first message to this one, so that ordering by conv and path gives
    reply order. body is the text without quoted lines. A null text counts as empty; rows with a null conversation or turn are neither linked nor
    linked to. Rows that repeat a turn are one message to link to, and each gives a row. role is null where turns has none; other columns
    are not read. An empty table gives no rows.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    rows = turns.select(F.col(conv).alias("__c"), F.col(turn).cast("long").alias("__t"), (F.col("role") if "role" in turns.columns else F.lit(None).cast("string")).alias("role"), lines.alias("lines"))
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARK, 1), "[^>]", ""))
    bare = lambda x: F.lower(F.btrim(F.regexp_replace(F.regexp_replace(x, MARK, ""), "\\s+", " ")))
    marked = rows.withColumn("quoted", F.filter("lines", lambda x: x.rlike(MARK)))
    message = marked.select(
        "__c", "__t", "role", F.size("quoted").cast("long").alias("n_quoted"), F.coalesce(F.array_max(F.transform("quoted", level)), F.lit(0)).alias("deepest_quote"),
        F.btrim(F.array_join(F.filter("lines", lambda x: ~x.rlike(MARK)), "\n"), F.lit(" \t\r\n")).alias("body"),
    )
    sound = "__c is not null and __t is not null"
    key = ["c", "k", "h", "n"]
    hashed = lambda x: [F.size(x).alias("k"), F.xxhash64(F.array_join(x, "\n")).alias("h"), F.length(F.array_join(x, "\n")).alias("n")]
    # passages: runs of one level; a quoted line without words does not end one
    each = marked.where(sound).where(F.size("quoted") > 0).select(F.col("__c").alias("c"), F.col("__t").alias("t"), "lines", F.monotonically_increasing_id().alias("r"))
    each = each.select("c", "t", "r", F.posexplode("lines").alias("i", "x"))
    each = each.select("c", "t", "r", "i", level(F.col("x")).alias("lvl"), bare(F.col("x")).alias("x")).where("lvl = 0 or x <> ''")
    by_line = Window.partitionBy("r").orderBy("i")
    runs = each.withColumn("new", F.coalesce((F.col("lvl") != F.lag("lvl").over(by_line)).cast("int"), F.lit(0))).withColumn("run", F.sum("new").over(by_line)).where("lvl > 0")
    passages = cut(runs.groupBy("r", "run", "c", "t", "lvl").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p")).select("c", "t", "lvl", F.col("p.x").alias("p")))
    # what messages of those conversations say, as runs of the lengths that are quoted there
    lengths = passages.select("c", F.explode(F.array_distinct(F.array(F.lit(1), F.size("p")))).alias("m")).distinct()
    own = F.filter(F.transform(F.filter("lines", lambda x: ~x.rlike(MARK)), bare), lambda x: x != "")
    texts = cut(marked.where(sound).join(passages.select(F.col("c").alias("__c")).distinct(), "__c", "left_semi").select(F.col("__c").alias("c"), F.col("__t").alias("source"), own.alias("own")))
    windows = texts.join(lengths, "c").where("size(own) >= m").select("c", "source", F.explode(F.transform(F.sequence(F.lit(1), F.size("own") - F.col("m") + 1), lambda i: F.struct(*hashed(F.slice("own", i, F.col("m")))))).alias("w"))
    asked = passages.select("c", "t", "lvl", "p", *hashed(F.col("p")))
    lines1 = passages.select("c", F.explode("p").alias("x")).select("c", *hashed(F.array("x")))
    said = cut(windows.select("c", "w.*", "source").join(asked.select(*key).union(lines1).distinct(), key, "left_semi").distinct())
    first = said.groupBy(*key).agg(F.min("source").alias("first"), F.count("*").alias("said"))
    tried = cut(asked.join(first, key, "left").withColumn("whole", F.coalesce(F.col("first") < F.col("t"), F.lit(False))))
    parts = tried.where("not whole and k > 1").select("c", "t", "lvl", F.explode("p").alias("x")).select("c", "t", "lvl", *hashed(F.array("x"))).join(first, key).where("first < t")
    units = cut(tried.where("whole").select("c", "t", "lvl", *key[1:], "said").unionByName(parts.drop("first")).groupBy("c", "t", "lvl", *key[1:], "said").agg(F.sum("k").alias("w")))
    tops = units.groupBy("c", "t").agg(F.min("lvl").alias("lvl"), F.sum("w").alias("n_linked"))
    # a message that says only the commonest of the passages loses to the latest one that does, so that passage
    # alone needs no join with all who say it
    rank = F.row_number().over(Window.partitionBy("c", "t").orderBy(F.desc("said"), "k", "h", "n"))
    chosen = cut(units.join(tops.drop("n_linked"), ["c", "t", "lvl"]).withColumn("rank", rank))
    common = chosen.where("rank = 1").select("t", *key, F.col("w").alias("w1"))
    rest = chosen.where("rank > 1").join(said, key).where("source < t").groupBy("c", "t", "source").agg(F.sum("w").alias("w"))
    before = Window.partitionBy(*key).orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, -1)
    turns_of = common.select(*key, "t", F.lit(0).alias("asks"), F.lit(None).cast("long").alias("source")).unionByName(said.select(*key, F.col("source").alias("t"), F.lit(1).alias("asks"), "source"))
    latest = turns_of.withColumn("source", F.when(F.col("asks") == 0, F.max("source").over(before))).where("asks = 0 and source is not null").select("c", "t", "source", F.lit(0).cast("long").alias("w"))
    scored = rest.unionByName(latest).groupBy("c", "t", "source").agg(F.sum("w").alias("w")).join(common, ["c", "t"]).join(said.withColumn("says", F.lit(True)), [*key, "source"], "left")
    best = scored.groupBy("c", "t").agg(F.max(F.struct((F.col("w") + F.when(F.col("says"), F.col("w1")).otherwise(0)).alias("w"), "source")).alias("best"))
    links = cut(best.join(tops, ["c", "t"]).select("c", "t", F.col("best.source").alias("reply_to"), "n_linked"))
    # pointer doubling: seg holds the turns between the pointer (not included) and the message
    now = cut(links.select("c", "t", F.col("reply_to").alias("up"), F.array("t").alias("seg")))
    for doubling in range(most_rounds + 1):
        above = now.select(F.col("c").alias("ac"), F.col("t").alias("at"), F.col("up").alias("aup"), F.col("seg").alias("aseg"))
        step = now.join(above, (now["c"] == above["ac"]) & (now["up"] == above["at"]), "left")
        if not step.where("ac is not null").limit(1).count():
            break
        if doubling == most_rounds:
            raise RuntimeError("chains of answers did not settle")
        now = cut(step.select("c", "t", F.when(F.col("ac").isNull(), F.col("up")).otherwise(F.col("aup")).alias("up"), F.when(F.col("ac").isNull(), F.col("seg")).otherwise(F.concat("aseg", "seg")).alias("seg")))
    chains = now.select(F.col("c").alias("pc"), F.col("t").alias("pt"), F.concat(F.array("up"), "seg").alias("path"))
    out = message.join(links, (message["__c"] == links["c"]) & (message["__t"] == links["t"]), "left").join(chains, (F.col("__c") == F.col("pc")) & (F.col("__t") == F.col("pt")), "left")
    path = F.coalesce("path", F.array("__t"))
    return out.select(F.col("__c").alias(conv), F.col("__t").alias(turn), "role", "reply_to", (F.size(path) - 1).cast("int").alias("depth"), path.alias("path"), "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "deepest_quote", "body")


def reply_ordered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv, root, path, turn, role, body): the conversations without quotes, each thread from its first message on, every answer after what it answers.

    The rows are sorted over the whole table by ranges, so a very long conversation is spread over tasks too. Nulls and repeats as in quotation_links().
    """
    linked = quotation_links(turns, conv, turn, text)
    return linked.select(conv, F.get("path", 0).alias("root"), "path", turn, "role", "body").orderBy(conv, "path", "body")
