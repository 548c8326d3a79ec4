"""Operator 6 (native): conversations in reply order, by linking quotations to what they quote.

Lines that begin with '>' are quotations, each further '>' one level deeper. The sentences of
a message's quotations and of its own text are normalised (lower case, letters and digits,
single spaces) and hashed; a quotation's hash joins to the messages of the same conversation
that hold that sentence as their own, earlier. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, shared_dir, stored, table

_MARK = r"^[ \t]*(?:>[ \t]?)+"
_SAYS = r"(?i)^.*\b(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"


def parsed(text: Column) -> Column:
    """Array of (level, body), one for each line; level 0 is the writer's own. None for null."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")

    def line(x: Column) -> Column:
        mark = F.regexp_extract(x, _MARK, 0)
        return F.struct(F.length(F.regexp_replace(mark, "[^>]", "")).alias("level"), F.regexp_replace(x, _MARK, "").alias("body"))

    return F.transform(lines, line)


def sentences(text: Column) -> Column:
    """Distinct normalised sentences: text across line ends, cut after . ! or ?"""
    parts = F.split(F.regexp_replace(text, r"\s+", " "), r"(?<=[.!?])\s+")
    clean = F.transform(parts, lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " ")))
    return F.array_distinct(F.filter(clean, lambda s: F.length(s) > 0))


def _own(lines: Column) -> Column:
    """The writer's own lines, without those that only announce a quotation ("... wrote:", a quoted line next, blank ones aside)."""
    says = lambda x: (x["level"] == 0) & x["body"].rlike(_SAYS)
    placed = F.transform(lines, lambda x, i: F.struct(x["level"].alias("level"), says(x).alias("says"), ((x["level"] > 0) | x["body"].rlike(r"\S")).alias("solid"), i.alias("at")))

    def gone(solid: Column) -> Column:
        """Numbers of the announcing lines: each solid line beside the next."""
        both = F.zip_with(solid, F.slice(solid, 2, F.greatest(F.size(solid) - 1, F.lit(0))), lambda x, y: F.when(x["says"] & (y["level"] > 0), x["at"]))
        return F.array_compact(both)

    def kept(given: Column) -> Column:
        # the stretches between announcements, each cut out once
        cuts = let(F.filter(placed, lambda x: x["solid"]), gone)
        ends = F.arrays_zip(F.concat(F.array(F.lit(-1)), cuts).alias("a"), F.concat(cuts, F.array(F.size(given))).alias("b"))
        parts = F.transform(ends, lambda e: F.slice(given, e["a"] + 2, F.greatest(e["b"] - e["a"] - 1, F.lit(0))))
        return F.filter(F.flatten(parts), lambda x: x["level"] == 0)

    own = let(lines, kept)
    return F.regexp_replace(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), r"^\s+|\s+$", "")


def _quoted(lines: Column) -> Column:
    """Array of (level, s): the distinct sentences of each level's quoted lines."""
    placed = F.transform(lines, lambda x, i: F.struct(x["level"].alias("level"), i.alias("at"), x["body"].alias("body")))
    by_level = F.array_sort(F.filter(placed, lambda x: x["level"] > 0))

    def levels(q: Column) -> Column:
        starts = F.filter(F.transform(q, lambda x, i: F.when((i == 0) | (F.get(q, i - 1)["level"] != x["level"]), i)), lambda i: i.isNotNull())
        return let(starts, lambda at: F.zip_with(at, F.concat(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.filter(F.array(F.size(q)), lambda n: n > 0)), lambda a, b: said(F.get(q, a)["level"], F.slice(q, a + 1, b - a))))

    def said(level: Column, part: Column) -> Column:
        text = F.array_join(F.transform(part, lambda x: x["body"]), "\n")
        return let(level, lambda n: F.transform(sentences(text), lambda s: F.struct(n.alias("level"), s.alias("s"))))

    return F.flatten(let(by_level, levels))


def link_quotes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role") -> DataFrame:
    """One row per message: conv_id, turn, role, own_text, n_quoted, n_linked, parent, root, depth, reply_path.

    n_quoted counts a message's distinct quoted sentences of all levels, n_linked those found
    as an earlier message's own. parent is the turn of the message that the most of those of the
    shallowest level with a link come from (ties: the latest); a sentence comes from the first message of the conversation that says it. Without
    a link parent is null and the message is its own root. Sorting a conversation by reply_path
    gives each message after the one it answers. Null texts are empty; null ids link to nothing;
    rows that repeat a turn are linked alike; work is linear in a message's lines and
    levels, up to sorting. Other columns, whatever their names, are not read.
    """
    shared_dir(turns.sparkSession)
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), parsed(F.col(text)).alias("lines"))
    made = stored(rows.select("conv_id", "turn", "role", _own(F.col("lines")).alias("own_text"), _quoted(F.col("lines")).alias("quoted")), "turns")
    asked = made.where(F.size("quoted") > 0).select("conv_id", "turn", F.explode("quoted").alias("q")).groupBy("conv_id", "turn", F.xxhash64("q.s").alias("h"), F.col("q.s").alias("s")).agg(F.min("q.level").alias("level"))
    said = made.select("conv_id", "turn", F.explode(sentences(F.col("own_text"))).alias("s")).groupBy("conv_id", F.xxhash64("s").alias("h"), "s").agg(F.min("turn").alias("by"))
    found = asked.join(said, ["conv_id", "h", "s"]).where("by < turn")
    votes = found.groupBy("conv_id", "turn", "level", "by").agg(F.count("*").alias("n"))
    parent = votes.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("near"), "n", "by"))["by"].alias("parent"), F.sum("n").alias("n_linked"))
    # climb: each round doubles the part of the way to the root that is known
    up = stored(parent.select("conv_id", "turn", "parent", F.col("parent").alias("top"), F.lit(1).cast("long").alias("depth"), F.array("parent", "turn").alias("reply_path")), "replies")
    while True:
        above = up.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"), F.slice("reply_path", 1, F.size("reply_path") - 1).alias("before"))
        if not up.join(above, ["conv_id", "top"], "left_semi").limit(1).count():
            break
        step = up.join(above, ["conv_id", "top"], "left")
        up = stored(step.select("conv_id", "turn", "parent", F.coalesce("next", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.when(F.col("next").isNull(), F.col("reply_path")).otherwise(F.concat("before", "reply_path")).alias("reply_path")), "replies")
    linked = up.join(parent.select("conv_id", "turn", "n_linked"), ["conv_id", "turn"])
    out = made.join(linked, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "own_text", F.size(F.array_distinct(F.transform("quoted", lambda q: q["s"]))).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "parent", F.coalesce("top", "turn").alias("root"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("reply_path", F.array("turn")).alias("reply_path"),
    )


def _digest(linked: DataFrame) -> DataFrame:
    """reply_path as text, its turns divided by '/'."""
    return linked.withColumn("reply_path", F.array_join(F.col("reply_path").cast("array<string>"), "/", "?"))


def op6_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(link_quotes(table(spark, sf_dir, "conversations")))


def quoting_replies(turns: DataFrame) -> DataFrame:
    """Every conversation as mail would have it: each message quotes the one before it, and the one before that a level
    deeper, below a line that announces them; every fifth message quotes the second last only, at level 2."""
    order = Window.partitionBy("conv_id").orderBy("turn", "text", "role")
    placed = turns.withColumn("k", F.row_number().over(order)).withColumn("one", F.lag("text").over(order)).withColumn("two", F.lag("text", 2).over(order))
    level = lambda c, mark: F.concat(F.lit(mark), F.regexp_replace(c, "\n", "\n" + mark))
    deep = F.concat(level(F.col("two"), ">> "), F.lit("\n"))
    near = F.concat(F.lit("Somebody wrote:\n"), level(F.col("one"), "> "), F.lit("\n"))
    head = F.when(F.col("k") % 5 == 0, F.coalesce(deep, F.lit(""))).otherwise(F.concat(F.coalesce(near, F.lit("")), F.coalesce(deep, F.lit(""))))
    return placed.select("conv_id", "turn", "role", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


def quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over `conversations` whose messages quote each other."""
    return _digest(link_quotes(quoting_replies(table(spark, sf_dir, "conversations"))))


_SENTENCES = r"list_distinct(list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(lower(s), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), lambda s: len(s) > 0))"

_QUOTES_SQL = rf"""
WITH RECURSIVE source AS ({{source}}),
r AS (SELECT conv_id, turn, role, row_number() OVER () AS rid, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM source),
p AS (SELECT rid, i, len(regexp_replace(regexp_extract(x, '^[ \t]*(?:>[ \t]?)+'), '[^>]', '', 'g')) AS level, regexp_replace(x, '^[ \t]*(?:>[ \t]?)+', '') AS body
      FROM (SELECT rid, unnest(range(len(ls))) AS i, unnest(ls) AS x FROM r)),
nx AS (SELECT rid, i, lead(level) OVER (PARTITION BY rid ORDER BY i) AS following FROM p WHERE level > 0 OR regexp_matches(body, '\S')),
t AS (SELECT rid, coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0 AND NOT (coalesce(following, 0) > 0 AND regexp_matches(body, '(?i)^.*\b(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$'))), '') AS own
      FROM p LEFT JOIN nx USING (rid, i) GROUP BY rid),
q AS (SELECT rid, level, unnest({_SENTENCES.format("string_agg(body, chr(10) ORDER BY i)")}) AS s FROM p WHERE level > 0 GROUP BY rid, level),
nq AS (SELECT rid, count(DISTINCT s) AS n_quoted FROM q GROUP BY rid),
o AS (SELECT r.rid, conv_id, turn, role, regexp_replace(own, '^\s+|\s+$', '', 'g') AS own_text FROM r JOIN t USING (rid)),
asked AS (SELECT conv_id, turn, s, min(level) AS level FROM q JOIN r USING (rid) GROUP BY ALL),
said AS (SELECT conv_id, s, min(turn) AS said_at FROM (SELECT conv_id, turn, unnest({_SENTENCES.format('own_text')}) AS s FROM o) GROUP BY ALL),
votes AS (SELECT a.conv_id, a.turn, level, said_at, count(*) AS n FROM asked a JOIN said USING (conv_id, s) WHERE said_at < a.turn GROUP BY ALL),
par AS (SELECT conv_id, turn, max_by(said_at, (-level, n, said_at)) AS parent, sum(n)::BIGINT AS n_linked FROM votes GROUP BY ALL),
tree AS (SELECT DISTINCT conv_id, turn, turn AS root, 0::BIGINT AS depth, coalesce(turn::VARCHAR, '?') AS reply_path FROM o ANTI JOIN par USING (conv_id, turn)
         UNION ALL SELECT c.conv_id, c.turn, tree.root, tree.depth + 1, tree.reply_path || '/' || c.turn FROM par c JOIN tree ON c.conv_id = tree.conv_id AND c.parent = tree.turn)
SELECT o.conv_id, o.turn, o.role, o.own_text, coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked, parent, root, depth, reply_path
FROM o LEFT JOIN nq USING (rid) JOIN tree ON o.conv_id IS NOT DISTINCT FROM tree.conv_id AND o.turn IS NOT DISTINCT FROM tree.turn LEFT JOIN par ON o.conv_id = par.conv_id AND o.turn = par.turn
"""

OP6_SQL = _QUOTES_SQL.replace("{source}", "SELECT conv_id, turn, role, text FROM conversations")

QUOTED_SQL = _QUOTES_SQL.replace("{source}", """
SELECT conv_id, turn, role, CASE WHEN k % 5 = 0 THEN '' ELSE coalesce('Somebody wrote:' || chr(10) || '> ' || replace(one, chr(10), chr(10) || '> ') || chr(10), '') END
       || coalesce('>> ' || replace(two, chr(10), chr(10) || '>> ') || chr(10), '') || coalesce(text, '') AS text
FROM (SELECT *, row_number() OVER w AS k, lag(text) OVER w AS one, lag(text, 2) OVER w AS two FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text, role))""")
