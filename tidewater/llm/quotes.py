"""Quotation linking: quoted passages to the messages that first wrote them.

Native DataFrame functions only. A message's lines fall into nested quote levels by their
'>' marks. Consecutive lines of one level form a passage, which is cut into sentences, so
that re-wrapped quotes still match; normalised sentences are hashed and joined to the
first message of the conversation that wrote them itself. Level-1 quotes give the message
replied to, and jumping along replies gives threads in reply order, without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import saved

# No pattern repeats a group, and none but the first can start inside a run: Java's engine
# then neither recurses nor goes over a run again, however long it is.
QUOTE = r"^[ \t]*>"
MARKS = r"^[ \t>]*>[ \t]?"
#: Line ends of attribution lines, in the corpus's languages; fixed values.
ATTRIBUTION = r"(wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"
#: They part passages, and a passage's level from its text; in quoted text they count as blanks.
PART, AFTER = "\x00", "\x01"


def _level(line: Column) -> Column:
    """Number of '>' among the blanks and marks that a line starts with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, r"^[ \t>]*", 0), "[^>]", ""))


def _records(text: Column) -> Column:
    """``line, level, intro`` of each line: its quote level, and whether it announces the quote below it.

    Neighbours stand side by side by zipping, so no line looks the whole array up.
    """
    lines = F.split(F.regexp_replace(text, "\r\n", "\n"), "\n")
    below = F.concat(F.slice(lines, 2, F.size(lines)), F.array(F.lit(None).cast("string")))
    return F.zip_with(lines, below, lambda x, y: F.struct(x.alias("line"), _level(x).alias("level"), (x.rlike(ATTRIBUTION) & F.coalesce(y.rlike(QUOTE), F.lit(False))).alias("intro")))


def _own(records: Column, sep: str) -> Column:
    """Lines that are neither quoted nor announce the quote below them."""
    return F.array_join(F.transform(F.filter(records, lambda r: (r["level"] == 0) & ~r["intro"]), lambda r: r["line"]), sep)


def _passages(records: Column) -> Column:
    """``level, passage``: all own lines as one, and each run of lines of one quote level. A line stands in one passage, however deep it is."""
    above = F.concat(F.array(F.lit(0)), F.transform(F.slice(records, 1, F.size(records) - 1), lambda r: r["level"]))

    def marked(r: Column, level: Column) -> Column:
        body = F.translate(F.regexp_replace(r["line"], MARKS, ""), PART + AFTER, "  ")
        return F.when(r["level"] == 0, F.lit("")).when(r["level"] == level, F.concat(F.lit(" "), body)).otherwise(F.concat(F.lit(PART), r["level"].cast("string"), F.lit(AFTER), body))

    runs = F.filter(F.split(F.array_join(F.zip_with(records, above, marked), ""), PART), lambda p: p != "")
    quoted = F.transform(runs, lambda p: F.struct(F.substring_index(p, AFTER, 1).cast("int").alias("level"), F.substring_index(p, AFTER, -1).alias("passage")))
    return F.concat(F.array(F.struct(F.lit(0).alias("level"), _own(records, " ").alias("passage"))), quoted)


def link_quotes(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Reply links and texts without quotes, one row per message.

    Returns ``conv_id, turn, role, n_quoted, n_linked, max_level, parent_turn, root_turn,
    depth, clean_text``. `n_quoted` counts distinct quoted sentences with their level,
    `n_linked` those whose source is known: the earliest message of the conversation that
    wrote the sentence itself, if earlier than the quoting one. `parent_turn` is the source of
    most sentences of the lowest linked level, the latest of equals. Sorting by (conv_id,
    root_turn, depth, turn) gives reply order; messages without parent are roots (depth 0).

    Null text counts as empty but stays null in `clean_text`; texts without quotes stay
    unchanged, quotes of any depth and lines of any length are handled in time that
    follows the text's length. Messages with a null conversation or turn link with nothing. Rows with one
    (conversation, turn) share their links, and their quotes count together. An empty
    table gives no rows; further columns are ignored.
    """
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    quoting = F.coalesce(F.col("text").rlike("(^|\n)[ \t]*>"), F.lit(False))
    threads = rows.where(quoting & F.col("conv_id").isNotNull()).select("conv_id").distinct()
    # only conversations with quotes are taken apart; attribution lines are no one's words
    parts = rows.where(F.col("turn").isNotNull()).join(threads, "conv_id", "left_semi")
    passages = parts.select("conv_id", "turn", F.explode(_passages(_records(F.coalesce("text", F.lit(""))))).alias("p")).select("conv_id", "turn", "p.level", "p.passage")
    sentences = F.split(F.regexp_replace("passage", r"([.!?])[ \t]+", "$1\n"), "\n")
    unit = F.trim(F.regexp_replace(F.lower(F.col("unit")), r"[ \t]+", " "))
    units = passages.select("conv_id", "turn", "level", F.explode(sentences).alias("unit")).select("conv_id", "turn", "level", unit.alias("unit")).where("unit <> ''")
    units = units.select("conv_id", "turn", "level", F.md5("unit").alias("hash")).distinct()
    written = units.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    quoted = units.where("level > 0").join(written, ["conv_id", "hash"], "left")
    quoted = quoted.withColumn("source", F.when(F.col("source") < F.col("turn"), F.col("source")))
    counts = quoted.groupBy("conv_id", "turn", "level", "source").agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.when(F.col("source").isNotNull(), F.struct(-F.col("level"), "n", "source")))
    links = counts.groupBy("conv_id", "turn").agg(F.sum("n").alias("n_quoted"), F.sum(F.when(F.col("source").isNotNull(), F.col("n"))).alias("n_linked"), F.max("level").alias("max_level"), best["source"].alias("parent_turn"))
    links = saved(links)
    state = links.where("parent_turn IS NOT NULL").select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).alias("depth"))
    while True:  # each round doubles how far along its replies a message has jumped
        ahead = state.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next"), F.col("depth").alias("more"))
        step = saved(state.join(ahead, ["conv_id", "root_turn"], "left").select("conv_id", "turn", F.coalesce("next", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")))
        state = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    joined = rows.join(links, ["conv_id", "turn"], "left").join(state, ["conv_id", "turn"], "left")
    clean = F.btrim(_own(_records(F.col("text")), "\n"), F.lit(" \t\n\f\r"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "conv_id", "turn", "role", zero("n_quoted").cast("long").alias("n_quoted"), zero("n_linked").cast("long").alias("n_linked"), zero("max_level").cast("int").alias("max_level"),
        "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), zero("depth").cast("int").alias("depth"), F.when(quoting, clean).otherwise(F.col("text")).alias("clean_text"),
    )


def op7_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP7_SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, text, regexp_split_to_array(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), '\n') AS ls FROM conversations),
l AS (SELECT rid, conv_id, turn, i, x, nx, len(regexp_replace(regexp_extract(x, '^(?:[ \t]*>)+[ \t]?'), '[^>]', '', 'g')) AS level FROM (SELECT rid, conv_id, turn, i, ls[i] AS x, ls[i + 1] AS nx FROM (SELECT rid, conv_id, turn, ls, unnest(range(1, len(ls) + 1)) AS i FROM m))),
o AS (SELECT *, level > 0 OR (regexp_matches(x, '(wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$') AND coalesce(regexp_matches(nx, '^[ \t]*>'), false)) AS dropped FROM l),
c AS (SELECT rid, bool_or(level > 0) AS quoting, regexp_replace(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT dropped), ''), '^\s+|\s+$', '', 'g') AS clean FROM o GROUP BY rid),
k AS (SELECT rid, conv_id, turn, max(level) AS top FROM o GROUP BY ALL),
e AS (SELECT o.conv_id, o.turn, o.rid, o.i, v.level, CASE WHEN o.level = v.level THEN regexp_replace(x, '^(?:[ \t]*>)+[ \t]?', '') END AS x, CASE WHEN v.level = 0 THEN o.dropped ELSE false END AS skip
      FROM o JOIN (SELECT rid, unnest(range(0, top + 1)) AS level FROM k) v USING (rid)),
p AS (SELECT conv_id, turn, level, string_agg(coalesce(x, chr(1)), ' ' ORDER BY i) AS s FROM e WHERE NOT skip GROUP BY rid, conv_id, turn, level),
u AS (SELECT DISTINCT conv_id, turn, level, unit FROM (SELECT conv_id, turn, level, trim(regexp_replace(lower(unnest(string_split(regexp_replace(g, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)))), '[ \t]+', ' ', 'g')) AS unit
      FROM (SELECT conv_id, turn, level, unnest(string_split(s, chr(1))) AS g FROM p)) WHERE unit <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
w AS (SELECT conv_id, unit, min(turn) AS source FROM u WHERE level = 0 GROUP BY ALL),
q AS (SELECT u.conv_id, u.turn, u.level, CASE WHEN w.source < u.turn THEN w.source END AS source FROM u LEFT JOIN w USING (conv_id, unit) WHERE level > 0),
n AS (SELECT conv_id, turn, level, source, count(*) AS n FROM q GROUP BY ALL),
a AS (SELECT conv_id, turn, sum(n)::BIGINT AS n_quoted, coalesce(sum(n) FILTER (source IS NOT NULL), 0)::BIGINT AS n_linked, max(level)::INT AS max_level FROM n GROUP BY ALL),
b AS (SELECT conv_id, turn, source AS parent_turn FROM n WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, source DESC) = 1),
r AS (SELECT conv_id, turn, parent_turn AS anc, 1 AS depth FROM b UNION ALL SELECT r.conv_id, r.turn, b.parent_turn, r.depth + 1 FROM r JOIN b ON b.conv_id = r.conv_id AND b.turn = r.anc),
d AS (SELECT conv_id, turn, min(anc) AS root_turn, max(depth) AS depth FROM r GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, coalesce(a.n_quoted, 0) AS n_quoted, coalesce(a.n_linked, 0) AS n_linked, coalesce(a.max_level, 0) AS max_level, b.parent_turn, coalesce(d.root_turn, m.turn) AS root_turn, coalesce(d.depth, 0)::INT AS depth,
  CASE WHEN c.quoting AND m.text IS NOT NULL THEN c.clean ELSE m.text END AS clean_text
FROM m JOIN c USING (rid) LEFT JOIN a ON a.conv_id = m.conv_id AND a.turn = m.turn LEFT JOIN b ON b.conv_id = m.conv_id AND b.turn = m.turn LEFT JOIN d ON d.conv_id = m.conv_id AND d.turn = m.turn
"""
