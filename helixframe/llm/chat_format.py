"""Chat formatting with a grammar round trip.

Grammar:  conversation := turn*        turn := "<s>[" header "] " text "</s>"
          header: INST for the role user, else the role;   header and text hold no control string.
Control strings inside a role or text are written as character references, reversibly. A turn is first
rendered as it is; if the parser does not give back exactly this turn, it is rendered with references. The
parser then reads the whole conversation again, and a conversation whose turns differ from the source
raises an error. The loss mask is a list of spans: turn, start in the turn's rendering, length (code
points); it covers the text of each assistant turn and no markup.

Everything is DataFrame expressions. A conversation's digest needs its turns in one row, which is the
contract's unit of output; a turn's rendering happens before that, row by row.

Defined cases: a null text or role counts as empty; a null conversation id is one conversation; turns sort
by turn, then role, then text, null turns first, and repeated rows are turns of their own; an empty table
gives no rows (the query adds conversation -1); a very long text is rendered and read back whole; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import table

OPEN, CLOSE, USER = "<s>", "</s>", "INST"
CONTROL = (OPEN, CLOSE, "[INST]", "[/INST]")
EXTRA_TEXT = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for control in CONTROL:
        text = F.replace(text, F.lit(control), F.lit(f"&#{ord(control[0])};{control[1:]}"))
    return text


def escape_header(role: Column) -> Column:
    for char, ref in (("&", "&amp;"), ("<", "&#60;"), ("[", "&#91;"), ("]", "&#93;"), ("I", "&#73;")):
        role = F.replace(role, F.lit(char), F.lit(ref))
    return role


def unescape(text: Column) -> Column:
    for ref, char in (("&#60;", "<"), ("&#91;", "["), ("&#93;", "]"), ("&#73;", "I"), ("&amp;", "&")):
        text = F.replace(text, F.lit(ref), F.lit(char))
    return text


def _render(header: Column, text: Column) -> Column:
    return F.concat(F.lit(f"{OPEN}["), header, F.lit("] "), text, F.lit(CLOSE))


def parse_piece(piece: Column) -> Column:
    """The turn in one piece of a conversation cut at the closing marks: head (length of the markup before the text), role, text."""
    header = F.substring_index(F.substring(piece, len(OPEN) + 2, 2**31 - 1), "] ", 1)
    head = F.lit(len(OPEN) + 3) + F.char_length(header)
    role = F.when(header == F.lit(USER), F.lit("user")).otherwise(unescape(header))
    return F.struct(head.alias("head"), role.alias("role"), unescape(F.substring(piece, head + 1, F.char_length(piece))).alias("text"))


def pieces(formatted: Column) -> Column:
    cut = F.split(formatted, CLOSE)
    return F.slice(cut, 1, F.size(cut) - 1)


def _reads_back(rendered: Column, role: Column, text: Column) -> Column:
    """Whether the parser gives back exactly this one turn and the text holds no control string."""
    inside = F.substring(rendered, len(OPEN) + 1, F.char_length(rendered) - len(OPEN) - len(CLOSE))
    free = ~F.contains(inside, F.lit(OPEN)) & ~F.contains(inside, F.lit(CLOSE)) & ~F.contains(text, F.lit("[INST]")) & ~F.contains(text, F.lit("[/INST]"))
    turn = parse_piece(F.substring(rendered, 1, F.char_length(rendered) - len(CLOSE)))
    return free & (turn["role"] == role) & (turn["text"] == text)


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans, source): one row per conversation; source holds the turns as they came."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    plain = _render(F.when(F.col("role") == "user", F.lit(USER)).otherwise(F.col("role")), F.col("text"))
    safe = _render(F.when(F.col("role") == "user", F.lit(USER)).otherwise(escape_header(F.col("role"))), escape(F.col("text")))
    drawn = turns.withColumn("plain", plain).withColumn("rendered", F.when(_reads_back(F.col("plain"), F.col("role"), F.col("text")), F.col("plain")).otherwise(safe))
    each = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "rendered"))).alias("turns")
    whole = drawn.groupBy("conv_id").agg(each).select("conv_id", "turns", F.array_join(F.col("turns.rendered"), "").alias("formatted"))
    found = whole.withColumn("parsed", F.transform(pieces(F.col("formatted")), parse_piece))
    same = (F.col("parsed.role") == F.col("turns.role")) & (F.col("parsed.text") == F.col("turns.text"))
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation was not read back as it came")).cast("string"))
    body = F.transform("parsed", lambda t, i: F.struct(i.alias("turn"), t["head"].alias("start"), (F.char_length(F.element_at(F.col("turns.rendered"), i + 1)) - t["head"] - len(CLOSE)).alias("length"), t["role"].alias("role")))
    spans = F.transform(F.filter(body, lambda s: s["role"] == "assistant"), lambda s: F.struct(s["turn"], s["start"], s["length"]))
    return found.select("conv_id", checked.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The contract's digests, from the formatted text and its loss spans alone."""
    cut = formatted.select("conv_id", "formatted", "loss_spans", pieces(F.col("formatted")).alias("pieces"))
    turn = F.transform("pieces", lambda p: F.concat(parse_piece(p)["role"], F.lit("\n"), parse_piece(p)["text"], F.lit("\n")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.element_at(F.col("pieces"), s["turn"] + 1), s["start"] + 1, s["length"])))
    texts = cut.select("conv_id", F.size("pieces").cast("long").alias("n_turns"), F.array_join(turn, "").alias("turns"), F.array_join(loss, "").alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return texts.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `conversations` table and conversation -1, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    first = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    return read_back(format_conversations(rows.unionByName(first)))


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, contains(text, '<s>') OR contains(text, '</s>') OR contains(text, '[INST]') OR contains(text, '[/INST]')
    OR contains(text, '&#60;') OR contains(text, '&#91;') OR contains(text, '&#93;') OR contains(text, '&#73;') OR contains(text, '&amp;') AS hard FROM t),
r AS (SELECT *, CASE WHEN hard THEN replace(replace(replace(replace(replace(text, '&', '&amp;'), '<s>', '&#60;s>'), '</s>', '&#60;/s>'), '[INST]', '&#91;INST]'), '[/INST]', '&#91;/INST]') ELSE text END AS body FROM e),
g AS (SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(body) + 10 + CASE WHEN role = 'user' THEN 4 ELSE length(role) END)::BIGINT AS formatted_chars FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
