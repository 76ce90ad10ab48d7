"""Chat formatting with Spark expressions only.

Each block of adjacent turns of one role becomes ``### role:\\n`` + texts + ``</turn>\\n``; texts of
merged turns are parted by ``<+>``. Inside texts ``\\``, ``#`` and ``<`` are written ``\\\\``, ``\\h``
and ``\\l``, in roles also ``:`` and line ends, so a raw ``#`` or ``<`` is always the template's and
everything can be read back.

Where the texts lie is summed up by array aggregation in chunks of CHUNK turns, then over the chunks, so long
conversations take time in proportion to their turns, not to the square.

Defined results: a null text or role counts as empty; ties in ``turn`` (nulls first) are ordered by
role and text; repeated rows are turns of their own; a null conv_id is a conversation; very long texts and
conversations are formatted whole; an empty table gives no conversation. Other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.session import table

TAIL, JOIN = "</turn>\n", "<+>"
LOSS_ROLE = "assistant"
CHUNK = 256


def _swap(value: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def escape(text: Column) -> Column:
    return _swap(text, ("\\", "\\\\"), ("#", "\\h"), ("<", "\\l"))


def escape_role(role: Column) -> Column:
    return _swap(escape(role), (":", "\\c"), ("\n", "\\n"))


def unescape(text: Column) -> Column:
    parts = F.split(text, r"\\\\")  # pairs of backslashes, from the left: what stays between holds only other escapes
    return F.array_join(F.transform(parts, lambda p: _swap(p, ("\\h", "#"), ("\\l", "<"), ("\\c", ":"), ("\\n", "\n"))), "\\")


def format_chats(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, formatted, loss_spans (ranges of the loss role's texts in code points, [start, end), and in
    bytes, [first, stop))."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def pieces(t: Column, i: Column) -> Column:
        """The constant strings around a turn's text, by its neighbours' roles: equal roles merge."""
        first = (i == 0) | (F.get("ts", i - 1)["role"] != t["role"])
        last = (i == F.size("ts") - 1) | (F.get("ts", i + 1)["role"] != t["role"])
        head = F.when(first, F.concat(F.lit("### "), escape_role(t["role"]), F.lit(":\n"))).otherwise("")
        return F.struct(head.alias("head"), escape(t["text"]).alias("body"), F.when(last, TAIL).otherwise(JOIN).alias("tail"), (t["role"] == loss_role).alias("loss"))

    built = sorted_turns.select("conv_id", F.transform("ts", pieces).alias("ps"))
    text = F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    none = F.expr("cast(array() as array<struct<start:int,end:int,first:int,stop:int>>)")
    no_places = F.expr("cast(array() as array<struct<at:int,byte:int>>)")

    def advance(acc: Column, p: Column) -> Column:
        start, first = acc["at"] + F.length(p["head"]), acc["byte"] + F.octet_length(p["head"])
        end, stop = start + F.length(p["body"]), first + F.octet_length(p["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end"), first.alias("first"), stop.alias("stop")))
        spans = F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((end + F.length(p["tail"])).alias("at"), (stop + F.octet_length(p["tail"])).alias("byte"), spans.alias("spans"))

    def after(acc: Column, w: Column) -> Column:
        places = F.concat(acc["places"], F.array(F.struct(acc["at"].alias("at"), acc["byte"].alias("byte"))))
        return F.struct((acc["at"] + w["at"]).alias("at"), (acc["byte"] + w["byte"]).alias("byte"), places.alias("places"))

    def moved(w: Column, place: Column) -> Column:
        return F.transform(w["spans"], lambda s: F.struct(*((s[c] + place[by]).alias(c) for c, by in (("start", "at"), ("end", "at"), ("first", "byte"), ("stop", "byte")))))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte"), none.alias("spans"))
    chunks = F.transform(F.sequence(F.lit(1), F.size("ps"), F.lit(CHUNK)), lambda i: F.aggregate(F.slice("ps", i, CHUNK), start, advance))
    walked = built.select("conv_id", text.alias("formatted"), chunks.alias("ws"))
    places = F.aggregate("ws", F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte"), no_places.alias("places")), after)["places"]
    return walked.select("conv_id", "formatted", "ws", places.alias("places")).select("conv_id", "formatted", F.flatten(F.zip_with("ws", "places", moved)).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) in a formatted conversation."""
    blocks = F.filter(F.split(formatted, TAIL), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.regexp_extract(block, "^### ([^:\n]*):\n", 1)
        texts = F.split(F.substr(block, F.length(role) + 7), r"<\+>")
        return F.transform(texts, lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the formatted text and its loss mask."""
    raw = F.col("formatted").cast("binary")
    spans = F.transform("loss_spans", lambda s: unescape(F.substr("raw", s["first"] + 1, s["stop"] - s["first"]).cast("string")))
    back = formatted.withColumn("raw", raw).select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), F.array_join(spans, "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


HARD = r"\### Assistant: </turn> ok"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text")
    )
    return digests(format_chats(turns.unionByName(extra)))


ORACLE_SQL = {
    "op7_chat_formatting": rf"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{HARD}' UNION ALL SELECT -7, 1, 'assistant', '{HARD}'),
ordered AS (SELECT *, lag(r) OVER w = r AS merged,
  length(replace(replace(replace(t, '\', '\\'), '#', '\h'), '<', '\l')) tl,
  length(replace(replace(replace(replace(replace(r, '\', '\\'), '#', '\h'), '<', '\l'), ':', '\c'), chr(10), '\n')) rl
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(tl + CASE WHEN merged THEN 3 ELSE rl + 14 END)::BIGINT AS formatted_chars
FROM ordered GROUP BY conv_id"""
}
QUERIES = {"op7_chat_formatting": op7_chat_formatting}
