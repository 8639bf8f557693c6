"""Chat formatting over typed content parts.

The text of a turn is either plain, which is one text part, or a JSON list of parts, objects with a
``type``: text (text), image (url, width, height), audio (url, seconds), document (url, pages). A
visitor turns each part into text: text parts stand as they are, the others leave a placeholder
``<|image:turn.part|>`` and an attachment with its reference and the tokens that it will expand to:
an image 85 and 170 for each tile of 512 pixels, audio 25 a second, a document 500 a page, where an
unknown extent counts as one tile, second or page. Parts of any other type leave a placeholder of
kind ``other`` without tokens. Text tokens are runs of letters and digits, and single other signs.

A conversation is its turns in order, each ``<|role|>``, a line feed, the parts and ``<|end|>`` with
a line feed. A list that isn't valid JSON is plain text, a null text is empty, a null role is
``unknown``. Turns with equal numbers (null first) go by role, then text, and repeated rows repeat;
rows with a null conv_id make one conversation with a null id. All of it is Spark SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE, TILE_TOKENS, IMAGE_TOKENS, AUDIO_TOKENS, PAGE_TOKENS = 512, 170, 85, 25, 500
PART = "array<struct<type:string,text:string,url:string,width:double,height:double,seconds:double,pages:double>>"
WORD = r"[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}\s]"


def text_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _extent(x: Column) -> Column:
    """Null, NaN and nothing positive count as one."""
    return F.when(F.coalesce((x > 0) & ~F.isnan(x), F.lit(False)), F.least(x, F.lit(1e9))).otherwise(F.lit(1.0))


#: kind -> tokens that a part expands to
VISITORS = {
    "image": lambda p: IMAGE_TOKENS + TILE_TOKENS * F.ceil(_extent(p["width"]) / TILE) * F.ceil(_extent(p["height"]) / TILE),
    "audio": lambda p: F.ceil(AUDIO_TOKENS * _extent(p["seconds"])),
    "document": lambda p: F.ceil(PAGE_TOKENS * _extent(p["pages"])),
}


def _visit(turn: Column, part: Column, number: Column) -> Column:
    """struct(shown, kind, ref, url, tokens); kind is null for text."""
    kind = F.when(part["type"].isin(*VISITORS), part["type"]).when(F.coalesce(part["type"] == "text", F.lit(False)), F.lit(None)).otherwise("other")
    ref = F.concat_ws(".", F.coalesce(turn.cast("string"), F.lit("-")), number.cast("string"))
    tokens = F.when(kind.isNull(), F.coalesce(text_tokens(part["text"]), F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    for name, count in VISITORS.items():
        tokens = F.when(kind == name, count(part).cast("long")).otherwise(tokens)
    shown = F.when(kind.isNull(), F.coalesce(part["text"], F.lit(""))).otherwise(F.concat(F.lit("<|"), kind, F.lit(":"), ref, F.lit("|>")))
    return F.struct(shown.alias("shown"), kind.alias("kind"), ref.alias("ref"), part["url"].alias("url"), tokens.alias("tokens"))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, shown, attachments, tokens, parts: each row flattened."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    listed = F.when(F.ltrim("text").startswith("["), F.from_json("text", PART, {"mode": "PERMISSIVE"}))
    single = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("url", "string"), ("width", "double"), ("height", "double"), ("seconds", "double"), ("pages", "double")))))
    valid = listed.isNotNull() & (F.size(F.filter(listed, lambda p: p.isNotNull() & p["type"].isNotNull())) == F.size(listed)) & (F.size(listed) > 0)
    parts = F.when(F.coalesce(valid, F.lit(False)), listed).otherwise(single)
    visited = rows.select("conv_id", "turn", "role", parts.alias("p")).withColumn("v", F.transform("p", lambda p, i: _visit(F.col("turn"), p, i)))
    return visited.select(
        "conv_id", "turn", "role", F.array_join(F.transform("v", lambda x: x["shown"]), "").alias("shown"),
        F.transform(F.filter("v", lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["ref"].alias("ref"), x["url"].alias("url"), x["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x["tokens"]).alias("tokens"), F.size("v").cast("long").alias("parts"),
    )


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, prompt, n_turns, n_parts, n_tokens, attachments (kind ref url tokens, a line each)."""
    whole = turns(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "shown", "attachments", "tokens", "parts"))).alias("t"))
    shown = F.transform("t", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["shown"], F.lit("<|end|>\n")))
    attached = F.transform(F.flatten(F.transform("t", lambda x: x["attachments"])), lambda a: F.concat_ws(" ", a["kind"], a["ref"], F.coalesce(a["url"], F.lit("-")), a["tokens"].cast("string")))
    total = lambda c: F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x[c])
    return whole.select("conv_id", F.array_join(shown, "").alias("prompt"), F.size("t").cast("long").alias("n_turns"), total("parts").alias("n_parts"), total("tokens").alias("n_tokens"), F.array_join(attached, "\n").alias("attachments"))


#: For tables without JSON lists of parts; those are tested against a Python version.
ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations)
SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS prompt,
  count(*) AS n_turns, count(*) AS n_parts,
  CAST(sum(len(regexp_extract_all(text, '[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}\s]'))) AS BIGINT) AS n_tokens, '' AS attachments
FROM t GROUP BY conv_id
"""
