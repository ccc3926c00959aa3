"""Chat formatting with typed content parts.

A message holds ordered parts: text, image, audio or document. A visitor turns each part into its piece of the formatted string: text is escaped, the
others become placeholders that stand for a number of tokens, and their sources are recorded as attachment references. Control strings inside
texts and roles are escaped reversibly, so the conversation can be read back from the string.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import text_of

PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
MESSAGE = "struct<turn:bigint,role:string,body:string,loss:boolean,chars:bigint,tokens:bigint,attachments:array<struct<turn:bigint,part:int,kind:string,uri:string,tokens:bigint>>>"
ESCAPE, MARK = "~", "~1"


@dataclass(frozen=True)
class Template:
    """Strings around turns; none may hold "~". `foreign` are control strings of other formats that texts must not smuggle in."""

    turn: str = "<|turn|>"
    body: str = "<|body|>"
    end: str = "<|end|>"
    placeholders: dict = field(default_factory=lambda: {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"})
    foreign: tuple = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    learned_roles: tuple = ("assistant",)
    patch: int = 28
    tokens_per_second: float = 25.0
    tokens_per_page: int = 512

    @property
    def controls(self) -> list[str]:
        return [self.turn, self.body, self.end, *self.placeholders.values(), *self.foreign]


def _quoted(literal: str) -> str:
    return "".join(f"\\x{ord(c):02x}" for c in literal)


def escaped(text: Column, t: Template) -> Column:
    """Every "~" becomes "~0", and "~1" is put after the first character of every control string."""
    ahead = "|".join(f"{_quoted(c[0])}(?={_quoted(c[1:])})" for c in t.controls)
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit("~0")), f"({ahead})", "$1" + MARK)


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(MARK), F.lit("")), F.lit("~0"), F.lit(ESCAPE))


def text_part(text: Column) -> Column:
    """A message of nothing but text, as parts."""
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *empty))


def visited(parts: Column, t: Template) -> Column:
    """array<struct<piece, kind, uri, tokens>>: each part flattened, in order. Unknown kinds are documents; missing sizes count as nothing."""
    def visit(p):
        is_text = p["kind"] == "text"
        tokens = (F.when(is_text, F.lit(0))
                  .when(p["kind"] == "image", F.ceil(F.coalesce(p["width"], F.lit(0)) / t.patch) * F.ceil(F.coalesce(p["height"], F.lit(0)) / t.patch))
                  .when(p["kind"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * t.tokens_per_second))
                  .otherwise(F.coalesce(p["pages"], F.lit(0)) * t.tokens_per_page)).cast("bigint")
        piece = (F.when(is_text, escaped(F.coalesce(p["text"], F.lit("")), t)).when(p["kind"] == "image", t.placeholders["image"])
                 .when(p["kind"] == "audio", t.placeholders["audio"]).otherwise(t.placeholders["document"]))
        return F.struct(piece.alias("piece"), p["kind"].alias("kind"), p["uri"].alias("uri"), tokens.alias("tokens"))
    return F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), visit)


def format_turns(messages: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, turn, role, body, loss, tokens, attachments) per message row; row by row, no shuffle.

    messages(conv_id, turn, role, text) or (conv_id, turn, role, parts); where both columns exist and `parts` is null, the text is the one part. Null roles and
    texts are empty. `body` is escaped and holds the placeholders; `tokens` are those the placeholders expand to.
    """
    text = text_part(text_of()) if "text" in messages.columns else F.array().cast(f"array<{PART}>")
    parts = F.coalesce(F.col("parts"), text) if "parts" in messages.columns else text
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    df = messages.select(F.col("conv_id").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), visited(parts, template).alias("v"))
    noted = F.filter(F.transform("v", lambda p, i: F.when(p["kind"] != "text", F.struct(
        F.col("turn").alias("turn"), i.alias("part"), p["kind"].alias("kind"), p["uri"].alias("uri"), p["tokens"].alias("tokens")))), lambda a: a.isNotNull())
    return df.select("conv_id", "turn", "role", F.array_join(F.transform("v", lambda p: p["piece"]), "").alias("body"), F.col("role").isin(*template.learned_roles).alias("loss"),
                     F.aggregate("v", F.lit(0).cast("bigint"), lambda acc, p: acc + p["tokens"]).alias("tokens"), noted.alias("attachments"))


def format_conversations(messages: DataFrame, template: Template = Template(), block: int = 64) -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, expanded_tokens, n_turns): one row per conversation, null ids included.

    Turns in order of `turn` (nulls first), ties by role and body; repeated rows are turns of their own. `loss_spans` are code-point ranges, end exclusive, of the
    bodies of learned roles. Rows of `block` turns are joined first, so the last step gathers blocks, not rows; a conversation is one string and has to fit a row.
    """
    t = template
    df = format_turns(messages, t)
    head = F.concat(F.lit(t.turn), escaped(F.col("role"), t), F.lit(t.body))
    one = F.struct("turn", "role", "body", "loss", F.concat(head, "body", F.lit(t.end)).alias("piece"), F.length(head).alias("lead"), "tokens", "attachments")
    df = df.select("conv_id", F.floor(F.col("turn") / block).alias("block"), one.alias("m"))
    df = df.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("m")).alias("m"))
    step = F.aggregate("m", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")), lambda acc, m: F.struct(
        (acc["at"] + F.length(m["piece"])).alias("at"),
        F.when(m["loss"], F.array_append(acc["spans"], F.struct((acc["at"] + m["lead"]).alias("start"), (acc["at"] + m["lead"] + F.length(m["body"])).alias("end")))).otherwise(acc["spans"]).alias("spans")))
    df = df.select("conv_id", F.struct("block", F.array_join(F.transform("m", lambda m: m["piece"]), "").alias("piece"), step.alias("s"), F.flatten(F.transform("m", lambda m: m["attachments"])).alias("attachments"),
                                       F.aggregate("m", F.lit(0).cast("bigint"), lambda a, m: a + m["tokens"]).alias("tokens"), F.size("m").alias("n")).alias("b"))
    df = df.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    lifted = F.aggregate("b", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")), lambda acc, b: F.struct(
        (acc["at"] + b["s"]["at"]).alias("at"),
        F.concat(acc["spans"], F.transform(b["s"]["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end")))).alias("spans")), lambda acc: acc["spans"])
    return df.select("conv_id", F.array_join(F.transform("b", lambda b: b["piece"]), "").alias("formatted"), lifted.alias("loss_spans"), F.flatten(F.transform("b", lambda b: b["attachments"])).alias("attachments"),
                     F.aggregate("b", F.lit(0).cast("bigint"), lambda a, b: a + b["tokens"]).alias("expanded_tokens"), F.aggregate("b", F.lit(0).cast("bigint"), lambda a, b: a + b["n"]).alias("n_turns"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds `turns` (array<struct<role, text>>, unescaped, placeholders as they are) and `loss_text`, both taken from `formatted` and `loss_spans` alone."""
    t = template
    pieces = F.filter(F.split("formatted", _quoted(t.turn)), lambda p, i: i > 0)
    turns = F.transform(pieces, lambda p: F.struct(unescaped(F.substring_index(p, t.body, 1)).alias("role"), unescaped(F.substring_index(F.substring_index(p, t.body, -1), t.end, 1)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    return formatted.withColumn("turns", turns).withColumn("loss_text", loss)
