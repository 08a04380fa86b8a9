"""Chat formatting with typed content parts.

A message is a row (conversation, turn, role, parts); a part is text, image, audio or document.
A visitor, one expression for each kind of part, flattens the parts in their order: text is
escaped, an attachment becomes a numbered placeholder, and its reference and the number of
tokens it expands to (``EXPANSION``) are recorded. Formatting is done row by row with Spark's
own functions; a conversation's output is the concatenation of its rows in turn order, so a
long conversation is never gathered.

Template of a message: ``<|role|>ROLE<|text|>BODY<|end|>``, a placeholder is ``<|image:1|>``.
Control strings of this and of common other templates (``CONTROL``) inside texts and roles get
a backslash after their first character; one more if there are some already. So no text can
forge a mark, and ``unescape`` gives every text back.

The loss mask is a list of spans, in code points of the row's output: the escaped texts of the
roles that are learnt. ``parse`` reads everything back from the output.

Defined cases: null text or role counts as empty; null or empty parts give an empty body, a null
part and a part of unknown kind are left out; null sizes count as 0; rows of one turn come in
order of role and body, repeated rows each count; a null conversation is a conversation; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.llm import common as C

#: What begins a control string, then how it goes on. Fixed values of the template.
OPENERS = r"[<\[]"
CONTROL = r"\||/?s>|/?INST\]|</?SYS>"
ESCAPE = rf"({OPENERS})(\\*)({CONTROL})"
UNESCAPE = rf"({OPENERS})\\(\\*)({CONTROL})"
MARKS = ("<|role|>", "<|text|>", "<|end|>")
JOINT = "<|+|>"  # between two text parts, so that no mark can form across them
ATTACHMENTS = ("image", "audio", "document")
#: Tokens an attachment expands to: a fixed part and a part for each unit of its size
#: (image: tiles, audio: seconds, document: pages).
EXPANSION = {"image": (85, 170), "audio": (0, 25), "document": (10, 600)}

PARTS = "array<struct<kind:string,text:string,ref:string,size:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, "$1\\\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def text_parts(text: Column) -> Column:
    """One text part, the content of a plain message."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("size"))).cast(PARTS)


def _tokens(part: Column) -> Column:
    out = F.lit(0).cast("long")
    for kind, (fixed, each) in EXPANSION.items():
        out = F.when(part["kind"] == kind, fixed + each * F.coalesce(part["size"], F.lit(0))).otherwise(out)
    return out.cast("long")


class Visitor:
    """One method for each kind of part; each gives the part's output. ``number`` counts the
    attachments of the message from 1."""

    def text(self, part: Column, number: Column) -> Column:
        return escape(F.coalesce(part["text"], F.lit("")))

    def image(self, part: Column, number: Column) -> Column:
        return self.attachment("image", number)

    def audio(self, part: Column, number: Column) -> Column:
        return self.attachment("audio", number)

    def document(self, part: Column, number: Column) -> Column:
        return self.attachment("document", number)

    def attachment(self, kind: str, number: Column) -> Column:
        return F.concat(F.lit(f"<|{kind}:"), number.cast("string"), F.lit("|>"))

    def visit(self, part: Column, number: Column) -> Column:
        out = F.lit("")
        for kind in ("text", *ATTACHMENTS):
            out = F.when(part["kind"] == kind, getattr(self, kind)(part, number)).otherwise(out)
        return out


def _piece(z: Column, number: Column, visitor: Visitor) -> Column:
    p = z["kept"]
    return F.struct(F.concat(z["joint"], visitor.visit(p, number)).alias("out"), F.length(z["joint"]).alias("skip"),
                    p["kind"].alias("kind"), p["ref"].alias("ref"), number.alias("number"), _tokens(p).alias("tokens"))


def format_messages(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                    parts_col: str = "parts", learn: tuple[str, ...] = ("assistant",),
                    visitor: Visitor | None = None) -> DataFrame:
    """conv, turn, output, loss (spans [a, b) of the output), attachments (number, kind, ref,
    tokens), n_tokens (that the attachments expand to), one row per message."""
    visitor = visitor or Visitor()
    m = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.col(parts_col).cast(PARTS).alias("parts"))
    kept = F.filter(F.coalesce("parts", F.array().cast(PARTS)), lambda p: p["kind"].isin("text", *ATTACHMENTS))
    # number: attachments up to and with this part
    numbered = F.aggregate(
        "kept", F.array().cast("array<int>"),
        lambda acc, p: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))
                                             + F.when(p["kind"] == "text", 0).otherwise(1))))
    m = m.withColumn("kept", kept)
    m = m.withColumn("number", numbered)
    # a text part after a text part
    joint = F.transform("kept", lambda p, i: F.when(
        (p["kind"] == "text") & (F.try_element_at(F.col("kept"), F.when(i > 0, i))["kind"] == "text"),
        F.lit(JOINT)).otherwise(F.lit("")))
    m = m.withColumn("joint", joint)
    m = m.withColumn("pieces", F.zip_with(F.arrays_zip("kept", "joint"), "number", lambda z, n: _piece(z, n, visitor)))
    head = F.concat(F.lit(MARKS[0]), escape(F.col("role")), F.lit(MARKS[1]))
    m = m.withColumn("head", head).withColumn("body", F.array_join("pieces.out", ""))
    places = F.aggregate(
        "pieces", F.struct(F.length("head").alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["out"])).alias("at"),
            F.when(p["kind"] == "text", F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + p["skip"]).alias("a"), (acc["at"] + F.length(p["out"])).alias("b"))))).otherwise(acc["spans"]).alias("spans")))
    none = F.array().cast("array<struct<a:int,b:int>>")
    loss = F.when(F.col("role").isin(*learn), places["spans"]).otherwise(none)
    files = F.transform(F.filter("pieces", lambda p: p["kind"] != "text"), lambda p: F.struct(
        p["number"].alias("number"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    return m.select("conv", "turn", F.concat("head", "body", F.lit(MARKS[2])).alias("output"), loss.alias("loss"),
                    files.alias("attachments"),
                    F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("n_tokens"))


def parse(formatted: DataFrame) -> DataFrame:
    """conv, turn, role, text (placeholders in place), learnt (texts under the loss mask),
    chars (code points), read from ``output`` and ``loss`` alone."""
    mark = [re.escape(x) for x in MARKS]
    whole = rf"(?s)\A{mark[0]}(.*?){mark[1]}(.*){mark[2]}\z"
    learnt = F.transform("loss", lambda s: unescape(F.substring(F.col("output"), s["a"] + 1, s["b"] - s["a"])))
    return formatted.select("conv", "turn", unescape(F.regexp_extract("output", whole, 1)).alias("role"),
                            unescape(F.replace(F.regexp_extract("output", whole, 2), F.lit(JOINT), F.lit(""))).alias("text"), learnt.alias("learnt"),
                            F.length("output").alias("chars"))


def conversation_digests(parsed: DataFrame) -> DataFrame:
    """One row per conversation: n_turns, and digests of its turns and learnt texts in turn
    order. A digest is one pass over its conversation by definition: the rows stream through it
    sorted, so memory holds one batch, however long the conversation."""
    schema = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long")
    rows = parsed.select(F.col("conv").cast("long").alias("conv"), "turn", "role", "text",
                         F.array_join("learnt", "").alias("learnt"), "chars")
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    types = C.pa_schema(parsed.sparkSession, schema)

    def run(batches):
        now, state = object(), None

        def done():
            return [now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for b in batches:
            out = []
            for conv, role, text, learnt, chars in zip(*(b.column(c).to_pylist() for c in (
                    "conv", "role", "text", "learnt", "chars"))):
                if state is None or conv != now:
                    if state:
                        out.append(done())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learnt)
                state[3].update(learnt.encode())
                state[4] += chars
            if out:
                yield C.to_batch(dict(zip(types.names, map(list, zip(*out)))), types)
        if state:
            yield C.to_batch(dict(zip(types.names, [[x] for x in done()])), types)

    return C.arrow_stream(rows, run, schema)
