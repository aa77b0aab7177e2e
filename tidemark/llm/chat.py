"""Conversations as marked-up text with the spans that a loss may look at."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, text_of

# The template. Escaped texts and roles never hold "<|", so the marks are unambiguous.
START, BETWEEN, END = "<|turn|>", "<|next|>", "<|end|>\n"
TURNS_PER_PART = 32


def escape(text: Column) -> Column:
    """Reversible: a backslash doubles, and ``<|`` becomes ``<\\|``."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    """As ``escape``; besides, a line break becomes ``\\n``, for it ends the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def _merged(turns: Column) -> Column:
    """Adjacent turns of one role as one block: array of (role, texts)."""
    block = lambda role, texts: F.struct(role.alias("role"), texts.alias("texts"))

    def add(blocks: Column, turn: Column) -> Column:
        last = F.try_element_at(blocks, F.lit(-1))
        grown = F.concat(
            F.slice(blocks, 1, F.size(blocks) - 1),
            F.array(block(last["role"], F.array_append(last["texts"], turn["text"]))),
        )
        fresh = F.array_append(blocks, block(turn["role"], F.array(turn["text"])))
        return F.when((F.size(blocks) > 0) & (last["role"] == turn["role"]), grown).otherwise(fresh)

    none = F.array().cast("array<struct<role:string,texts:array<string>>>")
    return F.aggregate(turns, none, add)


def _pieces(blocks: Column, goes_on: Column, comes_on: Column, loss_role: str) -> Column:
    """The text in pieces (s, loss). The first block continues the part before if ``comes_on``;
    the last block has no end mark if it ``goes_on`` in the next part."""
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    no = F.lit(False)

    def of(block: Column, index: Column) -> Column:
        head = F.when((index == 0) & comes_on, BETWEEN).otherwise(
            F.concat(F.lit(START), escape_role(block["role"]), F.lit("\n"))
        )
        texts = F.transform(
            block["texts"],
            lambda text, n: F.array(
                piece(F.when(n > 0, BETWEEN).otherwise(""), no),
                piece(escape(text), block["role"] == loss_role),
            ),
        )
        tail = F.when((index == F.size(blocks) - 1) & goes_on, "").otherwise(END)
        return F.concat(F.array(piece(head, no)), F.flatten(texts), F.array(piece(tail, no)))

    return F.flatten(F.transform(blocks, of))


def _spans(pieces: Column) -> Column:
    """(start, length) in code points of the pieces under the loss."""
    none = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"),
    )

    def add(sofar: Column, piece: Column) -> Column:
        length = F.length(piece["s"]).cast("long")
        span = F.struct(sofar["at"].alias("start"), length.alias("length"))
        spans = F.when(piece["loss"], F.array_append(sofar["spans"], span)).otherwise(sofar["spans"])
        return F.struct((sofar["at"] + length).alias("at"), spans.alias("spans"))

    return F.aggregate(pieces, none, add, lambda sofar: sofar["spans"])


def format_chat(
    turns: DataFrame,
    *,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_role: str = "assistant",
    turns_per_part: int = TURNS_PER_PART,
) -> DataFrame:
    """(conversation, part, formatted, loss_spans), by Spark expressions only.

    Turns are sorted by (turn, role, text), adjacent turns of one role share one header, and the
    spans tell where the texts of ``loss_role`` stand. A part holds the turn numbers of one range of
    ``turns_per_part``; the parts of a conversation in order, put together, are its text, and a run
    of one role goes on across them. So no row and no sort grows with a conversation.

    Null texts and roles are empty, null turns come first, rows with a null conversation form one
    conversation, repeated rows are repeated turns, other columns are not looked at.
    """
    number = quoted(turn).cast("long")
    part = F.floor(F.coalesce(number, F.lit(-1)) / turns_per_part).cast("long")
    rows = turns.select(
        quoted(conversation).alias("conversation"),
        part.alias("part"),
        F.struct(
            number.alias("turn"), text_of(role).alias("role"), text_of(text).alias("text")
        ).alias("t"),
    )
    key = F.struct("t.turn", "t.role")
    edges = rows.groupBy("conversation", "part").agg(
        F.min(key).alias("first"), F.max(key).alias("last")
    )
    order = Window.partitionBy("conversation").orderBy("part")
    edges = edges.select(
        F.col("conversation").alias("c"),
        F.col("part").alias("p"),
        F.coalesce(F.lag("last.role").over(order) == F.col("first.role"), F.lit(False)).alias("comes_on"),
        F.coalesce(F.lead("first.role").over(order) == F.col("last.role"), F.lit(False)).alias("goes_on"),
    )
    parts = rows.groupBy("conversation", "part").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    joined = parts.join(edges, F.expr("conversation <=> c AND part = p"))
    pieces = _pieces(_merged(F.col("turns")), F.col("goes_on"), F.col("comes_on"), loss_role)
    return joined.select("conversation", "part", pieces.alias("pieces")).select(
        F.col("conversation").alias(conversation),
        "part",
        F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        _spans(F.col("pieces")).alias("loss_spans"),
    )


class _Reading:
    """Digests of one conversation, fed with its parts in order."""

    def __init__(self):
        self.role, self.turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, spans: list) -> None:
        self.chars += len(text)
        for span in spans:
            learned = unescape(text[span["start"] : span["start"] + span["length"]])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())
        at = 0
        while at < len(text):
            if text.startswith(START, at):
                stop = text.index("\n", at)
                self.role, at = unescape(text[at + len(START) : stop]), stop + 1
            elif text.startswith(BETWEEN, at):
                at += len(BETWEEN)
            else:
                raise ValueError(f"no mark at {at}")
            stop = text.find("<|", at)
            stop = len(text) if stop < 0 else stop
            self.turns += 1
            self.said.update(f"{self.role}\n{unescape(text[at:stop])}\n".encode())
            at = stop + len(END) if text.startswith(END, stop) else stop

    def result(self) -> tuple:
        said, loss = self.said.hexdigest(), self.loss.hexdigest()
        return self.turns, said, self.loss_chars, loss, self.chars


def read_chat(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """What the formatted text says, per conversation: number of turns, digest of roles and texts,
    characters and digest of the text under the loss, all characters.

    Parts pass in order through a reader that holds one part and two running digests.
    """
    names = ["conversation", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = (
        "conversation long, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long"
    )

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays(columns, names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reading = None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if reading is None or row["conversation"] != current:
                    if reading is not None:
                        done.append((current, *reading.result()))
                    current, reading = row["conversation"], _Reading()
                reading.add(row["formatted"], row["loss_spans"])
            if done:
                yield batch_of(done)
        if reading is not None:
            yield batch_of([(current, *reading.result())])

    parts = formatted.select(
        quoted(conversation).cast("long").alias("conversation"), "part", "formatted", "loss_spans"
    )
    ordered = parts.repartition("conversation").sortWithinPartitions("conversation", "part")
    return ordered.mapInArrow(read, schema).withColumnRenamed("conversation", conversation)
