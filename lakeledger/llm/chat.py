"""Chat formatting: every assistant turn is an example of its own, with all turns before it as context."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import quoted

START, END = "<|im_start|>", "<|im_end|>"
#: Examples of a conversation whose contexts are joined under one key.
BLOCK = 32
#: A control string in a text, or one that is escaped already, gets one more backslash behind its opening mark.
_CONTROL = r"<\|(\\*)(im_start|im_end)\|>"
_ESCAPED = r"<\|\\(\\*)(im_start|im_end)\|>"


def escape(text: Column) -> Column:
    """The text without control strings; ``unescape`` gives it back whatever it holds."""
    return F.regexp_replace(text, _CONTROL, r"<|\\$1$2|>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "<|$1$2|>")


def format_chat(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    trainable: str = "assistant",
) -> DataFrame:
    """One row a turn: conv, position, role, segment, start, example, loss_start, loss_end.

    A segment is the turn in the template ``<|im_start|>role\\ntext<|im_end|>\\n``, with control strings in role and text
    escaped and line breaks in a role written as blanks. A turn of role ``trainable`` is an example: its text is all
    segments of the conversation up to its own, and only the reply between loss_start and loss_end (code points of that
    text, the end mark not included) is trained. ``example`` numbers them from 0; it is null for other turns.

    An example's context is the prefix of segments before it, so no context is stored again for every reply: a
    conversation of n turns takes n rows, not n * n / 2 copies, however long it is. ``expand_examples`` writes the
    contexts of all examples out, ``example_texts`` those of chosen ones.

    Turns are ordered by turn (null first), role and text, so repeated turns all stay, in a defined order. Null texts
    and roles are empty. A null conversation id is a conversation like any other. Columns besides the four are not used.
    A running sum over each conversation's turns needs them in order; it streams and spills.
    """
    rows = conversations.select(
        quoted(conv).alias("conv"), quoted(turn).alias("turn"),
        F.coalesce(quoted(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"),
    )
    head = F.concat(F.lit(START), escape(F.regexp_replace("role", r"[\r\n]", " ")), F.lit("\n"))
    rows = rows.withColumns({"head": head, "body": escape(F.col("text"))})
    rows = rows.withColumn("segment", F.concat("head", "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_example = F.col("role") == trainable
    rows = rows.withColumns(
        {
            "position": F.row_number().over(order),
            "stop": F.sum(F.length("segment").cast("long")).over(running),
            "seen": F.sum(is_example.cast("int")).over(running),
        }
    )
    start = F.col("stop") - F.length("segment")
    loss = start + F.length("head")
    return rows.select(
        "conv", "position", "role", "segment", start.alias("start"),
        F.when(is_example, F.col("seen") - 1).alias("example"),
        F.when(is_example, loss).alias("loss_start"),
        F.when(is_example, loss + F.length("body")).alias("loss_end"),
    )


def example_texts(formatted: DataFrame, examples: DataFrame) -> DataFrame:
    """(conv, example, text, loss_start, loss_end) of the wanted (conv, example) rows, with contexts written out.

    Its output is as long as the contexts are; ask for the examples of one training batch at a time.
    """
    wanted = formatted.join(examples.select("conv", "example").distinct(), ["conv", "example"])
    wanted = wanted.select("conv", "example", "loss_start", "loss_end", F.col("position").alias("last"))
    parts = formatted.select("conv", "position", "segment").join(wanted, "conv").where("position <= last")
    texts = parts.groupBy("conv", "example", "loss_start", "loss_end").agg(F.array_sort(F.collect_list(F.struct("position", "segment"))).alias("s"))
    return texts.select("conv", "example", F.array_join("s.segment", "").alias("text"), "loss_start", "loss_end")


def expand_examples(formatted: DataFrame) -> DataFrame:
    """One row for each example and segment of its text: conv, example, position, segment, start, last, loss_start, loss_end.

    An example's text is its segments in the order of position, up to its reply's, ``last``; loss_start and loss_end
    are offsets in that text. Each partition has an example's rows beside each other and in order.

    No text is one row. BLOCK examples of a conversation are one key of the join, so the contexts of a long
    conversation are spread over many tasks; a segment is shuffled once a block, not once an example.
    """
    own = Window.partitionBy("conv")
    before = F.count("example").over(own.orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    parts = formatted.select("conv", "position", "segment", "start", before.alias("before"), F.count("example").over(own).alias("total"))
    # the segment belongs to all examples that end at or behind it
    block = F.explode(F.sequence(F.floor(F.col("before") / BLOCK), F.floor((F.col("total") - 1) / BLOCK)))
    parts = parts.where("before < total").select("conv", "position", "segment", "start", block.alias("block"))
    wanted = formatted.where("example is not null").select(
        F.col("conv").alias("own"), F.floor(F.col("example") / BLOCK).alias("own_block"), "example",
        F.col("position").alias("last"), "loss_start", "loss_end",
    )
    same = F.col("conv").eqNullSafe(F.col("own")) & (F.col("block") == F.col("own_block"))
    rows = parts.join(wanted, same & (F.col("position") <= F.col("last")))
    rows = rows.select("conv", "example", "position", "segment", "start", "last", "loss_start", "loss_end")
    return rows.sortWithinPartitions("conv", "example", "position")


def read_chat(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its formatted segments and loss spans alone.

    conv, n_turns, turns_sha256 (role, line break, text, line break of every turn), loss_chars, loss_sha256 (code points
    and digest of all trained text, unescaped, in order), n_examples, formatted_chars (code points of all segments),
    expanded_chars (of all examples, contexts counted for each).

    Segments are parsed where they lie; only a digest needs a conversation's turns in order, and reads them as a stream.
    """
    end = F.length(F.lit(END + "\n"))
    loss = F.substring("segment", (F.col("loss_start") - F.col("start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    parsed = formatted.select(
        "conv", "position", *_parsed(),
        F.when(F.col("example").isNotNull(), unescape(loss)).alias("loss"),
        F.length("segment").cast("long").alias("chars"),
        F.when(F.col("example").isNotNull(), F.col("loss_end") + end).alias("expanded"),
    )
    return _digested(parsed)


def read_examples(formatted: DataFrame, examples: DataFrame) -> DataFrame:
    """The columns of ``read_chat``, with all that concerns examples read from their texts, as ``expand_examples`` gives them.

    loss_chars and loss_sha256 are of what lies between loss_start and loss_end of each example's text, n_examples counts
    the examples found, formatted_chars their code points with their contexts. expanded_chars is what their offsets
    say that should be, so the two are equal if nothing is missing. Turns are read from ``formatted``, as those behind
    the last reply are in no example.
    """
    end = F.length(F.lit(END + "\n"))
    chars = F.length("segment").cast("long")
    low = F.greatest(F.col("loss_start") - F.col("start"), F.lit(0))
    high = F.least(F.col("loss_end") - F.col("start"), chars)
    piece = F.when(high > low, F.struct("position", F.substring("segment", (low + 1).cast("int"), (high - low).cast("int")).alias("piece")))
    # only what is trained is gathered: the context's segments give no piece
    read = examples.groupBy("conv", "example", "last", "loss_end").agg(
        F.array_sort(F.collect_list(piece))["piece"].alias("pieces"), F.sum(chars).alias("chars")
    )
    read = read.select(
        "conv", F.col("last").alias("position"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
        unescape(F.array_join("pieces", "")).alias("loss"), "chars", (F.col("loss_end") + end).alias("expanded"),
    )
    nothing = [F.lit(None).cast("string").alias("loss"), F.lit(0).cast("long").alias("chars"), F.lit(None).cast("long").alias("expanded")]
    return _digested(formatted.select("conv", "position", *_parsed(), *nothing).unionByName(read))


def _parsed() -> list[Column]:
    """role and text of a segment."""
    inner = r"(?s)^<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n$"
    return [unescape(F.regexp_extract("segment", inner, k)).alias(name) for k, name in ((1, "role"), (2, "text"))]


def _digested(parsed: DataFrame) -> DataFrame:
    """A row a conversation from rows of (conv, position, role, text, loss, chars, expanded); a null role is no turn, a null loss no example."""
    rows = parsed.repartition("conv").sortWithinPartitions("conv", "position")
    schema = T.StructType(
        [
            T.StructField("conv", parsed.schema["conv"].dataType), T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()), T.StructField("n_examples", T.LongType()),
            T.StructField("formatted_chars", T.LongType()), T.StructField("expanded_chars", T.LongType()),
        ]
    )
    return rows.mapInArrow(_digests, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "n_examples", "formatted_chars", "expanded_chars"]
    held = None  # of the conversation being read: id as an array of one, and its sums and digests

    def close() -> pa.RecordBatch:
        conv, n, turns, chars, losses, examples, length, expanded = held
        values = [n, turns.hexdigest(), chars, losses.hexdigest(), examples, length, expanded]
        return pa.RecordBatch.from_arrays([conv, *(pa.array([x]) for x in values)], names)

    for batch in batches:
        done = []
        convs = batch.column(0).to_pylist()
        others = zip(*(column.to_pylist() for column in batch.columns[2:]))
        for at, (conv, (role, text, loss, chars, expanded)) in enumerate(zip(convs, others)):
            if held is None or held[0][0].as_py() != conv:
                if held is not None:
                    done.append(close())
                held = [batch.column(0).slice(at, 1), 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            if role is not None:
                held[1] += 1
                held[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if loss is not None:
                held[3] += len(loss)
                held[4].update(loss.encode("utf-8", "surrogatepass"))
                held[5] += 1
                held[7] += expanded
            held[6] += chars
        for out in done:
            yield out
    if held is not None:
        yield close()
