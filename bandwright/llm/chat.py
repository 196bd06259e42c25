"""Chat formatting by event sourcing: fold event logs into messages, then render.

Native: DataFrame functions only. Rows are dealt out by conversation once; within one
everything is a sort, a running value or a grouping, so work grows with its events and
not with their square. Only final turns are gathered, as the folded text is one row.

Events have ``conv_id, seq, message, kind, role, text``; ``message`` is the
message's place in its conversation. Folded in order of ``seq``:

* ``start`` opens a message with its role;
* ``delta`` appends streamed text;
* ``edit`` replaces the message's text so far;
* ``regenerate`` discards the message's text so far and all later messages.

Template: each turn is ``<s>[INST] role [/INST] text </s>``. A control string
inside a role or text gets a backslash before the backslashes in front of it,
and loses it when read; marks follow a space or stand first, never a backslash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN, BETWEEN, CLOSE = "<s>[INST] ", " [/INST] ", " </s>"
CONTROL = r"</?s>|\[/?INST\]"

LEARNED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)({CONTROL})", r"\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*)({CONTROL})", "$1$2")


def joined(texts: Column) -> Column:
    return F.array_join(texts, "")


def folded(events: DataFrame) -> DataFrame:
    """One row per conversation: ``turns``, an array of ``message, role, text``.

    Null text and role count as empty. Events that are alike in every column are
    one event. An event without a place or a number stays, and has no text. Conversations
    without events are absent; an empty table gives none.
    """
    resets = F.col("kind").isin("edit", "regenerate")
    own = Window.partitionBy("conv_id", "message")
    # Later events only: with equal numbers none comes before the other.
    later = (
        Window.partitionBy("conv_id")
        .orderBy(F.col("seq").desc())
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    # The message itself stays after its text is discarded.
    replaced = (F.max(F.when(resets, F.col("seq"))).over(own) > F.col("seq")) & (F.col("kind") != "start")
    earliest = F.min(F.when(F.col("kind") == "regenerate", F.col("message"))).over(later)
    discarded = F.col("seq").isNotNull() & (earliest < F.col("message"))
    marked = events.select(
        "conv_id",
        F.col("seq").cast("bigint").alias("seq"),
        "message",
        "kind",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumns({"replaced": replaced & F.col("message").isNotNull(), "discarded": discarded})
    alive = marked.filter(~F.coalesce("replaced", F.lit(False)) & ~F.coalesce("discarded", F.lit(False)))

    def text_of(kinds: tuple[str, ...], field: str) -> Column:
        event = F.struct("seq", "kind", "role", "text")
        wanted = F.when(F.col("message").isNotNull() & F.col("kind").isin(*kinds), event)
        log = F.array_distinct(F.sort_array(F.collect_list(wanted)))
        return joined(F.transform(log, lambda e: e[field])).alias(field)

    turns = alive.groupBy("conv_id", "message").agg(
        text_of(("start",), "role"), text_of(("delta", "edit"), "text")
    )
    return turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("message", "role", "text"))).alias("turns")
    )


def rendered(conversations: DataFrame) -> DataFrame:
    """``formatted`` text of each conversation's turns, and ``loss_spans`` in it.

    Spans (start from 0, length, in characters) cover the assistant's texts.
    """
    by_turn = Window.partitionBy("conv_id").orderBy("place")
    pieces = conversations.select("conv_id", F.posexplode("turns").alias("place", "turn")).select(
        "conv_id",
        "place",
        F.concat(F.lit(OPEN), escaped(F.col("turn.role")), F.lit(BETWEEN)).alias("head"),
        escaped(F.col("turn.text")).alias("body"),
        (F.col("turn.role") == LEARNED_ROLE).alias("learned"),
    )
    length = F.char_length("body").cast("bigint")
    whole = F.char_length("head") + length + len(CLOSE)
    start = F.sum(whole).over(by_turn) - length - len(CLOSE)
    span = F.when(F.col("learned"), F.struct("start", "length"))
    return (
        pieces.withColumns({"start": start, "length": length})
        .groupBy("conv_id")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("place", F.concat("head", "body", F.lit(CLOSE)).alias("piece")))
            ).alias("pieces"),
            F.sort_array(F.collect_list(span)).alias("loss_spans"),
        )
        .select("conv_id", joined(F.col("pieces.piece")).alias("formatted"), "loss_spans")
    )


def parsed(formatted: Column) -> Column:
    """Turns (role, text) read back from a formatted conversation."""
    ended = F.split(formatted, CLOSE)
    whole = F.slice(ended, F.lit(1), F.greatest(F.size(ended) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, len(OPEN) + 1, 2**31 - 1)
        parts = F.split(inner, r" \[/INST\] ", 2)  # BETWEEN as a pattern
        return F.struct(
            unescaped(parts[0]).alias("role"),
            unescaped(parts[1]).alias("text"),
        )

    return F.transform(whole, turn)


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, formatted, learned``: with all text under the loss mask, unescaped.

    Nothing is put between the texts. A span is cut from the piece it starts in, not from
    the start of the whole text.
    """
    ended = F.split("formatted", CLOSE)
    none = F.lit(None)
    pieces = F.transform(
        ended,
        lambda piece, place: F.struct(
            F.lit(0).alias("kind"),
            place.cast("bigint").alias("place"),
            piece.alias("piece"),
            none.cast("bigint").alias("length"),
        ),
    )
    spans = F.transform(
        "loss_spans",
        lambda s: F.struct(
            F.lit(1).alias("kind"),
            s["start"].alias("place"),
            none.cast("string").alias("piece"),
            s["length"].alias("length"),
        ),
    )
    before = Window.partitionBy("conv_id").orderBy("kind", "place").rowsBetween(Window.unboundedPreceding, -1)
    upto = (
        Window.partitionBy("conv_id")
        .orderBy("at", "kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    is_piece = F.col("kind") == 0
    size = F.char_length("piece").cast("bigint") + len(CLOSE)
    inside = (F.col("at") - F.last("piece_at", ignorenulls=True).over(upto) + 1).cast("int")
    found = (
        formatted.select("conv_id", F.explode(F.concat(pieces, spans)).alias("e"))
        .select("conv_id", "e.*")
        .withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0).cast("bigint")))
        .withColumn("at", F.when(is_piece, F.col("start")).otherwise(F.col("place")))
        .withColumn("piece_at", F.when(is_piece, F.col("start")))
        .withColumns({"inside": inside, "held": F.last("piece", ignorenulls=True).over(upto)})
    )
    said = unescaped(F.substring(F.col("held"), F.col("inside"), F.col("length").cast("int")))
    learned = F.when(~is_piece, F.struct("at", said.alias("said")))
    piece = F.when(is_piece, F.struct("place", "piece"))
    return found.groupBy("conv_id").agg(
        F.array_join(F.sort_array(F.collect_list(piece))["piece"], CLOSE).alias("formatted"),
        joined(F.sort_array(F.collect_list(learned))["said"]).alias("learned"),
    )


def turn_events(rows: DataFrame) -> DataFrame:
    """An event log that streams the given turns.

    Each turn is opened, streamed in two deltas, and reworked. An assistant's first draft
    is answered by a next message before it is thrown away and generated again, which
    discards the answer as well; others' turns are edited. Rows of a conversation go by
    turn, then role and text; repeated rows are repeated turns.
    """
    turns = rows.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("own_role"),
        F.coalesce("text", F.lit("")).alias("own_text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "own_role", "own_text")
    text = F.col("own_text")
    half = F.floor(F.char_length(text) / 2).cast("int")
    front, back = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.lit(2**31 - 1))
    nothing = F.lit("")

    def event(step: int, kind: str, role: Column, content: Column, ahead: int = 0) -> Column:
        return F.struct(
            (F.col("place") * 8 + step).cast("bigint").alias("seq"),
            (F.col("place") + ahead).alias("message"),
            F.lit(kind).alias("kind"),
            role.alias("role"),
            content.alias("text"),
        )

    opened = event(0, "start", F.col("own_role"), nothing)
    draft = event(1, "delta", nothing, back)
    again = F.array(
        opened,
        draft,
        event(2, "start", F.lit("user"), nothing, ahead=1),
        event(3, "delta", nothing, front, ahead=1),
        event(4, "regenerate", nothing, nothing),
        event(5, "delta", nothing, front),
        event(6, "delta", nothing, back),
    )
    changed = F.array(
        opened, draft, event(2, "edit", nothing, front), event(3, "delta", nothing, back)
    )
    return (
        turns.withColumn("place", F.row_number().over(order) - 1)
        .select(
            "conv_id",
            F.explode(F.when(F.col("own_role") == LEARNED_ROLE, again).otherwise(changed)).alias("e"),
        )
        .select("conv_id", "e.*")
    )
