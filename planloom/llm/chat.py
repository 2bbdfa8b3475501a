"""Chat logs as training text: messages rebuilt from events, then rendered with a loss mask.

Native DataFrame operations only. A log's events are
- `message`: the whole text of a turn,
- `delta`: text appended to the turn,
- `edit`: new text of a turn; events of later turns recorded before it no longer count,
- `regenerate`: the turn starts again with this text; deltas follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings, and what a turn is put between.
OPEN, CLOSE = "<s>", "</s>"
# Inside texts a control string gets a backslash after its first character, one more if there are some already.
GUARDED = r"(<|\[)(\\*)(/?s>|/?INST\])"
ESCAPED = r"(<|\[)\\(\\*)(/?s>|/?INST\])"


def escaped(text: Column) -> Column:
    """`text` without control strings; `unescaped` gives it back."""
    return F.regexp_replace(text, GUARDED, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def messages(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: the final messages of the logs in `events` (conv_id, seq, turn, kind, role, text).

    Events are folded in order of seq, ties by kind, role and text. Null texts are empty, null or unknown kinds count as `message`.
    A turn's role is that of its last event with one, or an empty string. Events with a null conv_id form a
    conversation of their own, likewise those with a null turn a turn before all others. Repeated events count as often as they are there.
    Turns whose events were all withdrawn are left out. Other columns are ignored.

    One shuffle, by conversation; a text is folded per turn, so only rendering needs a conversation as a whole.
    """
    kind = F.coalesce("kind", F.lit("message"))
    events = events.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.struct(
            F.col("seq").cast("long").alias("seq"),
            F.when(kind.isin("delta", "edit", "regenerate"), kind).otherwise("message").alias("kind"),
            F.col("role").cast("string").alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("event"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    edited = F.max(F.when(F.col("event.kind") == "edit", F.col("event.seq"))).over(earlier)
    standing = events.withColumn("edited", edited).where("edited is null or event.seq is null or event.seq > edited")
    folded = standing.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("event")).alias("log"))
    size = F.size("log")
    # The last event that isn't a delta replaces everything before it.
    back = F.array_position(F.reverse(F.transform("log.kind", lambda k: k != "delta")), True)
    first = F.when(back > 0, size - back + 1).otherwise(1).cast("int")
    roles = F.filter("log.role", lambda role: role.isNotNull())
    return folded.select(
        "conv_id",
        "turn",
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.slice("log.text", first, size), "").alias("text"),
    )


def rendered(chats: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans for the messages `chats` (conv_id, turn, role, text).

    A turn is `<s>role` newline `text</s>` with control strings inside escaped (in roles newlines too), in order of turn,
    role and text. loss_spans holds the [start, start + length) of the assistants' texts within `formatted`, in
    code points. Null roles and texts are empty. Other columns are ignored.
    """
    role = F.regexp_replace(F.regexp_replace(F.coalesce("role", F.lit("")), r"\\", r"\\\\"), "\n", r"\\n")
    turns = chats.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        escaped(F.coalesce("text", F.lit(""))).alias("text"),
        F.concat(F.lit(OPEN), escaped(role), F.lit("\n")).alias("head"),
    )
    size = F.length("head") + F.length("text") + len(CLOSE)
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)))
    ordered = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "role", "head", "text"))).alias("ts"))
    spans = F.transform(
        F.filter("ts", lambda t: t["role"] == "assistant"),
        lambda t: F.struct((t["at"] + F.length(t["head"])).alias("start"), F.length(t["text"]).alias("length")),
    )
    pieces = F.transform("ts", lambda t: F.concat(t["head"], t["text"], F.lit(CLOSE)))
    return ordered.select("conv_id", F.array_join(pieces, "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text)."""
    bodies = F.filter(F.split(formatted, CLOSE), lambda body: body.startswith(OPEN))

    def turn(body: Column) -> Column:
        head = F.substring_index(body, "\n", 1)
        role = unescaped(F.substring(head, len(OPEN) + 1, 2_000_000_000))
        # Backslash pairs are set apart first, so that only single ones join an n.
        plain = F.regexp_replace(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"\\\\", r"\\")
        return F.struct(plain.alias("role"), unescaped(F.substr(body, F.length(head) + 2)).alias("text"))

    return F.transform(bodies, turn)


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, as they were."""
    return F.transform(spans, lambda span: unescaped(F.substr(formatted, (span["start"] + 1).cast("int"), span["length"])))
