"""Chat formatting: a finite-state machine over roles and a declarative template.

The template gives each role a prefix, a suffix and a loss flag; a turn becomes
three text segments (prefix, escaped text, suffix) of which only an assistant's
text carries the loss flag. Control strings inside texts are escaped by one
backslash after their first character ("</s>" becomes "<\\/s>", "<\\/s>" becomes
"<\\\\/s>"), which can be undone exactly.

Turn order is judged by a machine over roles. A conversation may be as long as
it likes: turns are gathered in chunks of CHUNK turn numbers, each chunk runs
the machine from every state (an array: state before -> state after), and a
conversation's chunks compose those arrays in order. So no task needs all turns
of a hot conversation to format or to validate it; only the digest of a whole
conversation, where asked for, needs its text as one value.

Defined results: rows are ordered by turn (nulls first), then role, then text;
repeated rows and equal turns all stay; a null text or role is empty; roles
outside the template are written with their name as OTHER says and have no
loss; conversations that the machine rejects are formatted too, with
valid = false; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 64

#: role -> (prefix, suffix, loss on the text). Every turn begins with <s> and ends with </s>.
TEMPLATE = {
    "system": ("<s>[SYS] ", " [/SYS]</s>", False),
    "user": ("<s>[INST] ", " [/INST]</s>", False),
    "assistant": ("<s>[OUT] ", "</s>", True),
}
#: Any other role: its escaped name stands in the marker.
OTHER = ("<s>[ROLE] ", "[/ROLE] ", "</s>")

#: Control strings: what follows their first character.
_CONTROL = r"(/?s>|/?INST\]|/?SYS\]|OUT\]|/?ROLE\])"
_ESCAPE = rf"([<\[])(\\*){_CONTROL}"
_UNESCAPE = rf"([<\[])\\(\\*){_CONTROL}"

#: States: 0 start, 1 system, 2 user, 3 assistant, 4 rejected. (state, role) -> state.
STATES = 5
MOVES = {(0, "system"): 1, (0, "user"): 2, (1, "user"): 2, (2, "assistant"): 3, (3, "user"): 2}
REJECTED, FINAL = 4, (3,)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def move(state: Column, role: Column) -> Column:
    out = F.lit(REJECTED)
    for (s, r), to in MOVES.items():
        out = F.when((state == s) & (role == r), to).otherwise(out)
    return out


def segments_of(role: Column, text: Column) -> Column:
    """array<struct<text, loss>>: prefix, escaped text, suffix of a turn."""
    seg = lambda t, loss: F.struct(t.alias("text"), F.lit(loss).alias("loss"))
    body = escape(text)
    out = F.array(seg(F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1])), False), seg(body, False), seg(F.lit(OTHER[2]), False))
    for name, (before, after, loss) in TEMPLATE.items():
        out = F.when(role == name, F.array(seg(F.lit(before), False), seg(body, loss), seg(F.lit(after), False))).otherwise(out)
    return out


def format_chat(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Rows (conv_id, chunk, n_turns, segments array<struct<text, loss>>, fsm array<int>).

    The formatted chunk is the segments' texts, joined; a conversation is its
    chunks by chunk number. fsm holds the state after the chunk for each state
    before it.
    """
    turns = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    turns = turns.withColumn("chunk", F.floor(F.col("turn") / F.lit(chunk)))
    held = turns.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text"))).alias("turns"))
    start = F.array(*[F.lit(s) for s in range(STATES)])
    return held.select(
        "conv_id",
        "chunk",
        F.size("turns").alias("n_turns"),
        F.flatten(F.transform("turns", lambda t: segments_of(t.role, t.text))).alias("segments"),
        F.aggregate("turns", start, lambda acc, t: F.transform(acc, lambda s: move(s, t.role))).alias("fsm"),
    )


def text_of(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s.text), "")


def loss_text(segments: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text)), "")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> parsed from formatted text; undoes format_chat."""
    pieces = F.regexp_extract_all(formatted, F.lit(r"(?s)<s>(.*?)</s>"), F.lit(1))

    def turn(p):
        cut = len("<s>")
        head = F.regexp_extract(p, r"(?s)^\[ROLE\] (.*?)\[/ROLE\] ", 1)
        rest = F.regexp_replace(p, r"(?s)^\[ROLE\] .*?\[/ROLE\] ", "")
        out = F.struct(unescape(head).alias("role"), unescape(rest).alias("text"))
        for name, (before, after, _) in TEMPLATE.items():
            b, a = before[cut:], after[: -len("</s>")]
            inner = F.substring(p, F.lit(len(b) + 1), F.length(p) - len(b) - len(a))
            out = F.when(F.startswith(p, F.lit(b)), F.struct(F.lit(name).alias("role"), unescape(inner).alias("text"))).otherwise(out)
        return out

    return F.transform(pieces, turn)


def compose(fsms: Column) -> Column:
    """State after a list of chunk arrays, from the start state."""
    return F.aggregate(fsms, F.lit(0), lambda s, f: F.get(f, s))


def conversations_of(chunks: DataFrame) -> DataFrame:
    """conv_id, n_turns, valid: the machine's verdict on each conversation."""
    own = chunks.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct(F.col("chunk").isNotNull().alias("known"), "chunk", "fsm"))).alias("c"))
    return own.select("conv_id", "n_turns", compose(F.transform("c", lambda c: c.fsm)).isin(*FINAL).alias("valid"))


def digests(chunks: DataFrame) -> DataFrame:
    """Per conversation what can be read back from its formatted output."""
    read = chunks.select("conv_id", "chunk", "fsm", text_of(F.col("segments")).alias("formatted"), loss_text(F.col("segments")).alias("loss"))
    read = read.select("*", read_back(F.col("formatted")).alias("turns"))
    each = read.select(
        "conv_id",
        F.struct(
            F.col("chunk").isNotNull().alias("known"),
            F.col("chunk"),
            F.size("turns").alias("n"),
            F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").alias("said"),
            F.col("loss"),
            F.length("formatted").alias("chars"),
            F.col("fsm"),
        ).alias("c"),
    )
    own = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    joined = lambda f: F.array_join(F.transform("c", f), "")
    total = lambda f: F.aggregate("c", F.lit(0).cast("bigint"), lambda a, c: a + f(c))
    return own.select(
        "conv_id",
        total(lambda c: c.n).alias("n_turns"),
        F.sha2(joined(lambda c: c.said), 256).alias("turns_sha256"),
        total(lambda c: F.length(c.loss)).alias("loss_chars"),
        F.sha2(joined(lambda c: c.loss), 256).alias("loss_sha256"),
        total(lambda c: c.chars).alias("formatted_chars"),
        compose(F.transform("c", lambda c: c.fsm)).isin(*FINAL).alias("valid"),
    )
