r"""Chat formatting with a grammar round trip. Column functions only.

Grammar of the output::

    conversation := turn*
    turn         := "<|im_start|>" role "\n" body "<|im_end|>" "\n"

The parser is deterministic: it splits at every turn opening, takes the role up
to the first line break and the body up to the turn's closing, which must end
the piece, and undoes escapes: in a body `<\...\|` with n >= 1 backslashes has
n - 1, in a role `%0A`, `%3C` and `%25` stand for a line break, `<` and `%`.
Rendering starts with plain text. Each turn is parsed back alone, and a turn
that does not give its source is escaped; then the whole conversation is
parsed back, and if a turn still differs every turn is escaped. Escaping is a
bijection whose results hold no `<|`, so the second step always agrees; a
conversation that did not would raise.

Nulls and edges: a null role or text is empty, a null turn comes first, turns
of equal number are ordered by role, then text, repeated rows are repeated
turns, a null conv_id is a conversation of its own. Rows of one conversation
meet in one row, as its output does. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, or_empty

OPEN, CLOSE, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"


def escape_body(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_body(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def rendered_turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), body, F.lit(CLOSE + "\n"))


def parsed(output: Column) -> Column:
    """array<struct<role, text>> read from rendered text; null where it does not follow the grammar."""
    end = CLOSE + "\n"

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        body = F.substr(piece, cut + 1)
        good = (cut > 0) & (F.instr(body, CLOSE) == F.length(body) - len(end) + 1) & F.endswith(body, F.lit(end))
        return F.when(good, F.struct(unescape_role(F.substr(piece, F.lit(1), cut - 1)).alias("role"),
                                     unescape_body(F.substr(body, F.lit(1), F.length(body) - len(end))).alias("text")))

    pieces = let(F.split(output, r"<\|im_start\|>"), lambda p: F.when(F.get(p, F.lit(0)) == "", F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))))
    turns = F.transform(pieces, turn)
    return let(turns, lambda t: F.when(F.forall(t, lambda x: x.isNotNull()), t))


def formatted(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, output (the rendered text), turns (read back from it)."""
    tidy = rows.select("conv_id", F.struct(F.col("turn").alias("turn"), or_empty("role").alias("role"), or_empty("text").alias("text")).alias("t"))
    source = tidy.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("_source"))

    def turn(t: Column) -> Column:
        plain = rendered_turn(t["role"], t["text"])
        safe = rendered_turn(escape_role(t["role"]), escape_body(t["text"]))
        same = let(parsed(plain), lambda p: (F.size(p) == 1) & (F.get(p, F.lit(0))["role"] == t["role"]) & (F.get(p, F.lit(0))["text"] == t["text"]))
        return F.when(F.coalesce(same, F.lit(False)), plain).otherwise(safe)

    wanted = F.transform("_source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    first = F.array_join(F.transform("_source", turn), "")
    all_safe = F.array_join(F.transform("_source", lambda t: rendered_turn(escape_role(t["role"]), escape_body(t["text"]))), "")
    once = source.select("conv_id", "_source", let(first, lambda o: F.struct(o.alias("output"), parsed(o).alias("turns"))).alias("_r"))
    again = F.when(F.coalesce(F.col("_r.turns") == wanted, F.lit(False)), F.col("_r")).otherwise(
        let(all_safe, lambda o: F.struct(o.alias("output"), parsed(o).alias("turns"))))
    done = once.select("conv_id", again.alias("_r"), wanted.alias("_w"))
    checked = F.when(F.col("_r.turns") == F.col("_w"), F.col("_r.turns")).otherwise(
        F.raise_error(F.lit("a conversation did not survive its round trip")).cast("array<struct<role:string,text:string>>"))
    return done.select("conv_id", F.col("_r.output").alias("output"), checked.alias("turns"))


def digests(chats: DataFrame, trained: str = TRAINED) -> DataFrame:
    """Counts and digests of what `formatted` read back; the loss mask covers the texts of `trained` turns."""
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == trained), lambda t: t["text"]), "")
    return (chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
                         loss.alias("_loss"), F.length("output").cast("long").alias("formatted_chars"))
            .select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"),
                    F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars"))
