"""Conversations as marked-up strings, built and read back with Spark expressions only.

A string is a row of blocks, one for each run of adjacent turns with one role::

    <s>[INST]role[/INST]text[PART]text</s>

Control strings inside roles and texts get a backslash after their first character (one more, where
some stand there already), so that no text can end a turn and reading back restores every byte.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, HEAD, PART, CLOSE = "<s>[INST]", "[/INST]", "[PART]", "</s>"
#: First character, backslashes, rest of a control string.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|PART\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|PART\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Places summed one by one between two sums carried over.
STRIDE = 256


def running(sizes: Column) -> Column:
    """The sum of what stands before each place of an array of numbers, in linear time.

    Only the sums of every ``STRIDE`` places are carried over; appending to one long array would
    copy it each time.
    """
    none = F.expr("CAST(array() AS array<bigint>)")
    add = lambda got, n: F.concat(got, F.array(F.coalesce(F.try_element_at(got, F.lit(-1)), F.lit(0).cast("bigint")) + n))
    total = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda a, n: a + n)

    def sums(all_: Column) -> Column:
        parts = F.when(F.size(all_) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / STRIDE).cast("int")), lambda k: F.slice(all_, k * STRIDE + 1, STRIDE)))
        carried = lambda parts: F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / STRIDE).cast("int")), lambda k: F.slice(parts, k * STRIDE + 1, STRIDE))

        def inside(part: Column, base: Column) -> Column:
            """Sums before each place of one part, after ``base``."""
            ends = F.aggregate(part, none, add)
            return F.transform(F.zip_with(F.concat(F.array(F.lit(0).cast("bigint")), F.slice(ends, 1, F.size(part) - 1)), part, lambda e, _: e), lambda e: e + base)

        def all_parts(parts: Column) -> Column:
            totals = F.transform(parts, total)
            bases = let(totals, lambda t: let(carried(t), lambda groups: let(F.aggregate(F.transform(groups, total), none, add), lambda ends: F.flatten(F.transform(groups, lambda g, i: inside(g, F.when(i > 0, F.element_at(ends, F.greatest(i, F.lit(1)))).otherwise(0)))))))
            return let(bases, lambda at: F.flatten(F.transform(parts, lambda p, i: inside(p, F.element_at(at, i + 1)))))

        return F.coalesce(let(parts, all_parts), none)

    return let(F.transform(sizes, lambda n: n.cast("bigint")), sums)


def _merge(turns: Column) -> Column:
    """Blocks (role, parts) of adjacent turns with one role: what lies between the places where it changes."""

    def blocks(all_: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(all_))
        starts = F.filter(places, lambda i: (i == 1) | (F.element_at(all_, i).role != F.element_at(all_, F.greatest(i - 1, F.lit(1))).role))

        def cut(starts: Column) -> Column:
            ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(all_) + 1))
            return F.zip_with(starts, ends, lambda i, j: F.struct(F.element_at(all_, i).role.alias("role"), F.transform(F.slice(all_, i, j - i), lambda t: t.text).alias("parts")))

        return let(starts, cut)

    return let(turns, blocks)


def _spans(blocks: Column, learn: str) -> Column:
    """(start, end) of every part that is learned, in code points from 0."""
    extra = len(OPEN) + len(HEAD) + len(CLOSE)
    size = lambda b: extra + F.length(b.role) + F.aggregate(b.parts, -len(PART) * F.lit(1).cast("bigint"), lambda a, t: a + F.length(t) + len(PART))

    def inside(b: Column, at: Column) -> Column:
        first = at + len(OPEN) + F.length(b.role) + len(HEAD)
        before = running(F.transform(b.parts, lambda t: F.length(t) + len(PART)))
        return F.zip_with(before, b.parts, lambda k, t: F.struct((first + k).alias("start"), (first + k + F.length(t)).alias("end")))

    def all_(b: Column) -> Column:
        placed = F.zip_with(b, running(F.transform(b, size)), lambda x, at: F.struct(x.alias("b"), at.alias("at")))
        return F.flatten(F.transform(F.filter(placed, lambda x: x.b.role == learn), lambda x: inside(x.b, x.at)))

    return let(blocks, all_)


def format_chats(turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """(id_col, formatted, loss_spans): one row for each conversation.

    Turns are sorted by ``order_col``, then role, then text, so ties have one order; a null place
    comes first.  Null roles and texts count as empty.  Rows without an id are one conversation
    without an id.  Repeated rows are turns of their own.  ``loss_spans`` are the code points of
    ``formatted`` that hold texts of the role ``learn``.  Other columns are ignored; an empty
    table gives no rows.  A conversation is one string and so one row in one task; its turns are
    combined on the map side first, and it takes time in proportion to its length.
    """
    turn = F.struct(F.col(order_col).alias("place"), escape(F.coalesce(role_col, F.lit(""))).alias("role"), escape(F.coalesce(text_col, F.lit(""))).alias("text"))
    blocks = turns.groupBy(id_col).agg(F.sort_array(F.collect_list(turn)).alias("turns")).select(id_col, _merge(F.col("turns")).alias("blocks"))
    body = F.transform("blocks", lambda b: F.concat(F.lit(OPEN), b.role, F.lit(HEAD), F.array_join(b.parts, PART), F.lit(CLOSE)))
    return blocks.select(id_col, F.array_join(body, "").alias("formatted"), _spans(F.col("blocks"), learn).alias("loss_spans"))


#: Between the marks and what stands between them.
EDGES = "|".join(f"(?<={m})|(?={m})" for m in (r"</s>", r"\[/INST\]", r"\[PART\]"))


def learned(text: Column, spans: Column) -> Column:
    """What ``spans`` say of ``text``, unescaped and joined; a span that is no whole part raises.

    The string is cut once at its marks; pieces and spans, sorted by where they begin, stand next to
    each other.
    """
    pieces = F.filter(F.split(text, EDGES, -1), lambda p: p != "")
    none = F.expr("CAST(array() AS array<struct<at: bigint, kind: int, size: bigint, text: string>>)")

    def read(pieces: Column) -> Column:
        own = F.zip_with(running(F.transform(pieces, F.length)), pieces, lambda at, p: F.struct(at.alias("at"), F.lit(1).alias("kind"), F.length(p).cast("bigint").alias("size"), p.alias("text")))
        marks = F.transform(F.filter(spans, lambda s: s.end > s.start), lambda s: F.struct(s.start.alias("at"), F.lit(0).alias("kind"), (s.end - s.start).alias("size"), F.lit("").alias("text")))

        def found(rows: Column) -> Column:
            def one(i: Column) -> Column:
                span, piece = F.element_at(rows, i), F.element_at(rows, F.least(i + 1, F.size(rows)))
                fits = (piece.kind == 1) & (piece.at == span.at) & (piece.size == span.size)
                return F.when(fits, unescape(piece.text)).otherwise(F.raise_error(F.lit("a span is no part of its text")).cast("string"))

            at = F.filter(F.sequence(F.lit(1), F.size(rows)), lambda i: F.element_at(rows, i).kind == 0)
            return F.array_join(F.transform(at, one), "")

        every = F.array_sort(F.concat(F.coalesce(own, none), F.coalesce(marks, none)))
        return let(every, lambda rows: F.when(F.size(rows) > 0, found(rows)).otherwise(""))

    return let(pieces, read)


def read_chats(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, turns, loss_text, formatted): roles, texts and learned text read from the strings."""
    blocks = F.expr(f"filter(split(formatted, '{CLOSE}', -1), b -> b != '')")

    def turns(block: Column) -> Column:
        sides = F.split(F.substring(block, len(OPEN) + 1, 2**31 - 1), r"\[/INST\]", 2)
        return let(sides, lambda s: F.transform(F.split(s[1], r"\[PART\]", -1), lambda t: F.struct(unescape(s[0]).alias("role"), unescape(t).alias("text"))))

    return formatted.select(id_col, F.flatten(F.transform(blocks, turns)).alias("turns"), learned(F.col("formatted"), F.col("loss_spans")).alias("loss_text"), "formatted")
