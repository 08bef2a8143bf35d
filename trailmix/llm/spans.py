"""Places of pattern matches, inside the JVM, in time linear in the text and its matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACE = "array<struct<start:int,end:int,value:string,before:string>>"
# An array that grows by one copies itself each time, so arrays are built in blocks of this length.
BLOCK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is mentioned."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, first: Column, fold: Callable, emit: Callable, kind: str) -> Column:
    """For each item, ``emit(state, item)``, where ``fold(state, item)`` is the state of the next one.

    The states at the blocks' starts come first, each block is then run on its own. ``kind`` is the
    type of the result; an empty or null array gives an empty one.
    """
    empty = F.array().cast(kind)
    last = F.floor((F.size(items) - 1) / BLOCK).cast("int")

    def block_states(blocks):
        def step(state, block):
            return F.struct(F.aggregate(block, state["now"], fold).alias("now"), F.concat(state["out"], F.array(state["now"])).alias("out"))

        return F.aggregate(blocks, F.struct(first.alias("now"), F.slice(F.array(first), 1, 0).alias("out")), step, lambda s: s["out"])

    def run(block, start):
        def step(state, item):
            return F.struct(fold(state["now"], item).alias("now"), F.concat(state["out"], F.array(emit(state["now"], item))).alias("out"))

        return F.aggregate(block, F.struct(start.alias("now"), empty.alias("out")), step, lambda s: s["out"])

    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(items) > 0, let(blocks, lambda b: F.flatten(F.zip_with(b, block_states(b), run)))).otherwise(empty)


def spans(text: Column, pattern: str, context: int = 40) -> Column:
    """Leftmost non-overlapping matches as (start, end, value, before), in code points, end exclusive.

    ``before`` is the text before the match, back to the last one, ``context`` code points at most. The
    pieces between matches give the places, so the text is searched twice and never sorted or moved.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    pairs = F.filter(F.arrays_zip(pieces.alias("p"), found.alias("m")), lambda x: x["m"].isNotNull())

    def start(at, pair):
        return at + F.char_length(pair["p"])

    def end(at, pair):
        return start(at, pair) + F.char_length(pair["m"])

    def place(at, pair):
        return F.struct(start(at, pair).alias("start"), end(at, pair).alias("end"), pair["m"].alias("value"),
                        F.substring(pair["p"], -context, context).alias("before"))

    return F.coalesce(let(pairs, lambda p: running(p, F.lit(0), end, place, PLACE)), F.array().cast(PLACE))


def apart(items: Column, others: Column) -> Column:
    """The items that overlap none of the others; both have ``start``, ``end`` and the same type.

    All are put in one order, others by their start and items by their end, and the farthest end of an
    other so far tells whether the item reaches into it.
    """
    def event(key, other):
        return lambda x: F.struct(x[key].alias("at"), F.lit(other).alias("other"), x["start"].alias("start"), x["end"].alias("end"), x.alias("x"))

    def kept(events):
        clear = running(events, F.lit(-1), lambda far, e: F.when(e["other"] == 1, F.greatest(far, e["end"])).otherwise(far),
                        lambda far, e: (e["other"] == 0) & (far <= e["start"]), "array<boolean>")
        return F.transform(F.filter(F.arrays_zip(events.alias("e"), clear.alias("clear")), lambda z: z["clear"]), lambda z: z["e"]["x"])

    # at the same place an item ends before an other begins
    both = F.array_sort(F.concat(F.transform(items, event("end", 0)), F.transform(others, event("start", 1))))
    return F.when((F.size(items) > 0) & (F.size(others) > 0), let(both, kept)).otherwise(items)
