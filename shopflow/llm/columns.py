"""Array and text functions whose work grows in proportion to their input, made of Spark's own functions.

Arrays may be empty, not null; elements are not null. Text offsets are code points.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block of a running sum, and code points of a cell of a text that is cut.
BLOCK, CELL = 128, 1024


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def running(x: Column, join) -> Column:
    """Running sums, or what ``join`` does, of an array of integers: within blocks, and then over blocks, since adding to an array copies it."""
    empty = F.expr("named_struct('at', cast(null AS int), 'out', cast(array() AS array<int>))")
    add = lambda acc, v: F.struct(v.alias("at"), F.concat(acc["out"], F.array(v)).alias("out"))
    onto = lambda acc, v: F.when(acc["at"].isNull(), v).otherwise(join(acc["at"], v))

    def scan(values: Column) -> Column:
        return F.aggregate(values, empty, lambda acc, v: let(onto(acc, v), lambda t: add(acc, t)))["out"]

    def blocks(x: Column) -> Column:
        own = lambda k: F.transform(F.sequence(k * BLOCK, F.least(F.size(x), (k + 1) * BLOCK) - 1), lambda i: F.get(x, i))
        return F.transform(F.sequence(F.lit(0), ((F.size(x) - 1) / BLOCK).cast("int")), lambda k: scan(own(k)))

    def whole(parts: Column) -> Column:
        ends = scan(F.transform(parts, lambda p: F.element_at(p, -1)))
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(F.transform(p, lambda v: join(F.get(e, k - 1), v))))))

    none = F.expr("cast(array() AS array<int>)")
    return let(x, lambda x: F.when(F.size(x) > 0, let(blocks(x), whole)).otherwise(none))


def cells(text: Column) -> Column:
    """A text in cells, for ``piece``: finding an offset in the text itself would walk it from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CELL}}}"), F.lit(0))


def piece(cells: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text cut into cells."""
    from_, to = (lambda c: F.greatest(start - c * CELL, F.lit(0))), (lambda c: F.least(end - c * CELL, F.lit(CELL)))
    part = lambda c: F.substr(F.get(cells, c), from_(c) + 1, to(c) - from_(c))
    return F.when(end > start, F.array_join(F.transform(F.sequence((start / CELL).cast("int"), ((end - 1) / CELL).cast("int")), part), "")).otherwise("")
