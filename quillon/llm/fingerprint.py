"""Document fingerprints: an invertible Bloom lookup sketch of a text's paragraphs, as expressions.

A paragraph ends at a line break or after a sentence's end mark and blank; one of over ``LONG``
characters is cut further where its own words (or, without blanks, characters) say so. Its digest with the
number of its earlier equals (so repeats count) is a key: 48 hash bits and a 16-bit check of
them. A key is added to one cell of each of ``ROWS`` rows; a cell holds the number and the
exclusive or of its keys. The fingerprint lists the cells of a sketch with at least ``EACH`` cells a
row for each of the text's paragraphs; empty cells are not stored.

Subtracting the cells of two versions leaves the keys that differ; peeling takes out keys that are
alone in a cell until nothing is left. Likeness is the share of keys that the versions have in
common. Of two fingerprint strings :func:`likeness_of` gives it: it subtracts and peels them, and
where they are too small for the difference recovers the keys of both and retries with larger
sketches. Over a whole table :func:`compare` does the same: the cells of a pair's fingerprints are
subtracted and peeled (where the fingerprints are of two sizes, the smaller text is sketched at
the larger one's), and a pair that does not peel is taken from a larger sketch, of ``2^56`` cells.

There, cells are rows: they are made, subtracted and peeled by aggregations that stay within the
task that holds a text's digests: first the keys alone in a cell of any row, which settles most
pairs, then, of the others, ``PASSES`` times one row of the sketches after the other. Nothing
but the texts and the digests is shuffled, and what exceeds a task's memory is spilled; as cells take
some 20 times a text's memory, digests are dealt to ``FINER`` times as many tasks as other rows.

Defined results: null text is empty; two texts without paragraphs have likeness 1; rows of one
``doc_id`` follow each other by their texts' hash, null ids come last, repeated rows are each
other's next documents; a table of one row is its own next document; an empty table gives no
rows; very long texts are taken whole; other columns are not read.
"""

from __future__ import annotations

import math
import struct
from collections import defaultdict

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import keyed, text_or_empty, width

#: What ends a paragraph: a line break, or a sentence's end mark and blank.
ENDS = ("\n", ". ", "! ", "? ")
#: Characters from which on a paragraph is cut further, and what marks such a cut meanwhile.
LONG, MARK = 256, "￿"
#: Rows of a fingerprint, those that are peeled, the least exponent of a row's cells, cells for each
#: paragraph, peeling passes. Exponents 0 and 1 are taken (``NOTES``, ``LARGER``), so ``BITS`` is 2 at least.
ROWS = PAIR_ROWS = 3
BITS, EACH, PASSES = 6, 8, 6
FINER = 16
#: A cell's number: 6 bits of exponent or sketch, 2 bits of row, 56 bits of place. Of row 3, the first
#: holds a text's notes, the second the larger sketch; a peeled sketch counts its keys there.
_PLACE = (1 << 56) - 1
NOTES, LARGER = 0, 1
EDITED, NEXT, OWN, NEW = range(4)
_LEFT = "array<struct<cell:bigint,c:bigint,x:bigint,held:int>>"


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _check(high: Column) -> Column:
    return F.xxhash64(high).bitwiseAND(_long(0xFFFF))


def units(text: Column) -> Column:
    """Paragraphs, the long ones cut after one word of 8 or, in words that are long themselves,
    before one character of 64, chosen by hashes of the word or of the 8 characters before."""

    def within(word: Column) -> Column:
        chars = F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0))
        marked = lambda cs: F.transform(cs, lambda c, i: F.when((i >= 8) & (F.pmod(F.xxhash64(F.slice(cs, i - 7, F.lit(8))), F.lit(64)) == 0), F.concat(F.lit(MARK), c)).otherwise(c))
        return F.element_at(F.transform(F.array(chars), lambda cs: F.array_join(marked(cs), "")), 1)

    def word(w: Column) -> Column:
        whole = F.when(F.char_length(w) > LONG, within(w)).otherwise(w)
        return F.when(F.pmod(F.xxhash64(F.rtrim(w)), F.lit(8)) == 0, F.concat(whole, F.lit(MARK))).otherwise(whole)

    cut_up = lambda u: F.split(F.array_join(F.transform(F.split(u, r"(?<=\s)(?=\S)"), word), ""), MARK)
    shorter = lambda parts: F.when(F.exists(parts, lambda u: F.char_length(u) > LONG), F.flatten(F.transform(parts, lambda u: F.when(F.char_length(u) > LONG, cut_up(u)).otherwise(F.array(u))))).otherwise(parts)
    marked = text
    for end in ENDS:
        marked = F.replace(marked, F.lit(end), F.lit(end + MARK))
    return F.filter(F.element_at(F.transform(F.array(F.split(marked, MARK)), shorter), 1), lambda u: u != "")


def digests(text: Column) -> Column:
    return F.transform(units(text), lambda u: F.xxhash64(u))


def _key(digest: Column, number: Column) -> Column:
    high = F.shiftrightunsigned(F.xxhash64(digest, number.cast("long")), 16)
    return F.shiftleft(high, 16).bitwiseOR(_check(high))


def _place(key: Column, row: Column | int, bits: Column) -> Column:
    """The cell of ``row`` that a key goes to, of ``2^bits``."""
    return F.xxhash64(key, _long(row) if isinstance(row, int) else row).bitwiseAND(F.call_function("shiftleft", _long(1), bits.cast("int")) - 1)


def _cell(top: Column | int, row: int, place: Column) -> Column:
    return (_long((top * 4 + row) << 56) if isinstance(top, int) else F.shiftleft(top * 4 + row, 56)).bitwiseOR(place)


def _bits(n: Column) -> Column:
    return F.greatest(F.lit(BITS), F.ceil(F.log2(F.greatest(n, F.lit(1)) * EACH)).cast("int")).cast("long")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``b, r, doc_id, text, own, next_text, after``: the text of the next document in descending key
    order, after the last that of the first, and the digests of both. Documents are dealt to ranges of the key (``b``; ``r`` counts
    within), and the first of each range also goes to the end of the range before it, so one shuffle
    of the texts does it."""
    low = -(1 << 63)
    src = keyed(docs, key, text).select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    ids = keyed(docs, key).select(F.coalesce(F.col(key).cast("long"), F.lit(low)).alias("k"))
    n = width(docs.sparkSession)
    cuts = sorted(set(ids.agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 10_000).alias("c")).first()["c"] or []))
    bucket = _bucket(cuts, F.col("k"))
    tops = sorted((r["b"], r["k"]) for r in ids.groupBy(bucket.alias("b")).agg(F.max("k").alias("k")).collect())  # a row for each range
    # descending: the range before is the next higher one; the highest is followed by the lowest
    to = {k: (tops[i + 1][0] if i + 1 < len(tops) else tops[0][0]) for i, (_, k) in enumerate(tops)}
    pairs = [F.lit(x) for p in sorted(to.items()) for x in p]
    copy = F.try_element_at(F.create_map(*pairs), F.col("k")) if pairs else F.lit(None).cast("int")
    row = src.withColumn("k", F.coalesce("doc_id", F.lit(low))).withColumn("b", bucket)
    ways = F.filter(F.array(F.struct(F.col("b").cast("int").alias("b"), F.lit(0).alias("late")), F.struct(copy.alias("b"), F.lit(1).alias("late"))), lambda w: w["b"].isNotNull())
    dealt = row.select("doc_id", "text", "k", F.explode(ways).alias("w")).select("doc_id", "text", "k", "w.b", "w.late", F.xxhash64("text").alias("h"))
    after = Window.partitionBy("b").orderBy("late", F.desc("k"), "h")
    placed = dealt.repartitionById(max(1, len(cuts) + 1), F.col("b")).withColumn("own", digests(F.col("text")))
    lead = [F.lead(c).over(after).alias(name) for c, name in (("text", "next_text"), ("own", "after"))]
    return placed.select("b", F.row_number().over(after).alias("r"), "doc_id", "text", "own", "late", *lead).filter("late = 0").drop("late")


def _bucket(cuts: list[int], k: Column) -> Column:
    """How many of the sorted ``cuts`` are below ``k``, in two steps of about their root each."""
    below = lambda some: F.size(F.filter(some, lambda c: c < k))
    each = max(1, math.isqrt(len(cuts)))
    parts = [cuts[i : i + each] for i in range(0, len(cuts), each)]
    if not parts:
        return F.lit(0)
    lists = lambda p: F.array(*map(F.lit, p))
    full = F.greatest(below(lists([p[0] for p in parts])) - 1, F.lit(0))  # parts that begin below, but the last
    return full * each + below(F.get(F.array(*map(lists, parts)), full))


def edited(text: Column, next_text: Column) -> Column:
    """The last half of ``text`` replaced by as much of the beginning of ``next_text``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(next_text, F.lit(1), half))


def _paragraphs(rows: DataFrame) -> DataFrame:
    """``b, g, kind, d, n0, n1, n2``: digests of the texts' paragraphs (kind 0) and how often each
    occurs (0: own, 1: edited, 2: next text), and notes of the text (kinds from 3 on). ``g`` is the
    row and the exponents of its four sketches, in six bits each."""
    new = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    new = new.withColumn("sha", F.sha2("edited", 256))
    words = [F.conv(F.substring("sha", 16 * i + 1, 16), 16, -10).cast("long") for i in range(4)]
    known = new.select("b", "r", "own", digests(F.col("edited")).alias("new"), "after", F.array(F.char_length("text").cast("long"), F.coalesce("doc_id", _long(0)), F.col("doc_id").isNull().cast("long"), *words).alias("notes"))
    own, new_, after = F.size("own"), F.size("new"), F.size("after")
    sizes = [_bits(F.greatest(own, new_)), _bits(F.greatest(own, after)), _bits(own), _bits(new_)]
    g = F.shiftleft(F.col("r").cast("long"), 24)
    for i, s in enumerate(sizes):
        g = g.bitwiseOR(F.shiftleft(s, 6 * i))
    notes = F.concat(F.col("notes"), F.array(own.cast("long")))
    sides = F.array(*[F.struct(F.lit(i).alias("side"), c.alias("d")) for i, c in enumerate((F.col("own"), F.col("new"), F.col("after"), notes))])
    dealt = known.select("b", g.alias("g"), sides.alias("sides")).repartition(FINER * width(rows.sparkSession), "b", "g")
    each = dealt.select("b", "g", F.explode("sides").alias("s")).select("b", "g", F.col("s.side").alias("side"), F.posexplode("s.d").alias("i", "d"))
    counts = [F.sum((F.col("side") == i).cast("long")).alias(f"n{i}") for i in range(3)]
    return each.withColumn("kind", F.when(F.col("side") == 3, F.col("i") + 3).otherwise(0)).groupBy("b", "g", "kind", "d").agg(*counts)


def _exponent(sketch: int) -> Column:
    return F.shiftright("g", 6 * sketch).bitwiseAND(_long(63))


def _sketched(paragraphs: DataFrame) -> DataFrame:
    """``b, g, cell`` and of each text the cell's number and keys, ``c0, x0`` to ``c2, x2``: the
    fingerprints, at each exponent that is needed, the larger sketch, and the notes."""
    most = F.greatest("n0", "n1", "n2")
    numbered = paragraphs.select("b", "g", "kind", "d", "n0", "n1", "n2", F.explode(F.when(most <= 1, F.array(_long(0))).otherwise(F.sequence(_long(0), most - 1))).alias("i"))
    has = [F.col("i") < F.col(f"n{i}") for i in range(3)]
    keys = numbered.select("b", "g", "kind", *[h.cast("long").alias(f"h{i}") for i, h in enumerate(has)], F.when(F.col("kind") == 0, _key(F.col("d"), F.col("i"))).otherwise(F.col("d")).alias("x"))
    edited_, next_, own, new = map(_exponent, (EDITED, NEXT, OWN, NEW))
    when = lambda i, *es: [F.when(F.col(f"h{i}") == 1, e) for e in es]
    needed = F.array_distinct(F.array_compact(F.array(*when(0, own, edited_, next_), *when(1, new, edited_), *when(2, next_))))
    sizes = F.when(F.col("kind") > 0, F.array(_long(NOTES))).otherwise(F.concat(F.array(_long(LARGER)), F.when((own == new) & (own == next_), F.array(own)).otherwise(needed)))
    sized = keys.select("*", F.explode(sizes).alias("e"))
    x, e = F.col("x"), F.col("e")
    note = F.array(_cell(NOTES, 3, F.col("kind").cast("long") - 3))
    larger = F.array(_cell(LARGER, 3, F.xxhash64(x, _long(3)).bitwiseAND(_long(_PLACE))))
    at = F.when(e == NOTES, note).when(e == LARGER, larger).otherwise(F.array(*[_cell(e, row, _place(x, row, e)) for row in range(ROWS)]))
    cells = sized.select("b", "g", "kind", "x", "h0", "h1", "h2", F.explode(at).alias("cell"))
    held = [F.when((F.col(f"h{i}") == 1) | (F.col("kind") > 0), x).otherwise(_long(0)) for i in range(3)]
    return cells.groupBy("b", "g", "cell").agg(*[F.sum(f"h{i}").alias(f"c{i}") for i in range(3)], *[F.bit_xor(held[i]).alias(f"x{i}") for i in range(3)])


def _alone(sketch: int, c: Column, x: Column, row: Column | int, place: Column) -> Column:
    """Whether a cell of a subtraction, ``place`` of ``row``, holds one key, that goes there."""
    return (F.abs(c) == 1) & (x.bitwiseAND(_long(0xFFFF)) == _check(F.shiftrightunsigned(x, 16))) & (_place(x, row, _exponent(sketch)) == place)


def _subtracted(cells: DataFrame) -> DataFrame:
    """``b, g, rest, cell, c, x``: of each pair's fingerprints, subtracted, what is left when the keys
    alone in a cell of any row are out, and one row with ``rest``: notes, both fingerprints, how many
    keys are out, and what the larger sketch says of the pairs.

    A cell with one key is empty once the key is out, so only cells with more are kept. Nothing is
    left if a row's number and exclusive or are those of the keys that are out."""
    cell = F.col("cell")
    top = F.shiftrightunsigned(cell, 56)
    e, row, place = F.shiftrightunsigned(top, 2), top.bitwiseAND(_long(3)), cell.bitwiseAND(_long(_PLACE))
    names = {EDITED: "e", NEXT: "n"}
    at = cells.select("*", e.alias("e"), row.alias("row"), place.alias("place"), (top == LARGER * 4 + 3).alias("larger"))
    for i, s in ((1, EDITED), (2, NEXT)):
        at = at.withColumns({f"{names[s]}c": F.col("c0") - F.col(f"c{i}"), f"{names[s]}x": F.col("x0").bitwiseXOR(F.col(f"x{i}")), f"{names[s]}here": (F.col("row") < PAIR_ROWS) & (F.col("e") == _exponent(s))})
    row, place = F.col("row"), F.col("place")
    known = {f"{n}alone": F.when(F.col(f"{n}here"), _alone(s, F.col(f"{n}c"), F.col(f"{n}x"), row, place)).otherwise(False) for s, n in names.items()}
    at = at.withColumns(known)

    def text(sketch: int, i: int) -> Column:
        index = F.call_function("shiftleft", row, _exponent(sketch).cast("int")) + place
        written = F.concat_ws(".", F.hex(index), F.hex(f"c{i}"), F.hex(f"x{i}"))
        return F.when((row < ROWS) & (F.col("e") == _exponent(sketch)) & (F.col(f"c{i}") > 0), F.struct(index.alias("i"), written.alias("t")))

    columns = {f"note{i}": F.max(F.when(cell == (NOTES * 4 + 3 << 56 | i), F.col("x0"))) for i in range(8)}
    columns |= {"own": F.collect_list(text(OWN, 0)), "new": F.collect_list(text(NEW, 1))}
    for s, n in names.items():
        here, c, x, alone = (F.col(n + what) for what in ("here", "c", "x", "alone"))
        for i, sign in enumerate((1, -1)):
            columns[f"{n}{i}"] = F.coalesce(F.sum(F.when(F.col("larger") & (c * sign > 0), c * sign)), _long(0))
            columns[f"{n}keys{i}"] = F.collect_list(F.when(alone & (c == sign), x))
        columns[f"{n}c"] = F.coalesce(F.sum(F.when(here & (row == 0), c)), _long(0))
        columns[f"{n}x"] = F.coalesce(F.bit_xor(F.when(here & (row == 0), x)), _long(0))
        many = here & ~alone & ((c != 0) | (x != 0))
        columns[f"{n}many"] = F.collect_list(F.when(many, F.struct(F.shiftleft(row + s * 4, 56).bitwiseOR(place).alias("cell"), c.alias("c"), x.alias("x"), F.lit(1).alias("held"))))
    got = at.groupBy("b", "g").agg(*[c.alias(name) for name, c in columns.items()])
    got = got.withColumns({"own": _text(F.col("own"), _exponent(OWN)), "new": _text(F.col("new"), _exponent(NEW)), **{f"{n}keys{i}": F.array_distinct(f"{n}keys{i}") for n in names.values() for i in (0, 1)}})
    got = got.withColumns({f"{n}out{i}": F.size(f"{n}keys{i}").cast("long") for n in names.values() for i in (0, 1)})
    rest = F.struct(*[f"note{i}" for i in range(8)], "own", "new", *[f"{n}{what}{i}" for n in names.values() for what in ("", "out") for i in (0, 1)])
    none = F.array(F.struct(F.lit(None).cast("long").alias("cell"), _long(0).alias("c"), _long(0).alias("x"), F.lit(1).alias("held")))

    def left(s: int) -> Column:
        n = names[s]
        both = F.concat(f"{n}keys0", f"{n}keys1")
        nothing = (F.col(f"{n}c") == F.col(f"{n}out0") - F.col(f"{n}out1")) & (F.col(f"{n}x") == F.aggregate(both, _long(0), lambda a, k: a.bitwiseXOR(k)))
        out = lambda c: lambda k: F.array(*[F.struct(_cell(s, r, _place(k, r, _exponent(s))).alias("cell"), _long(c).alias("c"), k.alias("x"), F.lit(0).alias("held")) for r in range(PAIR_ROWS)])
        taken = [F.flatten(F.transform(f"{n}keys{i}", out(c))) for i, c in ((0, -1), (1, 1))]
        return F.when(nothing, F.array().cast(_LEFT)).otherwise(F.concat(f"{n}many", *taken))

    each = got.select("b", "g", rest.alias("rest"), F.explode(F.concat(none, left(EDITED), left(NEXT))).alias("w"))
    each = each.select("b", "g", F.when(F.col("w.cell").isNull(), F.col("rest")).alias("rest"), "w.cell", "w.c", "w.x", "w.held")
    summed = each.groupBy("b", "g", "rest", "cell").agg(F.sum("c").alias("c"), F.bit_xor("x").alias("x"), F.max("held").alias("held"))
    return summed.filter("rest is not null or (held = 1 and (c <> 0 or x <> 0))").drop("held")


def _peeled(cells: DataFrame, row: int) -> DataFrame:
    """Keys alone in a cell of ``row`` of a subtraction go out of all their cells into its notes:
    place 0 counts those of the first text, place 1 those of the second."""
    cell, c, x = F.col("cell"), F.col("c"), F.col("x")
    top = F.shiftrightunsigned(cell, 56)
    sketch = F.shiftrightunsigned(top, 2)
    bits = F.when(sketch == EDITED, _exponent(EDITED)).otherwise(_exponent(NEXT))
    place = cell.bitwiseAND(_long(_PLACE))
    alone = (top.bitwiseAND(_long(3)) == row) & F.when(sketch == EDITED, _alone(EDITED, c, x, row, place)).otherwise((sketch == NEXT) & _alone(NEXT, c, x, row, place))
    out = [F.struct(F.shiftleft(sketch * 4 + other, 56).bitwiseOR(_place(x, other, bits)).alias("cell"), (-c).alias("c"), x.alias("x")) for other in range(PAIR_ROWS) if other != row]
    found = F.struct(F.shiftleft(sketch * 4 + 3, 56).bitwiseOR(F.when(c > 0, _long(0)).otherwise(_long(1))).alias("cell"), _long(1).alias("c"), _long(0).alias("x"))
    stays = F.struct("cell", "c", "x")
    dealt = cells.select("b", "g", "rest", F.explode(F.when(alone, F.array(found, *out)).otherwise(F.array(stays))).alias("w")).select("b", "g", "rest", "w.cell", "w.c", "w.x")
    return dealt.groupBy("b", "g", "rest", "cell").agg(F.sum("c").alias("c"), F.bit_xor("x").alias("x")).filter("rest is not null or c <> 0 or x <> 0")


def _text(cells: Column, bits: Column) -> Column:
    """``exponent:cell.number.keys,...``, all hexadecimal, of cells' numbers ``i`` and texts ``t``."""
    each = F.transform(F.sort_array(cells), lambda s: s["t"])
    return F.lower(F.concat(F.lpad(F.hex(bits), 2, "0"), F.lit(":"), F.array_join(each, ",")))


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness: ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    cells = _subtracted(_sketched(_paragraphs(with_next(docs))))
    for i in range(PASSES):
        cells = _peeled(cells, i % PAIR_ROWS)
    cell, c = F.col("cell"), F.col("c")
    top = F.shiftrightunsigned(cell, 56)
    peeled = [F.coalesce(F.sum(F.when(cell == (s * 4 + 3 << 56 | i), c)), _long(0)).alias(f"{name}{i}") for s, name in ((EDITED, "e"), (NEXT, "n")) for i in (0, 1)]
    left = [F.count(F.when((F.shiftrightunsigned(top, 2) == s) & (top.bitwiseAND(_long(3)) < PAIR_ROWS), 1)).alias(f"{name}left") for s, name in ((EDITED, "e"), (NEXT, "n"))]
    got = cells.groupBy("b", "g").agg(F.first("rest", ignorenulls=True).alias("rest"), *peeled, *left)

    def likeness(name: str) -> Column:
        first, second = (F.when(F.col(f"{name}left") == 0, F.col(f"{name}{i}") + F.col(f"rest.{name}out{i}")).otherwise(F.col(f"rest.{name}{i}")) for i in (0, 1))
        common = F.col("rest.note7") - first
        total = common + first + second
        return F.when(total == 0, 1.0).otherwise(common / total)

    sha = F.lower(F.concat(*[F.lpad(F.hex(f"rest.note{i}"), 16, "0") for i in range(3, 7)]))
    return got.select(
        F.when(F.col("rest.note2") == 0, F.col("rest.note1")).alias("doc_id"),
        F.col("rest.note0").alias("n_chars"),
        sha.alias("edited_sha256"),
        F.col("rest.own").alias("fingerprint"),
        F.col("rest.new").alias("edited_fingerprint"),
        likeness("e").alias("near_edited"),
        likeness("n").alias("near_next"),
    )


# ---- for a reader who holds two fingerprints


def _hash(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(data, seed)


def _cells(key: int, bits: int) -> list[int]:
    first = _hash(struct.pack("<Q", key))
    return [(r << bits) + (_hash(struct.pack("<q", r), first) & (1 << bits) - 1) for r in range(ROWS)]


def parsed(fingerprint: str) -> tuple[int, dict[int, tuple[int, int]]]:
    """(exponent, cells that are not empty: number and keys)."""
    bits, _, cells = fingerprint.partition(":")
    each = [tuple(int(x, 16) for x in cell.split(".")) for cell in cells.split(",") if cell]
    return int(bits, 16), {i: (n, k) for i, n, k in each}


def sketch(keys: set[int], bits: int) -> dict[int, tuple[int, int]]:
    out: dict[int, tuple[int, int]] = {}
    for k in keys:
        for i in _cells(k, bits):
            n, x = out.get(i, (0, 0))
            out[i] = n + 1, x ^ k
    return out


def peel(a: dict[int, tuple[int, int]], b: dict[int, tuple[int, int]], bits: int) -> tuple[set[int], set[int]] | None:
    """The keys only in either of two sketches; None if they do not peel."""
    left = defaultdict(lambda: (0, 0), a)
    for i, (n, x) in b.items():
        left[i] = left[i][0] - n, left[i][1] ^ x
    found: dict[int, set[int]] = {1: set(), -1: set()}
    todo = list(left)
    while todo:
        i = todo.pop()
        n, k = left[i]
        if n in found and _hash(struct.pack("<Q", k >> 16)) & 0xFFFF == k & 0xFFFF and i in (at := _cells(k, bits)) and k not in found[n]:
            found[n].add(k)
            for j in at:
                left[j] = left[j][0] - n, left[j][1] ^ k
            todo += at
    return None if any(map(any, left.values())) else (found[1], found[-1])


def keys_of(fingerprint: str) -> set[int]:
    """All keys of a text, from its fingerprint alone."""
    bits, cells = parsed(fingerprint)
    if (all_ := peel(cells, {}, bits)) is None:
        raise ValueError("the fingerprint's cells do not peel")
    return all_[0]


def likeness_of(a: str, b: str) -> float:
    """The likeness of two texts from their fingerprints; :class:`ValueError` where one of them holds
    keys that share all their cells (by calculation 1 in 10,000 at 8 paragraphs, fewer at other numbers)."""
    (bits, cells), (other, more) = parsed(a), parsed(b)
    differ = peel(cells, more, bits) if bits == other else None
    if differ is None:
        left, right = keys_of(a), keys_of(b)
        bits = max(bits, other)
        while differ is None:
            bits += 1
            differ = peel(sketch(left, bits), sketch(right, bits), bits)
    n = sum(k for i, (k, _) in cells.items() if i < 1 << parsed(a)[0])
    common = n - len(differ[0])
    total = common + len(differ[0]) + len(differ[1])
    return common / total if total else 1.0
