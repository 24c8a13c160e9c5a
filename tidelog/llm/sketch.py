"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.  DataFrame functions only.

A text's paragraphs (split at line feeds) become 64-bit digests, a repeated paragraph one for each
occurrence.  A sketch has three subtables; every digest is in one cell of each.  A cell
holds the number of its digests, their XOR, and the XOR of a check value.  Two
sketches are compared by subtracting cells and peeling: a cell with one digest left
reveals it, and its removal opens other cells.  When peeling gets stuck, both
texts are sketched sixteen times as large and peeled again.  The recovered digests are
exactly the paragraphs that only one of the texts has; if the largest sketches get stuck too, the digests themselves are compared.

Work on a text is sorting and passes over arrays, so it grows with n log n in its paragraphs.

Defined cases: a null text is empty; an empty text has one empty paragraph; equal texts have equal sketches;
a null doc_id sorts below every other id; rows with the same id follow each other in an order set by
their texts; a table of one row is followed by itself; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Cells of a subtable of the fingerprint.
CELLS = 12
#: A retry has so many times the cells of the attempt before; only those in use are kept.
GROWTH = 16
RETRIES = 5
ROUNDS = 64
CHECK = 1 << 32


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def run_starts(values: Column, field: str | None = None) -> Column:
    """Where the runs of equal values of a sorted array begin."""

    def at(i: Column) -> Column:
        return values[i] if field is None else values[i][field]

    places = F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(values) - 1))
    return F.filter(places, lambda i: (i == 0) | (at(i) != at(F.greatest(i - 1, F.lit(0)))))


def runs(values: Column, field: str | None, body) -> Column:
    """``body(start, length)`` of every run of a sorted array."""
    return let(
        run_starts(values, field),
        lambda starts: F.transform(starts, lambda at, k: body(at, F.coalesce(F.get(starts, k + 1), F.size(values)) - at)),
    )


def digests(text: Column) -> Column:
    """One distinct 64-bit digest per paragraph occurrence."""
    plain = F.sort_array(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.xxhash64(p)))
    return let(plain, lambda s: F.flatten(runs(s, None, lambda at, n: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.xxhash64(s[at], k)))))


def check(x: Column) -> Column:
    return F.pmod(F.xxhash64(x, F.lit(99)), F.lit(CHECK))


def spread(x: Column, n: Column, size: Column) -> Column:
    """A digest's three entries (place, n, digest, check); subtable j has the places j * size to (j + 1) * size - 1."""
    return F.array(*[F.struct((F.pmod(F.xxhash64(x, F.lit(j)), size) + j * size).cast("int").alias("i"), n.alias("n"), x.alias("x"), check(x).alias("h")) for j in range(3)])


def merged(entries: Column) -> Column:
    """Entries of the same place become one cell; cells with nothing left go."""

    def cell(group: Column) -> Column:
        return F.when(F.size(group) == 1, group[0]).otherwise(
            F.aggregate(
                F.slice(group, F.lit(2), F.size(group) - 1),
                group[0],
                lambda c, z: F.struct(c["i"].alias("i"), (c["n"] + z["n"]).alias("n"), c["x"].bitwiseXOR(z["x"]).alias("x"), c["h"].bitwiseXOR(z["h"]).alias("h")),
            )
        )

    def group(s: Column) -> Column:
        return runs(s, "i", lambda at, n: let(F.slice(s, at + 1, n), cell))

    return F.filter(let(F.sort_array(entries), group), lambda c: (c["n"] != 0) | (c["x"] != 0) | (c["h"] != 0))


def cells(keys: Column, size: Column) -> Column:
    """The sketch of digests: the non-empty ones of 3 x size cells, in order of place."""
    return merged(F.flatten(F.transform(keys, lambda x: spread(x, F.lit(1), size))))


def negative(sketch: Column) -> Column:
    return F.transform(sketch, lambda c: F.struct(c["i"].alias("i"), (-c["n"]).alias("n"), c["x"].alias("x"), c["h"].alias("h")))


def difference(a: Column, b: Column) -> Column:
    return merged(F.concat(a, negative(b)))


def peel(diff: Column, size: Column) -> Column:
    """(done, only_a, only_b): how many digests only one side has; done is false if cells remain."""

    def state_of(cells_: Column, a: Column, b: Column, more: Column) -> Column:
        return F.struct(cells_.alias("cells"), a.alias("a"), b.alias("b"), more.alias("more"))

    def remove(state: Column, pure: Column) -> Column:
        left = merged(F.concat(state["cells"], F.flatten(F.transform(pure, lambda z: spread(z["x"], -z["n"], size)))))
        a = F.size(F.filter(pure, lambda z: z["n"] > 0))
        return state_of(left, state["a"] + a, state["b"] + F.size(pure) - a, F.lit(True))

    def step(state: Column, _: Column) -> Column:
        single = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["h"] == check(c["x"])))
        # a digest may be alone in up to three cells
        found = F.sort_array(F.transform(single, lambda c: F.struct(c["x"].alias("x"), c["n"].alias("n"))))
        pure = let(found, lambda f: runs(f, "x", lambda at, _: f[at]))
        return F.when(~state["more"], state).otherwise(
            let(pure, lambda p: F.when(F.size(p) == 0, state_of(state["cells"], state["a"], state["b"], F.lit(False))).otherwise(remove(state, p)))
        )

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        state_of(diff, F.lit(0), F.lit(0), F.lit(True)),
        step,
        lambda s: F.struct((F.size(s["cells"]) == 0).alias("done"), s["a"].alias("only_a"), s["b"].alias("only_b")),
    )


def compared(a: Column, b: Column, keys_a: Column, keys_b: Column, size: int = CELLS) -> Column:
    """(done, only_a, only_b) from two sketches, larger ones being made from the digests where peeling fails, and in the end the digests compared."""

    def again(state: Column, t: Column) -> Column:
        larger = (F.lit(size) * F.pow(F.lit(float(GROWTH)), t)).cast("int")
        return F.when(state["done"], state).otherwise(let(larger, lambda s: peel(difference(cells(keys_a, s), cells(keys_b, s)), s)))

    def settled(state: Column) -> Column:
        only = F.struct(F.lit(True).alias("done"), F.size(F.array_except(keys_a, keys_b)).alias("only_a"), F.size(F.array_except(keys_b, keys_a)).alias("only_b"))
        return F.when(state["done"], state).otherwise(only)

    return F.aggregate(F.sequence(F.lit(1), F.lit(RETRIES)), peel(difference(a, b), F.lit(size)), again, settled)


def likeness(found: Column, size_a: Column, size_b: Column) -> Column:
    """Shared paragraphs over all paragraphs, occurrences counted."""

    def share(f: Column) -> Column:
        apart, total = f["only_a"] + f["only_b"], size_a + size_b
        return (total - apart) / (total + apart)

    return let(found, share)


def written(sketch: Column) -> Column:
    """The cells as text: place, count, XOR of digests, XOR of checks."""
    return F.lower(F.array_join(F.transform(sketch, lambda c: F.concat_ws(":", F.hex(c["i"]), F.hex(c["n"]), F.hex(c["x"]), F.hex(c["h"]))), ","))


def below(splits: list[int], key: Column) -> Column:
    """How many of the descending ``splits`` are at least ``key``, by binary search."""
    if not splits:
        return F.lit(0)
    values = F.array(*[F.lit(s).cast("bigint") for s in splits])
    state = F.struct(F.lit(0).alias("lo"), F.lit(len(splits)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        return let(
            F.floor((s["lo"] + s["hi"]) / 2).cast("int"),
            lambda mid: F.when(s["lo"] >= s["hi"], s).when(F.get(values, mid) >= key, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi"))),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(int(math.log2(len(splits))) + 2)), state, halve, lambda s: s["lo"])


def with_next(docs: DataFrame, key: str, tie: str, columns) -> DataFrame:
    """Rows in descending ``key`` order, each with ``next_<column>`` of the row after it, the first following the last.

    Ids are dealt into ranges cut at actual ids, so a range's boundary row is known by its id and is
    copied into the range above: one shuffle, and no global sort in one task.
    """
    spark = docs.sparkSession
    n = common.partitions(spark) * 2
    low = docs.agg(F.max(key).alias("top"), F.percentile_approx(F.when(F.col(key) > -(2**63), F.col(key)), [i / n for i in range(1, n)], 20 * n).alias("splits")).first()
    splits = sorted(set(low["splits"] or []), reverse=True)
    at = below(splits, F.col(key))
    split = F.array(*[F.lit(s).cast("bigint") for s in splits]) if splits else F.array().cast("array<bigint>")
    spots = F.array(
        F.struct(F.col("_at").alias("range"), F.lit(0).alias("copy")),
        F.when(F.get(split, F.col("_at") - 1) == F.col(key), F.struct((F.col("_at") - 1).alias("range"), F.lit(1).alias("copy"))),
        F.when(F.col(key) == F.lit(low["top"]), F.struct(F.lit(len(splits)).alias("range"), F.lit(2).alias("copy"))),
    )
    dealt = docs.withColumn("_at", at).withColumn("_spot", F.explode(F.filter(spots, lambda s: s.isNotNull()))).select(*docs.columns, "_spot.range", "_spot.copy")
    rows = columns(dealt.repartition("range"))
    w = Window.partitionBy("range").orderBy("copy", F.desc(key), F.desc(tie))
    names = [c for c in rows.columns if c not in ("range", "copy", key, tie)]
    return rows.select(*rows.columns, *[F.lead(c).over(w).alias(f"next_{c}") for c in names]).where("copy = 0").drop("range", "copy")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint: one row per input row."""
    return docs.select(common.long_column(docs, doc_id).alias("doc_id"), written(cells(digests(common.text_column(docs, text)), F.lit(CELLS))).alias("fingerprint"))


def versions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited version, and their likenesses; one row per input row.

    Edited: the last third of the code points is replaced by as many first ones of the next document in descending id order.
    """
    body = F.coalesce(common.text_column(docs, text), F.lit(""))
    ident = common.long_column(docs, doc_id)
    rows = docs.select(F.coalesce(ident, F.lit(-(2**63))).alias("key"), F.xxhash64(body).alias("tie"), ident.alias("doc_id"), body.alias("text"))

    def sketched(df: DataFrame) -> DataFrame:
        return df.withColumn("keys", digests(F.col("text"))).withColumn("cells", cells(F.col("keys"), F.lit(CELLS)))

    pairs = with_next(rows, "key", "tie", sketched)
    n, third = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = pairs.select("doc_id", n.cast("bigint").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)).alias("edited"), "keys", "cells", "next_keys", "next_cells")
    edited = edited.withColumn("edited_keys", digests(F.col("edited"))).withColumn("edited_cells", cells(F.col("edited_keys"), F.lit(CELLS)))

    def near(other: str) -> Column:
        return likeness(compared(F.col("cells"), F.col(f"{other}_cells"), F.col("keys"), F.col(f"{other}_keys")), F.size("keys"), F.size(f"{other}_keys"))

    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("cells")).alias("fingerprint"),
        written(F.col("edited_cells")).alias("edited_fingerprint"),
        near("edited").alias("near_edited"),
        near("next").alias("near_next"),
    )
