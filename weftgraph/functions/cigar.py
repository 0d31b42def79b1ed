"""CIGAR strings as columns: arrays of (op, len)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nt import complement


def parse(cigar: Column) -> Column:
    """'3M1I' as an array of structs (op, len)."""
    lengths = F.regexp_extract_all(cigar, F.lit("([0-9]+)([A-Z=])"), F.lit(1))
    ops = F.regexp_extract_all(cigar, F.lit("([0-9]+)([A-Z=])"), F.lit(2))
    return F.zip_with(ops, lengths, lambda o, n: F.struct(o.alias("op"), n.cast("long").alias("len")))


def render(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.concat(r["len"].cast("string"), r["op"])), "")


def total(runs: Column, ops: str) -> Column:
    """Summed length of the runs with one of these operations."""
    return F.aggregate(F.filter(runs, lambda r: F.lit(ops).contains(r["op"])), F.lit(0).cast("long"), lambda a, r: a + r["len"])


def merge_runs(ops: Column) -> Column:
    """An array of single operations as runs; neighbours of one kind are one run."""
    empty = F.array().cast("array<struct<op:string,len:bigint>>")

    def add(acc, op):
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(op.alias("op"), (last["len"] + 1).alias("len"))))
        new = F.concat(acc, F.array(F.struct(op.alias("op"), F.lit(1).cast("long").alias("len"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["op"] == op), longer).otherwise(new)

    return F.aggregate(ops, empty, add)


def summary(runs: Column) -> Column:
    """Matching, block, target and query length, identity without gap length and with it."""
    match, bad, ins, gone = total(runs, "M="), total(runs, "X"), total(runs, "I"), total(runs, "DN")
    gaps = F.size(F.filter(runs, lambda r: F.lit("IDN").contains(r["op"])))
    return F.struct(
        match.alias("mlen"), (match + bad + ins + gone).alias("blen"), (match + bad + gone).alias("tlen"), (match + bad + ins).alias("qlen"),
        (match / F.nullif(match + bad + ins + gone, F.lit(0))).alias("identity"), (match / F.nullif(match + bad + gaps, F.lit(0))).alias("gap_compressed"),
    )


def reverse(runs: Column) -> Column:
    """The runs as seen from the other strand."""
    return F.reverse(runs)


def reverse_differences(text: Column) -> Column:
    """A difference string (':12*ag+ac-t') as seen from the other strand: its parts in reverse order, inserted and
    deleted bases reversed and complemented (brackets around ambiguous ones turn), substituted ones complemented."""
    parts = F.reverse(F.regexp_extract_all(text, F.lit(r"(:[0-9]+|[*+-][A-Za-z\[\]]+)"), F.lit(1)))
    rest = lambda p: complement(p.substr(F.lit(2), F.length(p)))
    sign = lambda p: F.substring(p, 1, 1)
    turned = lambda p: F.when(sign(p) == ":", p).when(sign(p) == "*", F.concat(sign(p), rest(p))).otherwise(F.concat(sign(p), F.translate(F.reverse(rest(p)), "[]", "][")))
    return F.array_join(F.transform(parts, turned), "")
