"""Repeat labels, motifs and texts of key=value pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: labels of repeats and the classes that tables group them by
CLASSES = {
    "11_VNTR": ["mini"],
    "12_STR": ["micro"],
    "13_Other-LCR": ["lcr"],
    "02_L1": ["LINE/L1", "LINE/L1HS"],
    "01_Alu": ["SINE/Alu", "SINE/AluY"],
    "03_SVA": ["Retroposon/SVA"],
    "04_ERV": ["LTR/ERV"],
    "10_Satellite": ["alpha", "hsat2/3", "_sat"],
    "30_Low-repeat": ["self", "none", "partial"],
    "21_SegDup": ["segdup"],
    "05_Other-TE": ["inter"],
}
PREFIXES = {"05_Other-TE": "^(DNA|LINE|SINE|LTR)", "10_Satellite": "^Satellite"}
OTHER = "20_Other-repeat"


def repeat_class(label: Column) -> Column:
    """The class of a repeat's label: by name, then by what it begins with."""
    names = F.create_map(*[F.lit(x) for name, labels in CLASSES.items() for label_ in labels for x in (label_, name)])
    found = F.try_element_at(names, label)
    for name, pattern in PREFIXES.items():
        found = F.coalesce(found, F.when(label.rlike(pattern), F.lit(name)))
    return F.coalesce(found, F.lit(OTHER))


def class_label(name: Column) -> Column:
    """A class without the number that orders it."""
    return F.regexp_replace(name, "^[0-9]+_", "")


def motif_forms(motif: str) -> tuple[list[str], list[str]]:
    """The rotations of a motif and of its reverse complement, and all texts one base away from one of them."""
    both = (motif, motif[::-1].translate(str.maketrans("ACGT", "TGCA")))
    forms = sorted({m[k:] + m[:k] for m in both for k in range(len(m))})
    near = sorted({m[:k] + b + m[k + 1 :] for m in forms for k in range(len(m)) for b in "ACGT" if b != m[k]})
    return forms, near


def motif_kind(seq: Column, motif: str) -> Column:
    """'motif' for a form of it, 'mutant' for a text one base away from one, else null."""
    forms, near = motif_forms(motif)
    return F.when(seq.isin(forms), "motif").when(seq.isin(near), "mutant")


def info(text: Column) -> Column:
    """'A=1;B=x,y' as a map; entries without '=' have a null value."""
    return F.str_to_map(text, F.lit(";"), F.lit("="))


def walk_intervals(walk: Column) -> Column:
    """'>a:3-9<b:0-4' as an array of (rev, name, st, en)."""
    part = lambda k: F.regexp_extract_all(walk, F.lit(r"([><])([^\s><]+):([0-9]+)-([0-9]+)"), F.lit(k))
    rows = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), part(4).alias("d"))
    return F.transform(rows, lambda x: F.struct((x["a"] == "<").alias("rev"), x["b"].alias("name"), x["c"].cast("long").alias("st"), x["d"].cast("long").alias("en")))
