"""Audit of how filters interact: what each removes, in every order, with duplicates found by partition refinement.

Five filters fail a document: A under 200 words; B fewer than half of its words distinct; C over 2 % capitals; D any of
`#$%&*|`; E a text identical to that of a smaller doc_id anywhere in the table. A to D come from the text alone. E is
partition refinement: classes of equal code-point length are split by the hash of the texts' first block, then by that of
the next one, and so on; after each split, classes of one row are dropped. Blocks grow eightfold, so a text has about
log8(length) of them, and a round carries one narrow row for each document that is left, without its text. The texts of
the surviving classes alone are compared in full: equal ones are grouped, within each task first, so a hot group of
copies sends one text from a task. Rows are marked that are not of their group's least id.

Counts by part and mask of failed filters, 32 at most a part, say everything about all 120 orders: a filter removes at
its step what fails it and none of those before.

The first pass over the texts writes the narrow rows to the shared folder; each round of refinement writes its survivors
there. Which texts can be in a surviving class is told in the second pass by a bitmap of FILTER_BITS bits, 8 MB whatever
the corpus; where it lets others pass, their texts are grouped alone and change nothing.

Defined results: null texts are empty ones and copies of each other; a null source counts as ''; rows without a doc_id
are counted, and are never smaller nor marked; rows of one id with the same text are not smaller than each other; a
repeated label counts once, as 1 if any of its rows has 1; documents without a label are lost by none; an empty table
gives no rows; parts are never dropped, and a step that removes nothing has zeros; other columns are ignored; texts are
read whole.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
FIRST, GROWTH = 256, 8
#: Bits that tell which texts may be in a surviving class, in bitmaps of 32,768: 2,048 rows of 4 KB
FILTER_BITS = 1 << 26
_SPACE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """The mask of A to D for a text: bit 0 is A."""
    words = F.array_remove(F.split(text, _SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    failed = (n < 200, distinct * 100 < n * 50, F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 2, text.rlike("[#$%&*|]"))
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failed)), F.lit(0))


def blocks(text: Column) -> Column:
    """The array of hashes of successive blocks, FIRST code points and then growing; empty for an empty text."""
    starts = F.array(*[F.lit(0 if k == 0 else FIRST * GROWTH ** (k - 1)) for k in range(9)])
    one = lambda s: F.xxhash64(F.substr(text, s + 1, F.when(s == 0, FIRST).otherwise(s * (GROWTH - 1))))
    return F.transform(F.array(F.length(text)), lambda n: F.transform(F.filter(starts, lambda s: s < n), one))[0]  # the length is counted once


def _refined(cls: Column, block: Column) -> Column:
    return F.xxhash64(cls, block)


def _class(length: Column, hashes: Column, refined: Callable[[Column, Column], Column]) -> Column:
    """The class of a row after all its blocks."""
    return F.aggregate(hashes, length.cast("long"), refined)


def _texts(docs: DataFrame) -> DataFrame:
    d = pick(docs, "doc_id", "text", "source")
    return d.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))


def _several(rows: DataFrame) -> DataFrame:
    """The rows whose class has several; counts are made within each task first, and the join splits a hot class."""
    return rows.join(rows.groupBy("cls").count().filter("count > 1").select("cls"), "cls", "leftsemi")


def classes_left(rows: DataFrame, refined: Callable[[Column, Column], Column] = _refined) -> DataFrame:
    """One row (cls) for every class of two or more rows that no block hash could split; rows have n_chars and blocks."""
    left = cut(_several(rows.select(F.col("n_chars").cast("long").alias("cls"), "blocks")), "refined")
    rounds = left.agg(F.max(F.size("blocks"))).first()[0] or 0
    done = left.filter(F.size("blocks") == 0).select("cls").distinct()
    for k in range(rounds):
        split = left.filter(F.size("blocks") > k).select(refined(F.col("cls"), F.col("blocks")[k]).alias("cls"), "blocks")
        left = cut(_several(split), "refined")
        done = done.unionByName(left.filter(F.size("blocks") == k + 1).select("cls").distinct())
    return done.distinct()


def _maybe(texts: DataFrame, cls: DataFrame) -> DataFrame:
    """The rows of texts whose class is in cls, and few others: cls goes out as a bitmap of bounded size."""
    slot = F.pmod("cls", F.lit(FILTER_BITS)) + 1
    bits = cls.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = texts.withColumn("bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bits), "bucket")
    return found.filter(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1).drop("bucket", "bits")


def duplicate_classes(docs: DataFrame, rows: DataFrame, refined: Callable[[Column, Column], Column] = _refined) -> tuple[DataFrame, DataFrame]:
    """(cls, text, least) of every different text in the surviving classes, and (cls, least, texts) of the classes."""
    t = _texts(docs)
    t = t.select("doc_id", "text", _class(F.length("text"), blocks(F.col("text")), refined).alias("cls"))
    same = _maybe(t, classes_left(rows, refined)).groupBy("cls", "text").agg(F.min("doc_id").alias("least"))
    return same, same.groupBy("cls").agg(F.min("least").alias("least"), F.count("*").alias("texts"))


def masks(docs: DataFrame, labels: DataFrame, refined: Callable[[Column, Column], Column] = _refined) -> DataFrame:
    """part, mask of failed filters, n documents, good and toxic ones among them."""
    narrow = _texts(docs).select("doc_id", "part", failures(F.col("text")).alias("mask"), F.length("text").alias("n_chars"), blocks(F.col("text")).alias("blocks"))
    narrow = cut(narrow, "audited")
    same, found = duplicate_classes(docs, narrow, refined)
    found = cut(found, "copies")
    known = pick(labels, "doc_id", "quality", "toxic").filter("doc_id is not null").groupBy("doc_id")
    known = known.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    rows = narrow.select("doc_id", "part", "mask", _class(F.col("n_chars"), F.col("blocks"), refined).alias("cls"))
    marked = rows.join(found, "cls", "left")
    collided = found.filter("texts > 1")
    if not collided.isEmpty():  # different texts with equal hashes of all blocks: their rows are marked by their texts
        t = _texts(docs)
        t = t.select("doc_id", "part", failures(F.col("text")).alias("mask"), "text", _class(F.length("text"), blocks(F.col("text")), refined).alias("cls"))
        by_text = t.join(collided.select("cls"), "cls", "leftsemi").join(same, ["cls", "text"])
        marked = marked.filter("coalesce(texts, 1) = 1").drop("texts").unionByName(by_text.select("cls", "doc_id", "part", "mask", "least"))
    failed = F.when(F.col("doc_id") > F.col("least"), DUPLICATE).otherwise(0)
    labelled = marked.select("doc_id", "part", (F.col("mask") + failed).alias("mask")).join(known, "doc_id", "left")
    counted = labelled.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("bad") == 1).alias("bad"))
    return counted


def audit(docs: DataFrame, labels: DataFrame, refined: Callable[[Column, Column], Column] = _refined) -> DataFrame:
    """One row for each part, order of the filters and step, with what the filter of that step does there."""
    counted = masks(docs, labels, refined).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("m"))  # 32 a part at most
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    steps = [(order, k + 1, sum(bit[f] for f in order[:k]), bit[order[k]]) for order in map("".join, permutations(FILTERS)) for k in range(len(FILTERS))]
    table = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(before).alias("before"), F.lit(own).alias("own")) for o, s, before, own in steps])
    each = counted.select("part", "m", F.explode(table).alias("s"))
    before, own = F.col("s.before"), F.col("s.own")

    def total(of: str, when: Callable[[Column], Column]) -> Column:
        return F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.when(when(x["mask"]), x[of]).otherwise(0))

    fails = lambda m: m.bitwiseAND(own) != 0
    first = lambda m: fails(m) & (m.bitwiseAND(before) == 0)
    # of the 120 orders, those in which a filter comes before all others that the mask fails, by the number of the mask's bits
    ahead = F.array(*[F.lit(120 // bits) for bits in range(1, len(FILTERS) + 1)])
    shares = F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.when(fails(x["mask"]), x["n"] * F.element_at(ahead, F.bit_count(x["mask"]))).otherwise(0))
    return each.select(
        "part",
        F.col("s.filter_order").alias("filter_order"),
        F.col("s.step").alias("step"),
        total("n", lambda m: m.bitwiseAND(before + own) == 0).alias("kept"),
        total("n", first).alias("removed"),
        total("n", lambda m: fails(m) & (m.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", first).alias("good_lost"),
        total("bad", first).alias("toxic_lost"),
        shares.alias("shapley"),
    )
