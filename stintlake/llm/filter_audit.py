"""Filter interaction audit over Walsh-Hadamard parity sums.

Each document is a mask of five bits, one for each filter that it fails. For a part (a source) and
a kind of document (all, good, toxic) the 32 signed parity sums

    S[u] = sum over documents of (-1) ** popcount(mask & u)

are plain sums, so they combine before the shuffle and a part with a third of all rows costs one
partial row a task. The transform is its own inverse up to 32, hence the number of documents
with a mask is (sum over u of (-1) ** popcount(mask & u) * S[u]) / 32, without a remainder. All 120
orders of the filters and the Shapley values then follow from 32 numbers a part. A document that
fails k filters is removed by each of them in 120 / k of the orders, which gives the sum over
orders in closed form.

Texts are read once and never shuffled: rows of (id, part, SHA-256, four bits) are stored, and a row
fails the fifth filter unless its (digest, id) equals the digest's smallest id, an equi-join whose
keys are nearly unique even where thousands of rows share one text.

Defined results: null text counts as empty; a null source is the part ''; a null id is neither
smaller nor larger than another, so it never fails filter E nor makes another row fail; rows that
repeat an id count each, and are not copies of one another unless a smaller id has the text; labels of one
id that disagree count as good and as toxic if any of them says so; an empty table gives no rows.
Other columns of the table are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
KINDS = ("all", "good", "toxic")
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in MEASURES)

#: SIGNS[m, u] = (-1) ** popcount(m & u)
SIGNS = np.array([[1 - 2 * (bin(m & u).count("1") % 2) for u in range(CELLS)] for m in range(CELLS)], np.int64)


def text_failures(text: Column) -> Column:
    """Bits of the filters that look at the text alone: A 1, B 2, C 4, D 8."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    many, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    tests = (many < 200, 100 * distinct < 50 * many, 100 * capitals > 2 * F.length(text), text.rlike("[#$%&*|]"))
    return reduce(lambda a, b: a + b, (F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)))


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per document: id, part, mask with all five bits."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text_failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = stored(rows, "audit_rows")
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).where("id IS NOT NULL").withColumn("is_first", F.lit(True))
    copied = F.col("id").isNotNull() & F.col("is_first").isNull()
    return rows.join(first, ["digest", "id"], "left").select("id", "part", (F.col("mask") + F.when(copied, 16).otherwise(0)).alias("mask"))


def parity_sums(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per part the 32 sums of each kind, as columns ``all_0`` .. ``toxic_31``."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])
    rows = rows.join(marks, "id", "left").select("part", "mask", F.lit(1).alias("all"), *[F.coalesce(k, F.lit(0)).alias(k) for k in KINDS[1:]])
    signs = [1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(u))) % 2) for u in range(CELLS)]
    return rows.groupBy("part").agg(*[F.sum((signs[u] * F.col(k)).cast("long")).alias(f"{k}_{u}") for k in KINDS for u in range(CELLS)])


def cells_of(sums: np.ndarray) -> np.ndarray:
    """Parity sums (..., 32) back to counts a mask, exactly."""
    cells, rest = np.divmod(sums @ SIGNS, CELLS)
    if rest.any():
        raise ArithmeticError("parity sums don't come from whole counts")
    return cells


def evaluate(cells: dict[str, np.ndarray]) -> Iterator[tuple]:
    """The rows of one part: (order, step, the seven measures)."""
    masks = np.arange(CELLS)
    weight = cells["all"] * np.array([0] + [120 // bin(m).count("1") for m in range(1, CELLS)])
    shapley = [int(weight[masks >> k & 1 == 1].sum()) for k in range(len(FILTERS))]
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            fails, alive = masks >> k & 1 == 1, masks & before == 0
            gone = fails & alive
            before |= 1 << k
            yield (
                "".join(FILTERS[x] for x in order), step, int(cells["all"][masks & before == 0].sum()), int(cells["all"][gone].sum()), int(cells["all"][fails & ~alive].sum()),
                int(cells["all"][1 << k]), int(cells["good"][gone].sum()), int(cells["toxic"][gone].sum()), shapley[k],
            )


def audit(sums: DataFrame) -> DataFrame:
    """600 rows a part (120 orders of five steps) from its parity sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = {k: np.stack([batch.column(f"{k}_{u}").to_numpy() for u in range(CELLS)], axis=1) for k in KINDS}
            table = {k: cells_of(v) for k, v in table.items()}
            for row, part in enumerate(batch.column("part").to_pylist()):
                columns = zip(*evaluate({k: v[row] for k, v in table.items()}), strict=True)
                order, step, *numbers = map(list, columns)
                arrays = [pa.array([part] * len(order), pa.string()), pa.array(order, pa.string()), pa.array(step, pa.int32()), *(pa.array(x, pa.int64()) for x in numbers)]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "filter_order", "step", *MEASURES])

    return sums.mapInArrow(run, SCHEMA)


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    return audit(parity_sums(masked(docs, id_col, text_col, part_col), labels, id_col))
