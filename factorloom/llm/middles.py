"""Fill-in-middle transformation over run-length encoded character classes.

A text is held as its maximal runs of one character class with the number of units that end before each run. The end of any unit then
follows by a binary search for its run and arithmetic inside it; the text is never cut into units. Which units there are is a rule of
two classes: whether a run of a class ends a unit at each of its characters, at its last one, or nowhere. The text's end ends its last unit.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import batch_of, body, map_batches
from .prints import code_points

EACH, LAST, NOWHERE = "each", "last", "nowhere"
SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint32)


@dataclass(frozen=True)
class Units:
    """The characters of the one class, and where runs of it and of the other class end units."""

    marks: tuple[int, ...]
    of_marks: str
    of_others: str


#: Lines keep their newline; words keep the white space (of ASCII) after them.
UNITS = {"lines": Units((10,), EACH, NOWHERE), "words": Units(tuple(SPACES.tolist()), LAST, NOWHERE), "chars": Units((), EACH, EACH)}


class Runs:
    """The runs of a text: where each starts, how its class ends units, and how many units end before it."""

    def __init__(self, codes: np.ndarray, units: Units):
        self.size = len(codes)
        marked = codes == units.marks[0] if len(units.marks) == 1 else np.isin(codes, units.marks)
        change = np.flatnonzero(marked[1:] != marked[:-1]) + 1
        self.starts = np.concatenate([np.zeros(min(self.size, 1), np.int64), change])
        self.ends = np.concatenate([change, np.full(min(self.size, 1), self.size, np.int64)])
        of_marks, of_others = units.of_marks, units.of_others
        long = self.ends - self.starts
        own = {EACH: long, LAST: np.ones_like(long), NOWHERE: np.zeros_like(long)}
        mark = marked[self.starts]
        self.each = mark & (of_marks == EACH) | ~mark & (of_others == EACH)
        ended = np.where(mark, own[of_marks], own[of_others])
        if self.size and not ended[-1]:
            ended[-1] = 1  # the last unit, which the text's end closes
        self.before = np.cumsum(ended) - ended
        self.units = int(ended.sum())

    def end_of(self, unit: int) -> int:
        """Where the first ``unit`` units end, in characters."""
        if not unit:
            return 0
        run = int(np.searchsorted(self.before, unit, "left")) - 1  # the last run before which fewer units end
        return int(self.starts[run] + unit - self.before[run]) if self.each[run] else int(self.ends[run])


@dataclass(frozen=True)
class Plan:
    """What decides on a document: its units, the marks, the salt of its hash, and the shares (of 100) to transform and to put suffix first."""

    units: str = "lines"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    salt: str = "7"
    transformed: int = 100
    suffix_first: int = 50

    def __post_init__(self) -> None:
        if self.units not in UNITS:
            raise ValueError(f"units must be one of {sorted(UNITS)}")
        for mark in self.marks():
            if not mark or any(mark[i:] == mark[:-i] for i in range(1, len(mark))) or sum(mark in m for m in self.marks()) > 1:
                raise ValueError(f"{mark!r} would not be found again: marks must not be empty, overlap themselves or hold each other")

    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def apply(self, doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
        """Units, form, characters of prefix and middle (None if plain), and the output."""
        runs = Runs(code_points(text), UNITS[self.units])
        digest = hashlib.sha256(f"{self.salt}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
        one, two, chance, side = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
        if not text or any(m in text for m in self.marks()) or chance % 100 >= self.transformed:
            return runs.units, "plain", None, None, text
        low, high = sorted((one % (runs.units + 1), two % (runs.units + 1)))
        a, b = runs.end_of(low), runs.end_of(high)
        begin, inner, rest = text[:a], text[a:b], text[b:]
        if side % 100 < self.suffix_first:
            return runs.units, "spm", a, b - a, f"{self.suffix}{rest}{self.prefix}{begin}{self.middle}{inner}"
        return runs.units, "psm", a, b - a, f"{self.prefix}{begin}{self.suffix}{rest}{self.middle}{inner}"

    def restore(self, form: str | None, output: str | None) -> str | None:
        """The text, from its output and form alone."""
        if form in (None, "plain") or output is None:
            return output
        first, second = (self.suffix, self.prefix) if form == "spm" else (self.prefix, self.suffix)
        cut = output.index(second, len(first))
        end = output.index(self.middle, cut + len(second))
        a, b, inner = output[len(first) : cut], output[cut + len(second) : end], output[end + len(self.middle) :]
        return b + inner + a if form == "spm" else a + inner + b


TYPES = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}


def fill_in_middle(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """Each whole text with its middle moved to the end: doc_id, n (units), form, prefix_chars, middle_chars, output.

    Cuts, form and order follow from a hash of the doc_id, so neither partitions nor reruns change them. One row a row; repeated
    rows come out alike; a null doc_id hashes as ``null``; null texts count as empty, and empty ones stay plain, as do those that hold a mark; very
    long texts are cut as any other; an empty table gives an empty result; further columns are ignored.
    """
    plan = plan or Plan()

    def make():
        def work(batch):
            found = [plan.apply(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            columns = zip(*found, strict=True) if found else [[] for _ in range(5)]
            return batch_of(TYPES, {"doc_id": batch.column(0), **dict(zip(list(TYPES)[1:], map(list, columns), strict=True))})

        return work

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return map_batches(docs.select(F.col("doc_id").cast("long"), body()), make, schema)


def restore(outputs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """Adds ``restored``, the text rebuilt from form and output; a null output stays null, further columns stay but for one of that name."""
    plan = plan or Plan()
    rest = [c for c in outputs.columns if c != "restored"]
    kept = outputs.select(*rest)

    def run(batches):
        for batch in batches:
            forms, texts = (batch.column(rest.index(c)).to_pylist() for c in ("form", "output"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(plan.restore, forms, texts), pa.string())], names=[*rest, "restored"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("restored", StringType())]))


def middle_report(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """The transformation's figures and the digests of each output and of the text restored from it."""
    back = restore(fill_in_middle(docs, plan), plan)
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: Lines are matched as the contract words it; the hash gives cuts, form and order.
SQL = r"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('7:' || doc_id) AS h FROM documents),
num AS (SELECT *, len(lines) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS hs FROM cut),
pos AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS lo, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS hi,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= 100 THEN 'plain' WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM num),
parts AS (SELECT *, array_to_string(lines[1:lo], '') AS p, array_to_string(lines[lo + 1:hi], '') AS m, array_to_string(lines[hi + 1:], '') AS s FROM pos)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
