"""Fill-in-middle transformation: texts cut at unit borders and put in another order.

One match of ``(unit)*`` by the regex library keeps every repetition of the group, so
``match.ends(1)`` gives the number of units and, by index, both cut offsets.  A document's
cuts and form come from a hash of a seed and its id: reruns and other partitionings agree.

The operator is a row-local ``mapInArrow``: nothing is shuffled, a row needs memory for its
own text only.  The library bounds the repetitions of one match, so a text of more than
``RUN`` units is matched in runs of that many; the units are the same.

Defined results: null and empty texts are ``plain`` with no units.  A text that contains a
mark is ``plain``, so the output of every other text can be taken apart again.  A null id
hashes as the empty string.  Equal rows give equal rows; columns of the input that happen to
carry an output's name don't clash, since only the id and the text are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxframe.session import ship_package

LINES = r"[^\n]*\n|[^\n]+"
RUN = 1_000_000


@dataclass(frozen=True)
class FillMiddle:
    """Units to cut between, marks, seed of the hash, percentages of transformed texts
    and of the suffix-first form among them."""
    unit: str = LINES
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"
    seed: int = 7
    rate: int = 100
    spm_rate: int = 50

    def __post_init__(self):
        if not all(self.marks) or len(set(self.marks)) < 3:
            raise ValueError("three different marks are needed")
        for a in self.marks:
            for b in self.marks:
                if any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)) + (a != b))) or (a != b and a in b):
                    raise ValueError(f"{a!r} and {b!r} overlap: an output could be taken apart in two ways")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix_mark, self.suffix_mark, self.middle_mark

    def transform(self, doc_id, text: str) -> tuple[int, str, int | None, int | None, str]:
        """(units, form, code points of prefix and middle, output) of one document."""
        ends = unit_ends(self.unit, text)
        n = len(ends)
        digest = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
        if not text or any(m in text for m in self.marks) or h[2] % 100 >= self.rate:
            return n, "plain", None, None, text
        at = [0, *ends]
        first, last = sorted((at[h[0] % (n + 1)], at[h[1] % (n + 1)]))
        prefix, middle, suffix = text[:first], text[first:last], text[last:]
        if h[3] % 100 < self.spm_rate:
            return n, "spm", first, last - first, "".join(
                (self.suffix_mark, suffix, self.prefix_mark, prefix, self.middle_mark, middle))
        return n, "psm", first, last - first, "".join(
            (self.prefix_mark, prefix, self.suffix_mark, suffix, self.middle_mark, middle))

    def restore(self, output: str, form: str) -> str:
        """The text that ``transform`` made ``output`` of."""
        if form == "plain":
            return output
        one, two = (self.suffix_mark, self.prefix_mark) if form == "spm" else (self.prefix_mark, self.suffix_mark)
        head, _, middle = output[len(one):].partition(self.middle_mark)
        a, _, b = head.partition(two)
        return b + middle + a if form == "spm" else a + middle + b


def unit_ends(unit: str, text: str) -> list[int]:
    """End offsets of the units, matched left to right over the whole text."""
    import regex
    repeated = regex.compile(f"({unit}){{0,{RUN}}}+")
    ends: list[int] = []
    while True:
        m = repeated.match(text, ends[-1] if ends else 0)
        found = m.ends(1)
        ends += found
        if len(found) < RUN:
            break
    if (ends[-1] if ends else 0) != len(text):
        raise ValueError("the units don't cover the text")
    return ends


def fill_middle(docs: DataFrame, how: FillMiddle = FillMiddle(), id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n`` units, ``form``, ``prefix_chars`` and
    ``middle_chars`` (null if plain) and the ``output`` text."""
    ship_package(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = [how.transform(i, t or "") for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            n, form, prefix, middle, output = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(
        run, f"`{id_col}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(outputs: DataFrame, how: FillMiddle = FillMiddle(), restored_col: str = "restored") -> DataFrame:
    """``outputs`` of ``fill_middle`` with the text rebuilt from ``output`` and ``form`` alone."""
    def skip(c, n: int):
        return F.substring(c, F.lit(n + 1), F.length(c))

    def part(c, mark: str, k: int):
        return F.split_part(c, F.lit(mark), F.lit(k))

    out, form = F.col("output"), F.col("form")
    middle = part(out, how.middle_mark, 2)
    psm, spm = (part(skip(out, len(m)), how.middle_mark, 1) for m in (how.prefix_mark, how.suffix_mark))
    text = F.when(form == "psm", F.concat(part(psm, how.suffix_mark, 1), middle, part(psm, how.suffix_mark, 2))) \
        .when(form == "spm", F.concat(part(spm, how.prefix_mark, 2), middle, part(spm, how.prefix_mark, 1))) \
        .otherwise(out)
    return outputs.withColumn(restored_col, text)


def digest_table(docs: DataFrame, how: FillMiddle = FillMiddle()) -> DataFrame:
    """The transformation with digests in place of texts: of the output and of what it is rebuilt to."""
    made = restore(fill_middle(docs, how), how)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


FILL_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s
  FROM documents),
h AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n,
         CAST('0x' || s[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || s[9:16] AS BIGINT) % (len(u) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR CAST('0x' || s[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || s[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT doc_id, n, form, t, array_to_string(u[1:least(c1, c2)], '') AS a,
         array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS b, array_to_string(u[greatest(c1, c2) + 1:], '') AS c
  FROM h),
o AS (
  SELECT doc_id, n, form, length(a) AS pc, length(b) AS mc,
         CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
                   ELSE '<S>' || c || '<P>' || a || '<M>' || b END AS output
  FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(pc AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(mc AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN output
              WHEN 'psm' THEN split_part(output[4:], '<S>', 1) || split_part(output, '<M>', 2)
                              || split_part(split_part(output, '<M>', 1), '<S>', 2)
              ELSE split_part(split_part(output, '<M>', 1), '<P>', 2) || split_part(output, '<M>', 2)
                   || split_part(output[4:], '<P>', 1) END) AS restored_sha256
FROM o
"""
