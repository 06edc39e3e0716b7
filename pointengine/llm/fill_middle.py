"""Fill-in-middle transformation: DuckDB runs inside the map tasks, over one Arrow batch after another.

A text is cut at two drawn places into prefix, middle and suffix, and written as ``<P>prefix<S>suffix<M>middle`` (psm) or as
``<S>suffix<P>prefix<M>middle`` (spm); some texts stay plain.  The draws are the first four 8-digit groups of the hex SHA-256 of
``seed:doc_id``, so a document is cut alike in every run and on every machine.

Each batch is registered as a table of an in-memory DuckDB, and one statement makes the whole result: no Python code runs per
row.  A text is taken apart with regexp_extract_all into blocks of BLOCK code points, so that a list holds one entry a block; only
the two blocks that a cut falls into are taken apart by code point.  list_slice and array_to_string put the parts together.

Memory of a task: SLICE_BYTES of text, or one longer text, a few times over.  No shuffle, nothing is kept between rows, and a lost
task is simply run again.

Defined results: a null text is an empty one; an empty text is plain, with n = 0.  A null doc_id draws from ``seed:`` alone.  Rows that
repeat a doc_id or a text are each transformed on their own.  An empty table gives no rows.  Very long texts are cut like others: all
places count, up to 2^32 code points.  Other columns than doc_id and text are not looked at.  Nothing is compared, so there are no ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents
from .textbytes import column

#: Code points of a block, the unit in which texts are taken apart.
BLOCK = 64
#: Bytes of text that one statement takes, or one longer text.
SLICE_BYTES = 1 << 20
#: Of a hundred texts, so many stay plain from this draw on, and so many of the others become spm.
PLAIN_FROM, SPM_BELOW = 90, 20
#: DuckDB's own bound; without a folder for spilling it raises instead of filling a local disk.
DUCK_MEMORY = "900MB"

_TRANSFORM = r"""
WITH drawn AS (
  SELECT doc_id, text, sha256({seed} || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(text, '(?s).{{1,{block}}}') AS b FROM batch
), numbers AS (
  SELECT doc_id, text, b, CAST(CASE WHEN len(b) = 0 THEN 0 ELSE {block} * (len(b) - 1) + length(b[-1]) END AS BIGINT) AS n,
         [CAST('0x' || h[8 * i + 1 : 8 * i + 8] AS BIGINT) FOR i IN [0, 1, 2, 3]] AS r FROM drawn
), places AS (
  SELECT doc_id, text, b, n,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= {plain} THEN 'plain' WHEN r[4] % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form,
         least(r[1] % (n + 1), r[2] % (n + 1)) AS x, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS y FROM numbers
), met AS (
  SELECT *, regexp_extract_all(CASE WHEN form <> 'plain' THEN coalesce(b[x // {block} + 1], '') ELSE '' END, '(?s).') AS bx,
            regexp_extract_all(CASE WHEN form <> 'plain' THEN coalesce(b[y // {block} + 1], '') ELSE '' END, '(?s).') AS by_ FROM places
), parts AS (
  SELECT *, array_to_string(list_slice(b, 1, x // {block}), '') || array_to_string(list_slice(bx, 1, x % {block}), '') AS prefix,
         CASE WHEN x // {block} = y // {block} THEN array_to_string(list_slice(bx, x % {block} + 1, y % {block}), '')
              ELSE array_to_string(list_slice(bx, x % {block} + 1, len(bx)), '') || array_to_string(list_slice(b, x // {block} + 2, y // {block}), '') || array_to_string(list_slice(by_, 1, y % {block}), '') END AS middle,
         array_to_string(list_slice(by_, y % {block} + 1, len(by_)), '') || array_to_string(list_slice(b, y // {block} + 2, len(b)), '') AS suffix FROM met
), transformed AS (
  SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
         CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM parts
)"""

# The marks cannot arise where parts meet, as none ends as another begins; so the first of each is the one that was set.
_RESTORED = r"""
split AS (SELECT *, CASE WHEN form = 'plain' THEN [] ELSE string_split(output[4:], CASE form WHEN 'psm' THEN '<S>' ELSE '<P>' END) END AS a FROM transformed),
ended AS (SELECT *, CASE WHEN form = 'plain' THEN [] ELSE string_split(a[2], '<M>') END AS e FROM split),
restored AS (SELECT * EXCLUDE (a, e), CASE form WHEN 'plain' THEN output WHEN 'psm' THEN a[1] || e[2] || e[1] ELSE e[1] || e[2] || a[1] END AS text FROM ended)"""

TRANSFORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
DIGESTED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
RESTORED = "doc_id long, form string, text string"


def _slices(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of SLICE_BYTES of text, or one row."""
    offs, lo = column(batch, name)[1], 0
    while lo < len(batch):
        hi = lo + 1
        while hi < len(batch) and offs[hi + 1] - offs[lo] <= SLICE_BYTES:
            hi += 1
        yield batch.slice(lo, hi - lo)
        lo = hi


def _mapped(df: DataFrame, sql: str, schema: str, text: str) -> DataFrame:
    """The statement over every batch, known to it as the table batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": DUCK_MEMORY, "temp_directory": "", "preserve_insertion_order": True})
        for batch in batches:
            for part in _slices(batch, text):
                con.register("batch", pa.Table.from_batches([part]))
                yield from con.execute(sql).to_arrow_table().to_batches()
                con.unregister("batch")
        con.close()

    return df.mapInArrow(run, schema)


def _statement(seed: int, plain_from: int, spm_below: int) -> str:
    return _TRANSFORM.format(seed=f"'{int(seed)}:'", block=BLOCK, plain=int(plain_from), spm=int(spm_below))


def transform(docs: DataFrame, seed: int = 1, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): every document, transformed; n counts code points."""
    return _mapped(documents(docs), _statement(seed, plain_from, spm_below) + " SELECT doc_id, n, form, prefix_chars, middle_chars, output FROM transformed", TRANSFORMED, "text")


def restore(transformed: DataFrame) -> DataFrame:
    """(doc_id, form, text): the texts, rebuilt from output and form alone."""
    sql = "WITH transformed AS (SELECT * FROM batch)," + _RESTORED + " SELECT doc_id, form, text FROM restored"
    return _mapped(transformed.select("doc_id", "form", "output"), sql, RESTORED, "output")


def digest(docs: DataFrame, seed: int = 1) -> DataFrame:
    """transform() and restore() in one pass, with SHA-256 sums in place of texts."""
    sql = _statement(seed, PLAIN_FROM, SPM_BELOW) + "," + _RESTORED + " SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM restored"
    return _mapped(documents(docs), sql, DIGESTED, "text")
