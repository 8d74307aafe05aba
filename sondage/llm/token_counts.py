"""Token counts by field: whole documents are encoded once and tokens attributed by their characters.

The fields of a row are rendered as one text, joined by a separator, and encoded as
that text. Each token's character span is joined to the fields' intervals. A token
that reaches over a boundary is allocated by ``rule``:

``first``  to the field of its first character (of the separator: to the field before it)
``most``   to the field with most of its characters, the first of these on a tie

``overlapping`` counts the tokens that have a character in the field, so a
boundary-crossing token counts in each of its fields there.

``count_by_section`` does the same for sections of one text, runs of a fixed number of
characters whose ends may lie inside a word.

Defined results: a null field is an empty one; a document without tokens still has a
row for each field, and one section; rows with the same or no id are counted each on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import column, map_slices, pick
from .tokens import encoder

RULES = ("first", "most")


def attributed(starts: np.ndarray, stops: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str
               ) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by rule and tokens overlapping, per interval; tokens and intervals in order of one text line."""
    own = np.searchsorted(first, starts, "right") - 1
    end = np.searchsorted(first, np.maximum(stops - 1, starts), "right") - 1
    overlapping = np.bincount(own[starts < last[own]], minlength=len(first))
    crossing = np.flatnonzero(end > own)
    for token in crossing.tolist():  # few: only tokens over a boundary
        inside = np.arange(own[token], end[token] + 1)
        share = np.minimum(last[inside], stops[token]) - np.maximum(first[inside], starts[token])
        overlapping[inside[1:][share[1:] > 0]] += 1
        if rule == "most":
            own[token] = inside[int(share.argmax())]
    return np.bincount(own, minlength=len(first)), overlapping


def count_by_field(docs: DataFrame, tokenizer: str, fields: list[str], *, doc_id: str = "doc_id", separator: str = "\n",
                   rule: str = "first") -> DataFrame:
    """``doc_id, field, start, stop, n_tokens, overlapping``: a row per document and field, in characters of the rendering."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    texts = [F.coalesce(column(f).cast("string"), F.lit("")) for f in fields]
    source = docs.select(column(doc_id).alias("doc_id"), F.concat_ws(separator, *texts).alias("text"),
                         F.array(*[F.char_length(t).cast("long") for t in texts]).alias("sizes"))
    gap, k = len(separator), len(fields)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, bounds, starts, stops = encoder(tokenizer, True)(batch.column("text"))
        n = batch.num_rows
        sizes = batch.column("sizes").flatten().to_numpy(zero_copy_only=False).reshape(n, k)
        first = np.cumsum(sizes + gap, axis=1) - sizes - gap
        last = first + sizes
        # All documents on one line, each as long as its rendering and one more.
        length = last[:, -1] + 1
        base = np.cumsum(length) - length
        shift = np.repeat(base, np.diff(bounds))
        counts, overlapping = attributed(starts + shift, stops + shift, (first + base[:, None]).ravel(),
                                         (last + base[:, None]).ravel(), rule)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(np.repeat(np.arange(n), k))), pa.array(fields * n, pa.string()),
             pa.array(first.ravel()), pa.array(last.ravel()), pa.array(counts), pa.array(overlapping)],
            ["doc_id", "field", "start", "stop", "n_tokens", "overlapping"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return map_slices(source, "text", work, f"doc_id {kind}, field string, start bigint, stop bigint, n_tokens bigint, "
                                            "overlapping bigint")


def count_by_section(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", size: int = 1000,
                     rule: str = "most") -> DataFrame:
    """``doc_id, section, start, stop, n_tokens, overlapping``: a row per run of ``size`` characters of each whole text."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    whole = pick(docs, doc_id=doc_id, text=text).withColumn("chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, bounds, starts, stops = encoder(tokenizer, True)(batch.column("text"))
        chars = batch.column("chars").to_numpy()
        sections = np.maximum(-(-chars // size), 1)
        # All documents on one line, each as long as its text and one more.
        base = np.cumsum(chars + 1) - chars - 1
        owner = np.repeat(np.arange(len(chars)), sections)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(sections) - sections, sections)
        first = number * size
        last = np.minimum(first + size, chars[owner])
        shift = np.repeat(base, np.diff(bounds))
        counts, overlapping = attributed(starts + shift, stops + shift, first + base[owner], last + base[owner], rule)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(owner)), pa.array(number, pa.int64()), pa.array(first), pa.array(last),
             pa.array(counts), pa.array(overlapping)], ["doc_id", "section", "start", "stop", "n_tokens", "overlapping"])

    kind = whole.schema["doc_id"].dataType.simpleString()
    return map_slices(whole, "text", work, f"doc_id {kind}, section bigint, start bigint, stop bigint, n_tokens bigint, overlapping bigint")
