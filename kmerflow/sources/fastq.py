"""FASTQ in: four-line records that find themselves again in every split of a file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What stands between two line ends with an ``@`` behind them: a record, one whose quality begins with ``@``, that quality.
WHOLE = r"^@?(?P<id>[^\s]*)[^\n]*\n(?P<sequence>[^\n]*)\n\+[^\n]*\n(?P<quality>[^\n]*)\n*$"
OPEN = r"^@?(?P<id>[^\s]*)[^\n]*\n(?P<sequence>[^\n]*)\n\+[^\n]*$"
REST = r"^[^\n]*\n*$"
FIELDS = ["file", "block", "own", "id", "sequence", "quality"]


def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of ``file, block, value``, numbered in each split by ``own``; a quality whose record lies in the split before
    has -1, a record whose quality lies in the next split has none."""
    held, split, count = None, None, 0
    for batch in (*batches, None):
        rows = held if batch is None else pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        if rows is None or not rows.num_rows:
            continue
        rows = rows.combine_chunks()
        text = pc.replace_substring_regex(rows["value"], r"\r(\n|$)", r"\1").combine_chunks()
        whole, begun = pc.extract_regex(text, WHOLE), pc.extract_regex(text, OPEN)
        is_whole, is_open = (x.is_valid().to_numpy(zero_copy_only=False) for x in (whole, begun))
        is_rest = pc.match_substring_regex(text, REST).to_numpy(zero_copy_only=False)
        file, block = rows["file"].combine_chunks(), rows["block"].to_numpy()
        new = np.ones(len(text), bool)
        new[1:] = (block[1:] != block[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
        new[0] = split != (file[0].as_py(), block[0])
        blank = is_rest & (pc.utf8_trim_whitespace(text).cast(pa.binary()).to_numpy(zero_copy_only=False) == b"") & new & (block == 0)
        after_open = np.zeros(len(text), bool)
        after_open[1:] = is_open[:-1] & ~new[1:]
        last = np.append(new[1:], batch is None)  # a record at the end of a batch waits for the next
        n = len(text)
        if batch is not None and is_open[-1]:
            n -= 1
        wrong = ~(is_whole | is_open | is_rest) | (is_rest & ~after_open & ~new & ~blank) | (is_open & ~last & ~np.append(is_rest[1:], True))
        if wrong[:n].any():
            at = int(np.flatnonzero(wrong[:n])[0])
            raise ValueError(f"{file[at].as_py()}: no record of four lines: {text[at].as_py()[:200]!r}")
        head = is_rest & ~after_open & ~blank
        record = is_whole | is_open
        own = np.cumsum(record) - 1
        base = np.where(new, own + ~record, 0)
        at_new = np.maximum.accumulate(np.where(new, np.arange(len(text)), -1))
        own = np.where(at_new >= 0, own - base[np.maximum(at_new, 0)], own + count)
        rest = pc.binary_join_element_wise("@", pc.utf8_rtrim(text, "\n"), "")
        following = pa.array(np.append(np.arange(1, len(text)), 0))
        joined = pa.array(np.append(after_open[1:], False)) if len(text) else pa.array([], pa.bool_())
        quality = pc.if_else(pa.array(is_whole), pc.struct_field(whole, "quality"), pc.if_else(joined, rest.take(following), pc.if_else(pa.array(head), rest, pa.nulls(len(text), pa.string()))))
        pick = lambda c: pc.if_else(pa.array(is_whole), pc.struct_field(whole, c), pc.struct_field(begun, c))
        out = pa.RecordBatch.from_arrays([file, rows["block"].combine_chunks(), pa.array(np.where(head, -1, own), pa.int64()), pick("id"), pick("sequence"), quality], names=FIELDS)
        keep = (record | head)[:n]
        yield out.slice(0, n).filter(pa.array(keep))
        held = rows.slice(n) if n < len(text) else None
        if n:
            split, count = (file[n - 1].as_py(), block[n - 1]), int(own[n - 1]) + 1


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, shard, read_no, number, id, sequence, quality`` of four-line records (S4, S6), empty reads and CRLF too.

    ``read_no`` counts from 0 in each file, ``shard`` the files by name, ``number`` the reads of all files in that order.
    Files are cut at ``@`` behind a line end, which begins a record or a quality; a record is told by its lines, so every
    split numbers its own. Only a row for each split goes from one to the next: how many records stand before it, and a
    quality whose record ended the split before. What is no record of four lines, or has a quality of another length, raises.
    """
    lines = spark.read.option("lineSep", "\n@").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    parts = lines.mapInArrow(assembled, "file string, block long, own long, id string, sequence string, quality string")
    ends = parts.groupBy("file", "block").agg(F.count_if(F.col("own") >= 0).alias("n"), F.max(F.when(F.col("own") < 0, F.col("quality"))).alias("head"), F.count_if(F.expr("own >= 0 and quality is null")).alias("open"))
    in_file, every = Window.partitionBy("file").orderBy("block"), Window.orderBy("file", "block")
    known = ends.select(
        "file", "block", (F.dense_rank().over(Window.orderBy("file")) - 1).alias("shard"), (F.sum("n").over(in_file) - F.col("n")).alias("before"), (F.sum("n").over(every) - F.col("n")).alias("_before"),
        F.lead("head").over(in_file).alias("tail"), (F.col("head").isNotNull() != (F.coalesce(F.lag("open").over(in_file), F.lit(0)) > 0)).alias("torn"),
    )
    rows = parts.where("own >= 0").join(F.broadcast(known), ["file", "block"])  # a row for each split
    quality = F.coalesce("quality", "tail")
    whole = F.when(F.col("torn") | quality.isNull() | (F.length(quality) != F.length("sequence")), F.raise_error(F.format_string("%s: read %d: sequence and quality differ in length", "file", F.col("before") + F.col("own")))).otherwise(quality)
    return rows.select("file", "shard", (F.col("before") + F.col("own")).alias("read_no"), (F.col("_before") + F.col("own")).alias("number"), "id", "sequence", whole.alias("quality"))


def interleave_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Reads of both sides in one table, ``/`` in ids as ``_`` (S5): inner join on shard, if both name it, and read number,
    then two rows each. Shards pair by the order of their names on either side."""
    by = [c for c in ("shard", "read_no") if c in first.columns and c in second.columns]
    pair = lambda d, k: d.select(*by, F.struct(F.lit(k).alias("mate"), F.regexp_replace("id", "/", "_").alias("id"), "sequence").alias(f"r{k}"))
    joined = pair(first, 1).join(pair(second, 2), by)
    return joined.select(*by, F.explode(F.array("r1", "r2")).alias("r")).select(*by, "r.mate", "r.id", "r.sequence")
