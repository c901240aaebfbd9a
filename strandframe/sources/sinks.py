"""Text files of results: one file each, or standard output ("-" or None). Results are aggregates, so rows stream through the driver;
records don't."""

from __future__ import annotations

import os
import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions.exprs import fixed6
from strandframe.operators import rescale
from strandframe.sources import sam
from strandframe.staging import shared_path


def write_lines(lines: Iterable[str], path: str | None) -> None:
    if path in (None, "-"):
        sys.stdout.writelines(f"{x}\n" for x in lines)
        sys.stdout.flush()
        return
    if "://" in path or path.startswith("file:"):
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(path)
        with system.open_output_stream(place, compression=None) as f:
            for x in lines:
                f.write(f"{x}\n".encode())
        return
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f"{x}\n" for x in lines)


def _rows(table: DataFrame, separator: str = "\t") -> Iterable[str]:
    line = table.select(*(F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(table.columns)))
    return (separator.join("" if x is None else x for x in row) for row in line.toLocalIterator())


def _write(table: DataFrame, path: str | None, header: bool = True, separator: str = "\t") -> None:
    head = [separator.join(table.columns)] if header else []
    write_lines((x for part in (head, _rows(table, separator)) for x in part), path)


def _placed(table: DataFrame, insert_mode: bool, value: str) -> DataFrame:
    name = "fragment_position" if insert_mode else "read_position"
    order = ["reference_order", "read_num", "base_position", "base_change"]
    return table.orderBy(*order).select("base_change", "read_num", "reference_order", F.col("base_position").alias(name), value)


def write_counts(counts: DataFrame, path: str | None = None, insert_mode: bool = True) -> None:
    _write(_placed(counts, insert_mode, "count"), path)


def write_normalized(table: DataFrame, path: str | None = None, insert_mode: bool = True) -> None:
    _write(_placed(table, insert_mode, "normalized_frequency").withColumn("normalized_frequency", fixed6(F.col("normalized_frequency"))), path)


def write_matrix(matrix: DataFrame, path: str | None = None) -> None:
    rows = matrix.orderBy("read_num", "position", "ref_base", "read_base")
    _write(rows.select("read_num", "position", "ref_base", "read_base", fixed6(F.col("scaling_factor").cast("double")).alias("scaling_factor")), path, header=False)


def write_variants(variants: DataFrame, path: str | None) -> None:
    _write(variants.orderBy("chromosome", "position", "reference_base", "mismatch_base").select("chromosome", "position", "reference_base", "mismatch_base", "count", "depth"), path)


def write_inconsistencies(table: DataFrame, path: str | None) -> None:
    _write(table.orderBy("read1_position", "read2_position", "discordance_type").select("read1_position", "read2_position", "discordance_type", "count"), path)


def write_discounts(table: DataFrame, path: str | None = None) -> None:
    _write(table.orderBy("read_num", "read_position", "mismatch_type").select("mismatch_type", "read_num", "read_position", "discount_count"), path)


def write_series(series: DataFrame, path: str) -> None:
    """The series of plotprep.zero_filled()."""
    _write(series.orderBy("read_num", "reference_order", "base_change", "position"), path)


def write_wide_positions(wide: DataFrame, path: str | None = None) -> None:
    _write(wide.orderBy("Read", "Position"), path, separator=",")


def write_wide_inconsistencies(wide: DataFrame, path: str | None = None) -> None:
    rows = wide.orderBy("Read1_Pos", "Read2_Pos")
    write_lines(["", "# Read Pair Inconsistencies", ",".join(rows.columns), *_rows(rows, ",")], path)


def _write_part(folder: str):
    def run(batches):
        from uuid import uuid4

        from pyarrow import RecordBatch, array, fs
        from pyspark import TaskContext

        path = f"{folder}/{uuid4().hex}"
        system, place = fs.FileSystem.from_uri(path)
        with system.open_output_stream(place, compression=None) as out:
            for b in batches:
                if len(b):
                    out.write(("\n".join(b.column(0).to_pylist()) + "\n").encode())
        yield RecordBatch.from_arrays([array([TaskContext.get().partitionId()]), array([path])], ["number", "path"])

    return run


def write_sam(records: DataFrame, header: list[str], path: str | None = None) -> None:
    """Placed records in order, then the others. Tasks write the lines of their parts to the shared folder; the driver copies them one
    behind the other. Only standard output gets its lines through the driver."""
    ordered = rescale.in_order(records)
    lines = ordered.select(sam.line(ordered).alias("line"))
    if path in (None, "-"):
        write_lines((x for part in (header, (r["line"] for r in lines.toLocalIterator())) for x in part), path)
        return
    from pyarrow import fs

    folder = shared_path(records.sparkSession, "sam")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    system, place = fs.FileSystem.from_uri(folder)
    system.create_dir(place, recursive=True)
    done = lines.mapInArrow(_write_part(folder), "number long, path string").collect()  # a row a task
    to, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    with to.open_output_stream(at, compression=None) as out:
        out.write("".join(f"{x}\n" for x in header).encode())
        for part in sorted(done, key=lambda r: r["number"]):
            own, there = fs.FileSystem.from_uri(part["path"])
            with own.open_input_stream(there, compression=None) as file:
                while data := file.read(8 << 20):
                    out.write(data)
