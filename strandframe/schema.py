"""Schemas of the tables that queries take and return."""

from __future__ import annotations

ALIGNMENTS = "rec_idx long, qname string, flag int, tid int, contig string, pos long, mapq int, cigar string, mtid int, mpos long, seq string, qual array<int>, mc string, tags string, mcontig string, tlen int"
CONTIGS = "tid int, contig string, length long"
#: a reference cut into bins of equal width; length is the contig's
REFERENCE = "contig string, bin long, bin_start long, length long, seq string"
BED = "contig string, start long, end long"
DISCOUNTS = "base_change string, read_num int, base_position long, discount_count long"
MATRIX = "read_num int, position int, ref_base string, read_base string, scaling_factor float"
