"""Queries of the problems tagged llm, by the name the driver knows them under."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import lookalike, markup, mixture, mojibake, overlap, pii, scan_noise, tokens
from cairn.session import cut, read

Query = Callable[[SparkSession, str], DataFrame]


def _p2_report(s: SparkSession, d: str) -> DataFrame:
    images = read(s, d, "image_record")
    return overlap.overlap_report(images, cut(overlap.cross_split_pairs(images)))


QUERIES: dict[str, Query] = {
    "p1_found": lambda s, d: mojibake.found(read(s, d, "encoding_result")),
    "p1_restored": lambda s, d: mojibake.restored(read(s, d, "encoding_result")),
    "p2_found": lambda s, d: overlap.cross_split_pairs(read(s, d, "image_record")),
    "p2_report": _p2_report,
    "p4_found": lambda s, d: lookalike.equal_looking_pairs(read(s, d, "document_data"), "file_id", "full_text"),
    "p4_classes": lambda s, d: lookalike.equal_looking_classes(read(s, d, "document_data"), "file_id", "full_text"),
    "p4_canonical": lambda s, d: lookalike.canonical(read(s, d, "document_data"), "file_id", "full_text"),
    "p5_found": lambda s, d: scan_noise.found(read(s, d, "document_data")),
    "p5_repaired": lambda s, d: scan_noise.repaired(read(s, d, "document_data")),
    "p7_found": lambda s, d: markup.found(read(s, d, "document_data")),
    "p7_clean": lambda s, d: markup.cleaned(read(s, d, "document_data")),
    "p8_ids": lambda s, d: tokens.token_ids(read(s, d, "documents")),
    "p9_mix": lambda s, d: mixture.mix(read(s, d, "documents"), read(s, d, "source_target"))[0],
    "p9_shares": lambda s, d: mixture.mix(read(s, d, "documents"), read(s, d, "source_target"))[1],
    "p10_found": lambda s, d: pii.found(read(s, d, "documents")),
    "p10_redacted": lambda s, d: pii.redacted(read(s, d, "documents")),
}

#: SQL can't express these operators; they are tested against brute force, round trips and fixtures.
ORACLES: dict[str, str] = {}
