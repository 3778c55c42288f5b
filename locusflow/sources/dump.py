"""Record dumps: a header line and one JSON object a record."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import write_lines

TAGS = ("NM", "RG", "MD", "AS", "XS")
FIELDS = (
    "query_name", "flag", "reference_id", "reference_name", "reference_start", "mapping_quality", "cigar",
    "query_sequence", "next_reference_id", "next_reference_start", "template_length",
)


def tag_text(tag: Column) -> Column:
    """A tag's value as text: letters and strings as they are, numbers plain, arrays comma-joined."""
    return F.coalesce(
        tag["s"],
        tag["i"].cast("string"),
        tag["f"].cast("string"),
        F.array_join(F.transform(tag["ia"], lambda v: v.cast("string")), ","),
        F.array_join(F.transform(tag["fa"], lambda v: v.cast("string")), ","),
    )


def json_lines(alignments: DataFrame) -> DataFrame:
    """file_offset and value: each record's object, with the tags in TAGS that it has."""
    kept = F.map_filter("tags", lambda k, v: k.isin(*TAGS))
    tags = F.transform_values(kept, lambda k, v: tag_text(v))
    return alignments.select(
        "file_offset", F.to_json(F.struct(*FIELDS, tags.alias("tags")), {"ignoreNullFields": "false"}).alias("value")
    )


def header_line(header) -> str:
    return json.dumps({"type": "header", "references": header.names, "lengths": header.lengths})


def write_json_lines(alignments: DataFrame, path: str, header, mode: str = "errorifexists") -> None:
    """The header's line, then objects in file order, in parts that follow each other."""
    write_lines(json_lines(alignments).orderBy("file_offset"), path, header_line(header), mode)
