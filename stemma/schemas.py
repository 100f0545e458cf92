"""Explicit schemas; nothing is inferred from data.

``abstract_inverted_index`` must be a MAP: inference would make one struct
field per distinct word of the corpus.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_NAMED = _struct(display_name=_S)

INSTITUTION = _struct(id=_S, display_name=_S, ror=_S, country_code=_S, type=_S)
AUTHORSHIP = _struct(
    author=_struct(id=_S, display_name=_S),
    institutions=T.ArrayType(INSTITUTION),
    raw_affiliation_strings=T.ArrayType(_S),
    countries=T.ArrayType(_S),
)
WORK_RECORD = _struct(
    id=_S, doi=_S, title=_S, publication_year=_I, publication_date=_S, type=_S, language=_S, cited_by_count=_L, fwci=_D,
    citation_normalized_percentile=_struct(value=_D, is_in_top_1_percent=_B, is_in_top_10_percent=_B),
    authorships=T.ArrayType(AUTHORSHIP),
    primary_topic=_struct(display_name=_S, subfield=_NAMED, field=_NAMED, domain=_NAMED),
    keywords=T.ArrayType(_struct(display_name=_S, score=_D)),
    abstract_inverted_index=T.MapType(_S, T.ArrayType(_I)),
    primary_location=_struct(source=_struct(display_name=_S, type=_S)),
)

COUNTRY_REGIONS = _struct(country_code=_S, country_name=_S, region=_S, eu27=_S)
COUNTS_BY_YEAR = _struct(ai_bio=T.MapType(_S, _L), bio_baseline=T.MapType(_S, _L))
MANIFEST = _struct(
    retrieved_at=_S, corpus_filter=_S, baseline_filter=_S, records_downloaded=_L, records_in_source=_L,
    max_records_cap=_L, downloaded_by_year=T.MapType(_S, _L), sampling_weights=T.MapType(_S, _D),
)
LABEL_RECORD = _struct(
    work_id=_S, ai_role=_S, bio_area=_S, biosecurity=_B, rationale=_S, model=_S, off_topic=_B, metadata_problem=_B
)
SAMPLE_CSV = _struct(work_id=_S, year=_I, title=_S, abstract=_S)
GOLD_CSV = _struct(work_id=_S, year=_I, title=_S, abstract=_S, human_ai_role=_S, human_notes=_S)
