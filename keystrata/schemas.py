"""Declared schemas of the stage tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _i, _l, _d, _b = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


LOCATION = _struct(file_path=_s, start_line=_i, end_line=_i, byte_offset=_l, snippet=_s)
CONTAINER_CONTEXT = _struct(image_reference=_s, layer_id=_s, filesystem_path=_s)

FILES = _struct(path=_s, name=_s, length=_l, modificationTime=T.TimestampType(), content=T.BinaryType())

FINDINGS = _struct(
    finding_id=_s,
    emit_seq=_l,  # emission order; unique within one path
    scanner_name=_s,
    scanner_version=_s,
    discovered_at=T.TimestampType(),
    discovery_method=_s,
    raw_symbol=_s,
    suspected_algorithm=_s,
    artifact_category=_s,
    library_hint=_s,
    key_size_hint=_i,
    mode_hint=_s,
    curve_hint=_s,
    location=LOCATION,
    raw_parameters=T.MapType(_s, _s),
    symbol_name=_s,
    binary_format=_s,
    container_context=CONTAINER_CONTEXT,
    confidence_score=_d,
    confidence_rationale=_s,
)

SYMBOLS = _struct(path=_s, symbol=_s, dll=_s)

TIMELINE_INPUTS = _struct(
    asset_id=_s,
    migration_time_years=_d,
    quantum_arrival_years=_d,
    protected_lifetime_years=_d,
    hndl_sensitive=_b,
    assessment_date=T.DateType(),
)

ASSETS = _struct(
    asset_id=_s,
    algorithm=_s,
    algorithm_family=_s,
    primitive_type=_s,
    key_length_bits=_i,
    curve=_s,
    mode=_s,
    padding=_s,
    implementation_library=_s,
    location=LOCATION,
    finding_count=_l,
    confidence_score=_d,
    confidence_level=_s,
    confidence_rationale=_s,
)

STAGES = {
    "files": FILES, "findings": FINDINGS, "symbols": SYMBOLS,
    "timeline_inputs": TIMELINE_INPUTS, "assets": ASSETS,
}


def conform(df, schema: T.StructType):
    """Project ``df`` to a declared schema, adding missing columns as null."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
